"""Chat formatting by a grammar round trip, in DataFrame functions only.

The grammar, read by a deterministic parser:

    conversation := turn*
    turn         := "### " name ": " body "</turn>\n"

name and body stand for any text in which "###" and "</turn>" don't occur, and name for one without ": ". A
backslash takes the next character as it is. Texts are first written plainly. The conversation is parsed back and
compared to its source; turns that are not recovered (or all, if turns were split or joined) are
escaped, and it is written and parsed again, until all turns are identical. Escaped text can't hold
a control string and reading takes back exactly the escapes, so the second round always ends it;
the result says how many rounds were needed and whether the last one was identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the grammar (fixed values).
OPEN, CLOSE, END = "### ", "</turn>\n", "</turn>"

#: A backslash at the end that takes what follows: one after an even number of them.
OPEN_ESCAPE = r"(?<!\\)(?:\\\\)*+\\\z"


def escape(text: Column) -> Column:
    """text with a backslash before each backslash and inside each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    out = F.replace(out, F.lit("</"), F.lit("<\\/"))
    return F.replace(out, F.lit(": "), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    """Takes back escape: each backslash goes, and the character behind it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, escaped: Column) -> Column:
    """The text of an array of structs (role, text); escaped: for each turn whether it is written with escapes."""

    def turn(t: Column, i: Column) -> Column:
        special = F.element_at(escaped, i + 1)
        role = F.when(special, escape(t["role"])).otherwise(t["role"])
        body = F.when(special, escape(t["text"])).otherwise(t["text"])
        return F.concat(F.lit(OPEN), role, F.lit(": "), body, F.lit(CLOSE))

    return F.array_join(F.transform(turns, turn), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation; a turn against the grammar is (null, null)."""
    pieces = F.split(formatted, END + "\n", -1)
    # what follows the last end of a turn is empty, or against the grammar
    pieces = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)

    def turn(p: Column) -> Column:
        at = F.instr(p, ": ")
        body = p.substr(at + 2, F.length(p))
        wrong = ~p.startswith(OPEN) | (at == 0) | (F.instr(p.substr(F.lit(5), F.length(p)), "###") > 0) | (F.instr(p, END) > 0)
        role = p.substr(F.lit(5), at - 5)
        # a backslash at the end would take the first character of what ends the role or the turn
        wrong = wrong | role.rlike(OPEN_ESCAPE) | body.rlike(OPEN_ESCAPE)
        return F.struct(F.when(~wrong, unescape(role)).alias("role"), F.when(~wrong, unescape(body)).alias("text"))

    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, formatted, turns (role, text, trained; read back from formatted), rounds, identical.

    Turns are ordered by turn number (null first), then role and text, so ties and repeated rows have one order. A null
    role or text is empty. Rows of null id form one conversation. `trained` on a turn marks its text for the
    loss. Other columns are left aside, whatever their names; an empty table gives an empty result.
    A conversation is one row of the result, so its turns do meet in one task.
    """
    turn = F.struct(F.col(turn_col).alias("at"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    talks = rows.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    talks = talks.select("id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("ts"))
    plain = F.transform("ts", lambda _: F.lit(False))
    talks = talks.withColumn("formatted", render(F.col("ts"), plain)).withColumn("back", parse(F.col("formatted")))
    # escape the turns that were not recovered: all, if there are more or fewer than there were
    conflict = F.when(F.size("ts") != F.size("back"), F.transform("ts", lambda _: F.lit(True))).otherwise(F.zip_with("ts", "back", lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))))
    same = F.col("ts").eqNullSafe(F.col("back"))
    talks = talks.withColumn("rounds", F.when(same, 1).otherwise(2))
    talks = talks.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(render(F.col("ts"), conflict)))
    talks = talks.withColumn("back", F.when(F.col("rounds") == 1, F.col("back")).otherwise(parse(F.col("formatted"))))
    loss = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.coalesce(t["role"].isin(*trained), F.lit(False)).alias("trained"))
    return talks.select(F.col("id").alias(id_col), "formatted", F.transform("back", loss).alias("turns"), "rounds", same.alias("identical"))


def digests(talks: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What is read back of each conversation, as counts and digests."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]), "")
    return talks.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The digests from the source itself. A turn is escaped if its plain form can't be read back.
SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT *, contains(role || text, '\') OR contains(role || ': ' || text, '###') OR contains(role || ': ' || text, '</turn>') OR contains(role || ':', ': ') AS conflict FROM c),
e AS (SELECT *, length(role) + length(text) + 14 + CASE WHEN conflict THEN (length(role || text) - length(replace(role || text, '\', ''))) + (length(role || text) - length(replace(role || text, '#', ''))) + (length(role || text) - length(replace(role || text, '</', ''))) // 2 + (length(role || text) - length(replace(role || text, ': ', ''))) // 2 ELSE 0 END AS chars FROM x)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

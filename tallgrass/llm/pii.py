"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers of a text. Beside them,
terms that give an entity away are found from the corpus itself: a term that keeps standing
next to one entity, in different surroundings, and elsewhere hardly, tells who is meant when the entity is masked. Its
disclosure is the pointwise mutual information of term and entity, over the information of the entity:

    log2(N * n(term, entity) / (n(term) * n(entity))) / log2(N / n(entity))

with counts of distinct texts: n(term, entity) of those in which the term stands within REACH words of the entity. It is 1 for a
term that is only found beside the entity, and 0 for one independent of it. Terms of a disclosure of at
least MIN_DISCLOSURE, seen beside the entity in at least MIN_CONTEXTS texts and different surroundings (so that copies of a document
count once), are masked in the documents that hold the entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import Written, checkpoint, sized

#: Words on either side of an entity that make its surroundings.
REACH = 4
#: Items that are folded at once.
CHUNK = 64
MIN_CONTEXTS, MIN_DISCLOSURE = 3, 0.6

#: Patterns of the entities (fixed values), in the order of kinds. Each begins where the leftmost match
#: can begin (behind the last match, or where no character before could take part), which spares long runs a new
#: try at each character; repeats that can't overlap what follows are possessive.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must be in a text for a pattern to match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

WORD = r"[\p{L}\p{N}]++"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3
        return F.forall(F.split(match, r"\."), lambda p: F.when(part(p), F.regexp_replace(p, "^0+(?=.)", "").cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once: inside a lambda an outer expression would be worked out for each element."""
    return F.aggregate(F.array(F.lit(0)), value, lambda v, _: v, body)


def running(items: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each item the int that add(int, item) has come to before it, from 0.

    By chunks: what a fold has so far is copied at each step, so it holds a chunk's ints, or one of each chunk.
    """
    last = lambda so_far: F.element_at(so_far, -1)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda k: F.slice(xs, k * CHUNK + 1, F.lit(CHUNK)))

    def within(chunks: Column, heads: Column) -> Column:
        each = lambda c, k: F.aggregate(c, F.array(F.get(heads, k)), lambda so_far, x: F.array_append(so_far, add(last(so_far), x)), lambda so_far: F.slice(so_far, F.lit(1), F.size(so_far) - 1))
        return F.flatten(F.transform(chunks, each))

    def chunked(chunks: Column) -> Column:
        heads = F.aggregate(chunks, F.array(F.lit(0)), lambda so_far, c: F.array_append(so_far, F.aggregate(c, last(so_far), add)))
        return let(heads, lambda h: within(chunks, h))

    return let(items, lambda xs: F.when(F.size(xs) > 0, let(cut(xs), chunked)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches the empty string: array of (start, end, match), in code points.

    The pieces between the matches and the matches themselves, put together, are the text.
    """
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(between, found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size"), m.alias("m"))), lambda x: x["m"].isNotNull())

    def place(xs: Column) -> Column:
        at = running(xs, lambda at, x: at + x["gap"] + x["size"])
        return F.zip_with(xs, at, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["m"].alias("match")))

    return let(pairs, place)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,match:string>>")


def _kind_spans(text: Column, rank: int, kind: str) -> Column:
    hint = F.contains(text, F.lit(HINTS[kind])) if kind == "email" else F.rlike(text, F.lit(HINTS[kind]))
    found = F.when(hint, located(text, PATTERNS[kind])).otherwise(_none())
    good = F.filter(found, lambda m: valid(kind, m["match"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["match"].alias("match")))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, match) of all entities, by start and then kind."""
    return F.sort_array(F.concat(*[_kind_spans(text, rank, kind) for rank, kind in enumerate(KINDS)]))


def stretches(spans: Column) -> Column:
    """Array of (start, end, kind) that covers the sorted spans, without overlaps; one that goes on from another has no kind."""
    reached = running(spans, lambda at, s: F.greatest(at, s["end"]))
    each = F.zip_with(spans, reached, lambda s, at: F.struct(F.greatest(at, s["start"]).alias("start"), s["end"].alias("end"), F.when(s["start"] >= at, s["kind"]).alias("kind")))
    return F.filter(each, lambda x: x["end"] > x["start"])


def _gap(parts: Column, x: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of what lies between a stretch, the i-th, and the one before."""
    start = F.coalesce(F.get(parts, i - 1)["end"], F.lit(0))
    return start, x["start"] - start


def free_words(text: Column, spans: Column) -> Column:
    """Array of (start, end, match) of the words that no span touches."""

    def cover(parts: Column) -> Column:
        # of each code point, whether a span holds it
        each = F.transform(parts, lambda x, i: F.concat(F.array_repeat(F.lit(False), _gap(parts, x, i)[1]), F.array_repeat(F.lit(True), x["end"] - x["start"])))
        return F.flatten(F.concat(each, F.array(F.array_repeat(F.lit(False), F.length(text)))))

    return let(let(stretches(spans), cover), lambda c: F.filter(located(text, WORD), lambda m: ~F.array_contains(F.slice(c, m["start"] + 1, m["end"] - m["start"]), F.lit(True))))


def surroundings(text: Column, spans: Column) -> Column:
    """Array of (entity, words) of the spans: the REACH words on either side that no span touches and that don't begin with a digit."""
    words = F.filter(free_words(text, spans), lambda m: ~m["match"].rlike("^[0-9]"))
    marks = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("span"), F.concat_ws(":", s["kind"], F.lower(s["match"])).alias("name")))
    terms = F.transform(words, lambda m: F.struct(m["start"].alias("at"), F.lit(0).alias("span"), F.lower(m["match"]).alias("name")))

    def around(all_: Column) -> Column:
        named = F.transform(F.filter(all_, lambda x: x["span"] == 0), lambda x: x["name"])
        # the place of a span among all, less the spans before it, is the number of words before it
        at = F.filter(F.transform(all_, lambda x, i: F.struct(x["span"].alias("span"), x["name"].alias("name"), i.alias("i"))), lambda x: x["span"] == 1)
        return let(named, lambda w: F.transform(at, lambda x, k: F.struct(x["name"].alias("entity"), _beside(w, x["i"] - k).alias("words"))))

    def _beside(w: Column, n: Column) -> Column:
        return F.concat(F.slice(w, F.greatest(n - REACH, F.lit(0)) + 1, F.least(n, F.lit(REACH))), F.slice(w, n + 1, F.lit(REACH)))

    return let(F.sort_array(F.concat(marks, terms)), around)


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """entity (kind:match) and term, of the terms that give the entity away.

    docs: columns text, spans and hash (of the text), all documents. Counts are of distinct texts, over all
    documents. A term's texts are those with the term as a word anywhere.
    """
    found = docs.where(F.size("spans") > 0)
    each = found.select(F.col("hash").alias("doc"), F.explode(surroundings(F.col("text"), F.col("spans"))).alias("s")).select("doc", "s.entity", "s.words").withColumn("context", F.xxhash64("words"))
    # a term of an entity stands in several texts and surroundings, so an entity of fewer has none
    pairs = each.select("entity", "doc", "context", F.explode(F.array_distinct("words")).alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("doc").alias("n_both")).where((F.col("contexts") >= MIN_CONTEXTS) & (F.col("n_both") >= MIN_CONTEXTS))
    pairs = checkpoint(pairs.select("entity", "term", "n_both"))
    n_pairs = pairs.count()
    if n_pairs == 0:
        return pairs.select("entity", "term")
    wanted = pairs.select("entity").distinct()
    held = found.select(F.col("hash").alias("doc"), F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["match"]))))).alias("entity"))
    entities = held.join(sized(wanted, n_pairs), "entity").groupBy("entity").agg(F.countDistinct("doc").alias("n_entity"))
    pairs = pairs.join(sized(entities, n_pairs), "entity")
    total = docs.agg(F.countDistinct("hash").alias("n")).first().n
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))

    def scored(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
        """pairs with the disclosure that term counts over texts give."""
        wanted = pairs.select("term").distinct()
        used = texts.select(F.col("hash").alias("doc"), F.explode(F.array_distinct(words)).alias("term")).join(sized(wanted, n), "term").groupBy("term").agg(F.countDistinct("doc").alias("n_term"))
        pmi = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
        of_entity = F.log2(F.lit(float(total)) / F.col("n_entity"))
        return pairs.join(sized(used, n), "term").where((of_entity > 0) & (pmi / of_entity >= MIN_DISCLOSURE)).select("entity", "term", "n_entity", "n_both")

    # a term is used at least as often as in the texts with entities: what fails already there (all common words) can't pass
    likely = checkpoint(scored(pairs, found, n_pairs))
    n_likely = likely.count()
    if n_likely == 0:
        return likely.select("entity", "term")
    return scored(likely, docs, n_likely).select("entity", "term")


def find_pii(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with columns <prefix>base_spans and <prefix>all_spans: arrays of (start, rank, end, kind, match).

    Code points, end exclusive. all_spans adds the disclosing terms of the entities that the text itself
    holds (kind `term`), wherever they stand in the text as words that no entity touches. A null or empty text has no spans. Rows repeated
    are rows of their own. All columns of docs stay; should one of them be called like a new one, give a prefix.
    An empty table gives an empty result. The rows with their base spans are written once in the
    shared folder, and the result reads them there. Texts are told apart by a 64-bit hash.
    """
    spans, everything, hash_ = f"{prefix}base_spans", f"{prefix}all_spans", f"{prefix}pii_hash"
    for c in (spans, everything, hash_):
        if c in docs.columns:
            raise ValueError(f"docs has a column {c}; give a prefix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = Written(docs.withColumn(spans, base_spans(text)).withColumn(hash_, F.xxhash64(text))).df
    terms = disclosing_terms(out.select(text.alias("text"), F.col(spans).alias("spans"), F.col(hash_).alias("hash")))
    # by entity: its terms; few, as each takes several surroundings of one entity
    by = checkpoint(terms.groupBy("entity").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    n_by = by.count()
    if n_by == 0:
        return out.withColumn(everything, F.col(spans)).drop(hash_)
    # by distinct text that holds such an entity: all terms to mask in it
    held = out.where(F.size(spans) > 0).select(F.col(hash_).alias("k"), F.explode(F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], F.lower(s["match"]))))).alias("entity"))
    mine = held.join(sized(by, n_by), "entity").select("k", F.explode("terms").alias("term")).groupBy("k").agg(F.collect_set("term").alias("terms"))
    mine = checkpoint(mine)
    # rows of a broadcast are reckoned by the characters of their terms
    room = mine.agg(F.count("*") + F.coalesce(F.sum(F.length(F.array_join("terms", " "))), F.lit(0)) / 16).first()[0]
    out = out.join(sized(mine, int(room)), out[hash_] == mine["k"], "left")
    rank = len(KINDS)
    words = F.filter(free_words(text, F.col(spans)), lambda m: F.array_contains(F.col("terms"), F.lower(m["match"])))
    own = F.transform(words, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit("term").alias("kind"), m["match"].alias("match")))
    return out.withColumn(everything, F.when(F.col("terms").isNull(), F.col(spans)).otherwise(F.sort_array(F.concat(F.col(spans), own)))).drop(hash_, "k", "terms")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each stretch that spans cover generalised to the placeholder of its first span."""
    names = F.create_map(*[F.lit(x) for p in PLACEHOLDER.items() for x in p])

    def build(chars: Column) -> Column:
        def piece(parts: Column, x: Column, i: Column) -> Column:
            start, size = _gap(parts, x, i)
            return F.concat(F.array_join(F.slice(chars, start + 1, size), ""), F.coalesce(F.element_at(names, x["kind"]), F.lit("")))

        # a last, empty stretch takes what is left
        end = F.struct(F.size(chars).alias("start"), F.size(chars).alias("end"), F.lit(None).cast("string").alias("kind"))
        return F.array_join(let(F.concat(stretches(spans), F.array(end)), lambda parts: F.transform(parts, lambda x, i: piece(parts, x, i))), "")

    return F.when(F.size(spans) > 0, let(F.split(text, "", -1), build)).otherwise(text)


def sanitize(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with entities and disclosing terms in the text generalised to placeholders; other texts stay as they are."""
    found = find_pii(docs, text_col, "pii_")
    return found.withColumn(text_col, masked(F.col(text_col), F.col("pii_all_spans"))).select(*docs.columns)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find_pii(docs.select(id_col, text_col), text_col, "pii_")
    counts = []
    for kind in KINDS:
        counts.append(F.size(F.filter("pii_base_spans", _is_kind(kind))).cast("long").alias(f"n_{kind}"))
    return found.select(id_col, *counts, F.sha2(joined(F.col("pii_base_spans")), 256).alias("base_sha256"), joined(F.col("pii_all_spans")).alias("spans"))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind

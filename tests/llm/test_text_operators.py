"""Operators on texts against brute force, and their defined results for odd inputs."""

import hashlib
import math
import pickle
import random
import re
import textwrap
import time
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import chat, language, license, mixing, pii, toxicity
from tallgrass.llm.components import connected_components
from tallgrass.llm.decontaminate import Matcher, find_contamination, remove_contamination
from tallgrass.llm.language import predict_language
from tallgrass.llm.ngram_join import _postings, _sketch, ngram_jaccard_components
from tallgrass.llm.session import CLEANUP, Written
from tallgrass.llm.toxicity import score_toxicity

ODD = [None, "", " ", "one", "x" * 50_000, "a b " * 20_000, "é ß 😀", "\\", "</turn>", "\x00"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, component_id string, size string, key string"


def odd(spark):
    """Nulls in every column, odd texts, repeated rows and columns called like results."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else f"s{i}", None, 0.5, "x", "y", "z", "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, *rows[:2], (None, "one", "en", "s0", 1, None, None, None, None, None)], DOCS)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- n-gram Jaccard join ---


def jaccard_brute(rows, n, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_is_brute_force(spark, n, percent):
    r = random.Random(n)
    base = [[f"w{r.randint(0, 60)}" for _ in range(r.randint(1, 90))] for _ in range(30)]
    rows = []
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(400, None), (401, ""), (402, "  "), (403, "One"), (404, "oNE")]
    got = ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent)
    assert sorted(map(tuple, got.collect())) == jaccard_brute(rows, n, percent)


def test_ngram_join_odd_rows(spark):
    got = {r.doc_id: r for r in ngram_jaccard_components(odd(spark)).collect() if r.doc_id is not None}
    assert got[0].n_shingles == got[1].n_shingles == got[2].n_shingles == 0
    assert [got[i].component_id for i in (0, 1, 3)] == [0, 1, 3]
    assert ngram_jaccard_components(odd(spark)).count() == odd(spark).count()
    assert ngram_jaccard_components(odd(spark).limit(0)).count() == 0


def test_repeated_rows_and_large_groups_do_not_multiply(spark):
    x = [f"x{i}" for i in range(60)]
    # two near copies of 3,000 rows each, under two ids and without one, and 1,200 near copies of one another
    rows = [(r, " ".join(x)) for r in (7, 7, 7, None) for _ in range(750)] + [(r, " ".join(x[:-1] + ["y"])) for r in (3, 7, 9, None) for _ in range(750)]
    z = [f"z{i}" for i in range(60)]
    rows += [(100 + k, " ".join(z[:59] + [f"end{k}"])) for k in range(1200)] + [(None, "alone"), (None, "alone"), (5000, "x0 x1 x2 x3 x4")]
    got = ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).groupBy("doc_id", "n_shingles", "component_id").count()
    want = {(7, 57, 3): 3000, (3, 57, 3): 750, (9, 57, 3): 750, (None, 57, 3): 1500, (None, 1, None): 2, (5000, 2, 5000): 1} | {(100 + k, 57, 100): 1 for k in range(1200)}
    assert {tuple(r)[:3]: r[3] for r in got.collect()} == want


def test_dealing_out_is_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr("tallgrass.llm.ngram_join.PART", 2)
    monkeypatch.setattr("tallgrass.llm.ngram_join.BROADCAST_ROWS", 0)
    monkeypatch.setattr("tallgrass.llm.components.SMALL", 0)
    monkeypatch.setattr("tallgrass.llm.components.PART", 2)
    r = random.Random(5)
    base = [[f"w{r.randint(0, 30)}" for _ in range(40)] for _ in range(8)]
    rows = []
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 4)}"
        rows.append((i, " ".join(w)))
    got = ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == jaccard_brute(rows, 4, 85)


def stages(spark):
    """Shuffle records written, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {x.stageId(): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}


def test_prefix_entries_are_shuffled_once_and_not_written(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(400))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    entries = _postings(docs, "text", 4, 85, _sketch(docs, "text", 4)).count()
    written = []

    class Noted(Written):
        def __init__(self, df):
            super().__init__(df)
            written.append(self.df.count())

    monkeypatch.setattr("tallgrass.llm.ngram_join.Written", Noted)
    last = max(stages(spark))
    got = ngram_jaccard_components(docs).collect()
    assert sorted(map(tuple, got)) == [(i, 397, i) for i in range(300)]
    records = sum(n for k, n in stages(spark).items() if k > last)
    assert entries > 15_000
    assert entries <= records < 1.6 * entries
    assert sum(written) < 0.01 * entries


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles()
        return {x for x in (found.apply(i).getName() for i in range(found.size())) if x.startswith("shuffle_")}

    chosen, before = spark.conf.get(CLEANUP, None), shuffles()
    table = Written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):  # they are deleted in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP, None) == chosen
    assert table.df.agg(F.count("*"), F.sum("count")).first() == (10, 1000)
    table.drop()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (1, 5), (None, 2)], "u long, v long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]


# --- decontamination ---


def contamination_brute(docs, items, span):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = {}
    for name, t in items:
        w = word(t)
        k = min(span, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(name)
    for i, t in docs:
        w, hit, found = word(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                names = windows.get(tuple(w[a : a + k]))
                if names:
                    hit |= set(range(a, a + k))
                    found |= names
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sorted(hit)


def test_decontamination_is_brute_force(spark):
    r = random.Random(4)
    for voc in (2, 3, 5):
        text = lambda n: "".join(r.choice("abCéd"[:voc]) + r.choice([" ", "-", "\n"]) for _ in range(n))  # noqa: E731, B023
        items = [(str(i), text(r.randint(0, 9))) for i in range(6)] + [("n", None)]
        docs = [(i, r.choice([None, "", text(r.randint(0, 50)), text(5) + "zz " + text(9)])) for i in range(80)]
        found = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), span=4)
        got = [(x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, [k for s in x.hit_spans for k in range(s.start, s.end)]) for x in found.orderBy("doc_id").collect()]
        assert got == list(contamination_brute(docs, items, 4))


@pytest.mark.parametrize("span", [1, 2, 6])
def test_automaton_is_brute_force_after_being_sent(span):
    r = random.Random(span)
    for voc in (2, 3, 5):
        text = lambda n: "".join(r.choice("abCéd"[:voc]) + r.choice([" ", "-", "\n"]) for _ in range(n))  # noqa: E731, B023
        items = [(str(i), text(r.randint(0, 9))) for i in range(6)] + [("n", None)]
        docs = [(i, r.choice(["", text(r.randint(0, 50)), text(5) + "zz " + text(9)])) for i in range(40)]
        sent = pickle.loads(pickle.dumps(Matcher(items, span)))
        rows = sent.rows(pa.array([t for _, t in docs]))
        got = [(n, [k for s in spans for k in range(*s)], len(names)) for n, _, spans, _, names in rows]
        assert got == [(x[1], x[5], x[3]) for x in contamination_brute(docs, items, span)]


def test_decontamination_removes_spans_only(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id long, text string")
    passage = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"before {passage} after " + "more " * 30), (2, passage), (3, None), (4, "clean text")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in remove_contamination(docs, items).collect()}
    assert got == {1: "before  after " + "more " * 30, 3: None, 4: "clean text"}
    assert find_contamination(odd(spark), items).count() == odd(spark).count()
    assert find_contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


# --- chat ---


def test_chat_round_trip_of_hostile_texts(spark):
    r = random.Random(9)
    parts = ["### ", "</turn>", "\n", "\\", ": ", "assistant", "user", "#", "<\\/turn>", "é😀", " ", "<", "/turn>"]
    rows = [(c, t, r.choice(["user", "assistant", "a: b", "", None, "### x"]), r.choice([None, "", "".join(r.choice(parts) for _ in range(r.randint(0, 12)))])) for c in range(150) for t in range(r.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    talks = chat.format_conversations(df)
    assert talks.where("not identical").count() == 0
    assert {x.rounds for x in talks.select("rounds").distinct().collect()} == {1, 2}
    for x in chat.digests(talks).collect():
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == x.conv_id)
        assert x.n_turns == len(turns)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_turns_that_end_in_a_backslash_are_escaped(spark):
    """By the grammar a backslash takes the next character, so a plain text must not end in one."""
    df = spark.createDataFrame([(1, 0, "user", "a\\"), (2, 0, "user", "a\\\\"), (3, 0, "us\\", "a"), (4, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert got == {1: "### user: a\\\\</turn>\n", 2: "### user: a\\\\\\\\</turn>\n", 3: "### us\\\\: a</turn>\n", 4: "### user: a</turn>\n"}
    assert chat.format_conversations(df).where("not identical").count() == 0


def test_chat_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (None, 0, "user", "x"), (2, 0, "user", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_conversations(df).collect()}
    assert got[1] == [("", ""), ("user", "a"), ("user", "b")]
    assert set(got) == {1, 2, None}
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- personal data ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_base_spans_are_brute_force(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("a@.b-1 2+4(5)%_9é😀") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += [*ODD, "1" * 30_000, "1 " * 20_000, "a" * 30_000 + "@b.c", "+" + "1 " * 20_000, "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+1(234)5678901 x@y.z_q@r.s", "a@b.c " * 500, "001.002.003.004", "256.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.digests(df).collect():
        want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in pii_brute(texts[x.doc_id]))
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert x.spans == want


def test_pii_adds_terms_that_give_an_entity_away(spark):
    told = [(i, f"lorem w{i} x{i} nemo the nemo@sea.org and v{i} t{i} end") for i in range(5)]
    other = [(100 + i, f"word{i} the text {i} and more end") for i in range(60)]
    df = spark.createDataFrame(told + other, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert got[3] == "lorem w3 x3 [TERM] the [EMAIL] and v3 t3 end"
    assert got[107] == "word7 the text 7 and more end"
    assert pii.sanitize(odd(spark)).columns == odd(spark).columns
    assert pii.sanitize(odd(spark).limit(0)).count() == 0


def test_pii_terms_do_not_hide_behind_copies(spark):
    told = [f"lorem w{i} x{i} nemo the nemo@sea.org and v{i} t{i} end" for i in range(3)]
    other = [f"word{i} the text {i} and more end" for i in range(60)]
    for texts in (told + other + told[:1] * 300, told + other + other[:1] * 300):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
        assert {got[i] for i, t in enumerate(texts) if t == told[0]} == {"lorem w0 x0 [TERM] the [EMAIL] and v0 t0 end"}
        assert got[10] == "word7 the text 7 and more end"


def pii_terms_brute(texts):
    """The term spans of each text: counts of distinct texts, surroundings and disclosure by the definition."""
    word = re.compile(r"(?:(?!_)\w)+")  # the texts of the test have letters, digits and no other word characters
    near, contexts, have, use, place = {}, {}, {}, {}, {}
    for t in set(texts):
        spans = [(s, e, f"{k}:{t[s:e].lower()}") for s, _, e, k in pii_brute(t)]
        covered = {k for s, e, _ in spans for k in range(s, e)}
        free = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(t) if covered.isdisjoint(range(m.start(), m.end()))]
        place[t] = spans, free
        for w in {m[0].lower() for m in word.finditer(t)}:
            use.setdefault(w, set()).add(t)
        named = [f for f in free if not f[2][0].isdigit()]
        starts = [f[0] for f in named]
        for s, _, name in spans:
            have.setdefault(name, set()).add(t)
            at = bisect_left(starts, s)
            around = [f[2] for f in named[max(0, at - pii.REACH) : at + pii.REACH]]
            for w in set(around):
                near.setdefault((name, w), set()).add(t)
                contexts.setdefault((name, w), set()).add(tuple(around))
    n, told = len(set(texts)), {}
    for (name, w), both in near.items():
        if len(both) >= pii.MIN_CONTEXTS and len(contexts[name, w]) >= pii.MIN_CONTEXTS and n > len(have[name]):
            if math.log2(n * len(both) / len(use[w]) / len(have[name])) / math.log2(n / len(have[name])) >= pii.MIN_DISCLOSURE:
                told.setdefault(name, set()).add(w)
    for t in texts:
        spans, free = place[t]
        terms = {w for _, _, name in spans for w in told.get(name, ())}
        base = [(s, r, e, k) for s, r, e, k in pii_brute(t)]
        yield ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base + [(s, 4, e, "term") for s, e, w in free if w in terms]))


def test_pii_terms_are_brute_force(spark):
    r = random.Random(8)
    entities = ["ann@sea.org", "bob@sky.net", "+49 30 1234567", "10.1.2.3", "4111 1111 1111 1111"]
    tells = {"ann@sea.org": "Captain", "+49 30 1234567": "élodie", "10.1.2.3": "gateway"}
    texts = []
    for _ in range(220):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 25))]
        for e in r.sample(entities, r.choice([0, 0, 1, 2])):
            at = r.randint(0, len(words))
            words[at:at] = r.choice([[tells.get(e, "the"), e], [e, "x", tells.get(e, "and").upper()], [f"{tells.get(e, 'a')}{e}"], [f"{e}é", "7up"]])
        texts.append(r.choice([" ", ", ", "\n"]).join(words))
    texts += texts[:40] + ["", "captain of élodie"]
    # a text of 20,000 words with terms and entities throughout, and one of entities alone
    texts += ["Captain w1 ann@sea.org 12 " * 5_000, "ann@sea.org,Captain." * 3_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = list(pii_terms_brute(texts))
    got = {x.doc_id: x.spans for x in pii.digests(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum("term" in x for x in want) > 20
    whole = {x.doc_id: x.text for x in pii.sanitize(df).collect()}
    assert whole[len(texts) - 2] == "[TERM] w1 [EMAIL] 12 " * 5_000


def test_pii_of_long_texts_takes_time_in_proportion(spark):
    df = spark.createDataFrame([("nemo mail nemo@sea.org ipsum " * 30_000,)], "text string").withColumn("spans", pii.base_spans(F.col("text")))
    words, name = pii.free_words(F.col("text"), F.col("spans")), pii.masked(F.col("text"), F.col("spans"))
    began = time.monotonic()
    got = df.select(F.size("spans").alias("n"), F.size(words).alias("words"), F.length(name).alias("size")).first()
    assert (got.n, got.words, got.size) == (30_000, 90_000, 30_000 * len("nemo mail [EMAIL] ipsum "))
    assert time.monotonic() - began < 60


# --- mixing ---


def test_mixing_budgets(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["b", "a", "a", "a", None, ""])) for i in range(400)] + [(500, None, "empty"), (501, "x " * 3000, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("clash"))
    got = mixing.mix_sources(df).toPandas()
    total = got["size"].sum()
    assert len(got) == len(rows)
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert g.taken.sum() == int(g.target.iloc[0])
        assert g.target.iloc[0] <= 2 * g["size"].sum()
        assert sorted(g["start"].tolist())[0] == 0
    assert abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * total) < 1e-6 * total
    again = mixing.mix_sources(df.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))


def test_mixing_of_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rows = [(None, "w w w", "a")] * 900 + [(7, "x y", "a")] * 300 + [(i, "v " * (i % 9), "ab"[i % 2]) for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df.repartition(5)).toPandas()
    assert len(got) == len(rows)
    assert sorted(map(str, got.doc_id.dropna().astype(int))) == sorted(str(i) for i, _, _ in rows if i is not None)
    for _, g in got.groupby("source"):
        assert g.taken.sum() == int(g.target.iloc[0])
        # the documents stand one behind another
        at = g[g["size"] > 0].sort_values("start")
        assert (at["start"].to_numpy() == (at["size"].cumsum() - at["size"]).to_numpy()).all()


def test_mixing_odd_rows(spark):
    assert mixing.mix_sources(odd(spark)).count() == odd(spark).count()
    assert mixing.mix_sources(odd(spark).limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix_sources(nothing).collect()} == {0}


# --- toxicity and language ---


@pytest.mark.parametrize("toxic", [lambda a, b: a and b, lambda a, b: a != b], ids=["and", "xor"])
def test_toxicity_learns_pairs(spark, toxic):
    """Insult and group together, or one without the other: no additive weight can tell the second at all."""
    r = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [r.choice(["tree", "river", "stone", "cloud", "grass"]) + str(r.randint(0, 30)) for _ in range(15)] + ["rotter"] * a + ["islanders"] * b
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic(a, b))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 4 != 2).toPandas().set_index("doc_id").score
    held = [i for i in range(1200) if i % 4 == 2]
    assert sum((scored[i] >= 0.3) == bool(labels[i][1]) for i in held) >= 0.97 * len(held)


def test_toxicity_scores_are_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["rotter", "fine", "Weather", "islanders", "straße", "sun", "a"]) + r.choice(["", "s", "ing"]) for _ in range(r.randint(0, 12)))) for i in range(150)] + [(200, None), (201, "rotter " * 3000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int("rotter" in t)) for i, t in rows[:150]], "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels, "doc_id", "text", "toxic", F.lit(True))

    def bucket(b):
        x = np.frombuffer(b, np.uint8)
        return int(toxicity.span_hash(toxicity.prefix_hash(x), np.array([0]), np.array([len(x)]))[0]) >> (64 - toxicity.BITS)

    got = {x.doc_id: x.score for x in score_toxicity(docs, labels, F.lit(True)).collect()}
    for i, t in rows:
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))]
        terms = {machine.number[bucket(x)] for w in words for x in [w] + [w[:k] for k in (4, 5) if len(w) > k]} - {-1}
        z = machine.bias + sum(machine.weight[k] for k in terms)
        z += sum(float(machine.factor[j] @ machine.factor[k]) for j in terms for k in terms if j < k)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
    assert got[201] > 0.9 > 0.3 > min(got[i] for i, _ in rows[:150])


def test_toxicity_learns_from_one_text_of_a_sampled_label(spark):
    docs = spark.createDataFrame([(1, f"rotter number {k}") for k in range(500)] + [(i, "rotter") for i in range(2, 40)] + [(i, "fine") for i in range(40, 90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(1, 90)] * 3, "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels, "doc_id", "text", "toxic", F.lit(True), max_sample=60)
    # "number" stands in 500 rows of one id, so in one sampled row at most
    assert (machine.number >= 0).sum() <= 4
    scored = {(x.doc_id, x.score >= 0.3) for x in score_toxicity(docs, labels, F.lit(True)).collect()}
    assert scored == {(i, i < 40) for i in range(1, 90)}


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, None), (3, 0), (None, 1), (4, 7)], "doc_id long, toxic int")
    got = score_toxicity(odd(spark), labels, F.lit(True)).collect()
    assert len(got) == odd(spark).count()
    assert all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(odd(spark), labels.limit(0), F.lit(True)).count() == len(got)
    assert score_toxicity(odd(spark).limit(0), labels, F.lit(True)).count() == 0


def test_language_of_held_out_texts(spark):
    r = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ö"], "cc": ["ção", "nh", "ei", "as"]}
    rows = [(i, lang, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randint(2, 30)))) for i in range(300) for lang in [r.choice(list(parts))]]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {x.doc_id: x for x in predict_language(df, F.col("doc_id") % 3 != 1).collect()}
    assert all(got[i].lang_pred == lang for i, lang, _ in rows)
    odd_ = {x.doc_id: x for x in predict_language(odd(spark), F.lit(True)).collect()}
    assert [odd_[i].lang_pred for i in (0, 1, 2, 7)] == ["und"] * 4
    assert odd_[3].lang_pred == "en"
    assert predict_language(odd(spark).limit(0), F.lit(True)).count() == 0
    assert {x.lang_pred for x in predict_language(odd(spark), F.lit(False)).collect()} == {"und"}


def language_brute(rows, learnt):
    """The posterior of each language, from Python counts of n-grams by bucket."""

    def buckets(t):
        t = "".join(c.lower() if ord(c) < 0x10000 and len(c.lower()) == 1 else c for c in t)
        for n in (1, 2, 3):
            for k in range(len(t) - n + 1):
                key = 0
                for c in t[k : k + n]:
                    key = key << 21 | ord(c)
                x = (key + (n << 57)) * 0x9E3779B97F4A7C15 % 2**64
                x ^= x >> 29
                yield x * 0xBF58476D1CE4E5B9 % 2**64 >> (64 - language.BITS)

    counts = {}
    for _, lang, t in learnt:
        c = counts.setdefault(lang, {})
        for x in buckets(t):
            c[x] = c.get(x, 0) + 1
    whole = {lang: sum(c.values()) + language.SMOOTHING * language.BUCKETS for lang, c in counts.items()}
    for i, _, t in rows:
        z = {lang: sum(math.log((c.get(x, 0) + language.SMOOTHING) / whole[lang]) for x in buckets(t)) for lang, c in counts.items()}
        best = max(sorted(z), key=z.get)
        yield i, best, 1 / sum(math.exp(v - z[best]) for v in z.values())


def test_language_scores_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 1)
    r = random.Random(11)
    rows = [(i, r.choice(["xx", "yy", "zz"]), "".join(r.choice("aÄbß𝔘 cД") for _ in range(r.randint(1, 12))) + "a") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    got = {x.doc_id: (x.lang_pred, x.score) for x in predict_language(df, F.col("doc_id") % 3 != 1).collect()}
    for i, best, score in language_brute(rows, [x for x in rows if x[0] % 3 != 1]):
        assert got[i][0] == best and abs(got[i][1] - score) < 1e-4


# --- licences ---


def test_license_rules():
    name = lambda t: [x[0] for x in license.match_rules(license.sentence_ids(t))]
    assert name("Released under the MIT License.") == ["MIT"]
    assert name("Text. Licensed under the Apache License, Version 2.0.\nmore") == ["Apache-2.0"]
    assert name("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0-only"]
    assert name("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert name("SPDX-License-Identifier: BSD-3-Clause") == ["SPDX:BSD-3-CLAUSE"]
    assert name("# Copyright 2020 X. All rights reserved.") == ["All-Rights-Reserved"]
    assert name("You may not use this file except in compliance with the License.") == ["unmatched"]
    assert name("A licence to kill, with permission of the author.") == []


def test_license_scan_odd_rows(spark):
    got = license.scan_licenses(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    assert all(r.licenses == [] for r in got)
    assert license.scan_licenses(odd(spark).limit(0)).count() == 0


AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY AND
NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, ARISING FROM THE SOFTWARE."""
WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

""" + AS_IS,
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.

""" + AS_IS,
    "GPL-3.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
}


@pytest.mark.parametrize("name", WRAPPED)
@pytest.mark.parametrize(("mark", "feed"), [("", "\n"), (" * ", "\n"), ("# ", "\r\n")])
def test_wrapped_license_texts_are_one_span(name, mark, feed):
    notice = feed.join(mark + x for x in WRAPPED[name].split("\n"))
    text = f"some words{feed}{feed}é {feed}{notice}{feed}{feed}more words"
    ((got, start, end),) = license.match_rules(license.sentence_ids(text))
    assert got == name
    assert start == text.index(notice.lstrip(" "))
    assert end == text.index(notice) + len(notice)


def test_every_sentence_of_a_wrapped_license_is_found():
    ids = lambda t: [x[0] for x in license.sentence_ids(t)]
    assert ids(WRAPPED["MIT"]) == ["mit_grant", "mit_notice", "as_is", "no_liability"]
    assert ids(WRAPPED["BSD-3-Clause"]) == ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "as_is", "no_liability"]
    assert ids(WRAPPED["GPL-3.0-or-later"]) == ["gpl_free", "gpl_hope", "gpl_see"]
    assert ids(WRAPPED["Apache-2.0"]) == ["apache_name", "apache_copy", "apache_obtain", "apache_as_is", "apache_see"]


def test_license_names_with_a_lead_and_between_other_lines():
    name = lambda t: [x[0] for x in license.match_rules(license.sentence_ids(t))]
    assert name("This software is released under the MIT License.") == ["MIT"]
    assert name("This library is distributed under the terms of the\nnew BSD license.") == ["BSD"]
    assert name("a heading\nLicensed under CC BY 4.0\nand a line") == ["CC-BY-4.0"]
    # no wildcard takes a line that is a known sentence
    assert name("Copyright 2020 X\nReleased under the MIT License\nAll rights reserved") == ["MIT", "All-Rights-Reserved"]
    assert name("The software is provided as is\nand so on\n" + WRAPPED["MIT"]) == ["unmatched", "MIT"]


NOTICES = {
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

(1) Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer.

(2) Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "CC-BY-SA-4.0": """This work is licensed under a Creative Commons BY-SA 4.0
International License.""",
}


@pytest.mark.parametrize("name", NOTICES)
@pytest.mark.parametrize("mark", ["", " * ", "// "])
def test_more_notices_are_one_span(name, mark):
    whole = re.sub(r"\n(?!\n)", " ", NOTICES[name].replace("\n\n", "\x00")).replace("\x00", "\n\n")
    for notice in (NOTICES[name], whole):
        text = "some words\n\n" + "\n".join(mark + x for x in notice.split("\n")) + "\n\nmore"
        assert [x[0] for x in license.match_rules(license.sentence_ids(text))] == [name]


@pytest.mark.parametrize("width", [30, 72, 100_000])
def test_every_fixed_sentence_and_name_is_known(width):
    for id_, sentence in license.FIXED.items():
        text = textwrap.fill(sentence.capitalize() + ".", width)
        assert [x[0] for x in license.sentence_ids(f"before\n{text}\nbehind")] == [id_]
    for of, names in license.NAMES_OF.items():
        for x in names:
            for text in (f"This library is licensed under the {x.title()} license.", f"The {x} License"):
                assert [r[0] for r in license.match_rules(license.sentence_ids(textwrap.fill(text, width)))] == [of]
    assert len(license.NAMES_OF) + 12 >= 40


def test_license_rules_are_brute_force():
    """Of each rule every sequence it allows, tried by itself at each place."""
    r = random.Random(4)
    ids = sorted({want.rstrip("?").partition("=")[0] for _, rule in license.RULES for want in rule})
    for _ in range(400):
        found = [(r.choice(ids), {}, 10 * k, 10 * k + 9) for k in range(r.randint(0, 9))]
        if r.random() < 0.7:
            rule = r.choice(license.RULES)[1]
            found[:0] = [(w.rstrip("?").partition("=")[0], {}, -100 + 10 * k, -91 + 10 * k) for k, w in enumerate(x for x in rule if not x.endswith("?") or r.random() < 0.5)]
        names = [f[0] for f in found]
        want, i = [], 0
        while i < len(names):
            for _, rule in license.RULES:
                # a greedy run: of the sequences that match, the first in order of taking optional sentences
                options = [[]]
                for w in rule:
                    id_ = w.rstrip("?")
                    options = [o + [id_] for o in options if "=" not in id_] + ([o for o in options] if w.endswith("?") else [])
                fits = [o for o in options if o and names[i : i + len(o)] == o]
                if fits:
                    want.append((found[i][2], found[i + max(map(len, fits)) - 1][3]))
                    i += max(map(len, fits))
                    break
            else:
                want.append((found[i][2], found[i][3]))
                i += 1
        assert [x[1:] for x in license.match_rules(found)] == want


def test_a_long_line_and_many_openings_take_time_in_proportion():
    began = time.monotonic()
    license.sentence_ids("licensed under the " + "very long line " * 100_000)
    license.sentence_ids("The software is provided as is\n" * 5_000)
    license.sentence_ids("Permission is hereby granted, free of charge, to any person\n" * 5_000)
    assert time.monotonic() - began < 20

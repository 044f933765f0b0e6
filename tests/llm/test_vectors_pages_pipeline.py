"""Vectors and pages against brute force; the pipeline against its stages done by hand."""

import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ascii_lower, contamination_brute, jaccard_brute, pii_terms_brute

import corpus_pipeline
from tallgrass.llm import html_extract as h
from tallgrass.llm import mixing, pii
from tallgrass.llm.embedding_dedup import near_duplicate_vectors, plan
from tallgrass.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"


def vectors(seed=0, n=400, d=16):
    """Random vectors, near copies at all distances, exact copies and scaled ones."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(n // 2, n):
        k = r.integers(0, n // 2)
        x[i] = x[k] * r.choice([1.0, 3.0]) + r.normal(size=d) * r.choice([0, 0.02, 0.1, 0.2])
    return x


def test_near_duplicate_vectors_find_the_links(spark):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = link.sum(1)
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= want).all()
    assert have.sum() >= 0.99 * want.sum()
    for i in range(len(x)):
        assert got[i].kept == (got[i].component_id == i)
        assert got[i].component_id <= i


def test_a_large_bucket_is_compared_whole(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=8) + r.normal(size=(700, 8)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    got = near_duplicate_vectors(df).collect()
    assert sum(x.n_links for x in got) >= 0.999 * (link.sum() - 700)
    assert {x.component_id for x in got} == {0}


def test_many_copies_of_one_vector_and_of_none(spark):
    rows = [(i, [1.0, 2.0]) for i in range(1500)] + [(9000 + i, None) for i in range(1500)] + [(5000, [2.0, 1.0]), (5001, [2.0, 1.0001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect()}
    want = {i: (1499, 0, i == 0) for i in range(1500)} | {9000 + i: (0, 9000 + i, True) for i in range(1500)} | {5000: (1, 5000, True), 5001: (1, 5000, False)}
    assert got == want


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10, None)]
    assert got == sorted([*alone, (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False)], key=str)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_plan_grows_slowly():
    assert plan(10**4, 0.95, 0.99)[0] < plan(10**9, 0.95, 0.99)[0] < 35


# --- pages ---


def test_model_on_held_out_layouts():
    model = h.default_model()
    right = total = 0
    for nodes, label in h.labelled_pages(60, seed=99):
        own, feats, parent, kind = h.features(nodes)
        on = model.marginals(feats, parent, kind)
        for i, p in zip(own, on, strict=True):
            if nodes[i].text is not None:
                right += (p >= 0.5) == label[i]
                total += 1
    assert right >= 0.97 * total


def test_marginals_are_those_of_enumeration():
    r = np.random.default_rng(3)
    parent, kind = np.array([-1, 0, 0, 1, 1]), np.array([1, 1, 2, 0, 0])
    feats = [(0,), (1,), (2,), (3,), (4,)]
    model = h.Model(r.normal(size=h.N_FEATURES), r.normal(size=(h.N_KINDS, 2, 2)))
    total, on = 0.0, np.zeros(5)
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        s = np.exp(sum(model.weight[i] * y[i] for i in range(5)) + sum(model.pair[kind[i], y[parent[i]], y[i]] for i in range(1, 5)))
        total += s
        on += s * np.array(y)
    assert np.allclose(model.marginals(feats, parent, kind), on / total)
    # the same by levels, of several trees at once
    forest = h._Forest([(feats, parent, kind), (feats[:3], parent[:3], kind[:3])])
    assert np.allclose(forest.marginals(model.weight, model.pair)[0], [*(on / total), *model.marginals(feats[:3], parent[:3], kind[:3])])


def test_main_text_of_broken_and_odd_pages(spark):
    page = "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>Title here</h1><p><b>First &lt;bold&gt; text\n with  space.<br><p>Second paragraph &eacute;&#8212;end.</p></article><footer>&copy; site</footer>"
    text = "Title here\nFirst <bold> text with space.\nSecond paragraph é—end."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<<>>> <p"), (5, "u", "<div>" * 3000), (1, "u", page), (None, "u", "&amp;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = h.extract_main_text(df).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id == 1] == [text, text]
    assert [r.text for r in got if r.page_id in (2, 3, 5)] == ["", "", ""]
    assert all(r.n_chars == len(r.text) for r in got)
    assert h.extract_main_text(df.limit(0)).count() == 0


#: Pages written by hand, in layouts that differ from those of labelled_pages, and their main text.
P1, P2, P3 = "The river rose by two metres overnight, the council said.", "Volunteers filled sandbags until dawn. Nobody was hurt.", "Schools stay closed on Monday."
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"{P1}\n{P2}\n{P3}"
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a></nav>'
FOOT = "<footer><p>Copyright 2024 Example Press. All rights reserved.</p></footer>"
SAID = '<div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I saw it from my window, it was frightening.</p></div><div class="comment"><b>Bo</b><p>Glad all are safe.</p></div></div>'
LAYOUTS = [
    (f"{NAV}<article><p>Hello there. This is text.</p></article>", "Hello there. This is text."),
    (f"<div class='post'><p>{P1}</p><p>{P2}</p></div>{SAID}", f"{P1}\n{P2}"),
    (f"<div class='post'><p>Short one.</p><p>And two.</p></div>{SAID}", "Short one.\nAnd two."),
    (f"<html><body>{NAV}<div id='content'><h1>Flood</h1>{BODY}</div>{FOOT}</body></html>", f"Flood\n{TEXT}"),
    (f"<html><body><div class='container'><div class='header'><a href='/'>Example Press</a></div><div class='entry-content'>{BODY}</div><div class='sidebar'><h3>Related</h3><ul><li><a href='/a'>Storm warning</a></li><li><a href='/b'>Road works</a></li></ul></div></div>{FOOT}</body></html>", TEXT),
    (f"<html><body><main><h1>Flood</h1>{BODY}</main><aside><p>Subscribe to our paper today.</p></aside></body></html>", f"Flood\n{TEXT}"),
    (f"<body><table><tr><td class='menu'><a href='/1'>One</a><br><a href='/2'>Two</a></td><td class='story'>{BODY}</td></tr></table></body>", TEXT),
    (f"<html><body><div class='cookie-banner'>We use cookies to improve this site. <button>Accept</button></div>{NAV}<article><h1>Flood</h1>{BODY}</article></body></html>", f"Flood\n{TEXT}"),
    (f"<html><body>{NAV}<article><h1>Flood</h1><p>{P1}</p><div class='ad'>Buy one, get one free at Shop.</div><p>{P2}</p></article></body></html>", f"Flood\n{P1}\n{P2}"),
    (f"<html><body><article><h2>Steps</h2><ul><li>Fill the bags.</li><li>Stack them by the door.</li></ul><p>{P3}</p></article>{SAID}</body></html>", f"Steps\nFill the bags.\nStack them by the door.\n{P3}"),
    (f"<html><body><div id='main'><div class='blog-post'><h1>Flood</h1>{BODY}</div><div id='respond'><form><label>Your name</label><input><p>Leave a reply below.</p></form></div></div></body></html>", f"Flood\n{TEXT}"),
    (f"<html><body><article>{BODY}<section class='comments'><p>I saw it too.</p><p>So did I, from the bridge.</p></section></article></body></html>", TEXT),
    (f"<html><body><div class='article-body'>{P1}<br><br>{P2}</div>{FOOT}</body></html>", f"{P1} {P2}"),
    (f"<html><body><header><h1>Example Press</h1>{NAV}</header><section class='news-story'><h2>Flood</h2>{BODY}</section>{FOOT}</body></html>", f"Flood\n{TEXT}"),
    (f"<html><body><div class='page'><div class='siteHeader'>Example Press</div><div class='articleBody'>{BODY}</div><div class='siteFooter'>Imprint and contact</div></div></body></html>", TEXT),
    (f"<html><body><article><h1>Flood</h1><blockquote><p>{P2}</p></blockquote><p>{P1}</p><table><tr><th>Town</th><th>Level</th></tr><tr><td>Upton</td><td>2.1 m</td></tr></table></article></body></html>", f"Flood\n{P2}\n{P1}\nTown\nLevel\nUpton\n2.1 m"),
    (f"<html><body>{NAV}<div class='post hentry'><h1>Flood</h1><div class='social-share'><a href='/f'>Share</a> <a href='/t'>Post</a></div>{BODY}</div>{SAID}{FOOT}</body></html>", f"Flood\n{TEXT}"),
    (f"<html><body><div id='wrapper'><ul class='breadcrumb'><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul><div id='story'><p>{P1} <a href='/map'>See the map</a> of the river.</p><p>{P2}</p></div></div></body></html>", f"{P1} See the map of the river.\n{P2}"),
    (f"<html><body><article><p>{P1}</p></article><div class='newsletter'><p>Sign up for our letter and get the news each morning.</p></div></body></html>", P1),
    (f"<html><body class='single'><main id='main' class='site-main'><article class='post'><header class='entry-header'><h1>Flood</h1></header><div class='entry-content'>{BODY}</div></article></main><div class='widget-area'><h2>Archive</h2><ul><li><a href='/5'>May</a></li></ul></div></body></html>", f"Flood\n{TEXT}"),
    (f"<html><body>{NAV}<div class='text'><p>{P3}</p></div><div class='related-posts'><h3>More</h3><p><a href='/x'>Dams in numbers</a></p></div></body></html>", P3),
    (f"<html><body><div><div><div class='col-8'><article>{BODY}</article></div><div class='col-4'><div class='promo'><p>Best boots of the year. Order now!</p></div></div></div></div></body></html>", TEXT),
    (f"<p>{P1}<p>{P2}", f"{P1}\n{P2}"),
    (f"<html><body><div class='richtext'><h2>Why</h2><p>{P1}</p><pre>level = 2.1</pre><p>{P2}</p></div><div class='commentlist'><li>First!</li><li>What a night.</li></div></body></html>", f"Why\n{P1}\nlevel = 2.1\n{P2}"),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_main_text_of_pages_written_by_hand(k):
    page, want = LAYOUTS[k]
    assert h.main_text(page, h.default_model()) == want


def test_fit_takes_seconds():
    pages = h.labelled_pages()
    began = time.process_time()
    h.fit(pages)
    assert time.process_time() - began < 15


def test_all_words_of_a_class_are_read():
    utilities = " ".join(f"{a}{b}" for a in "abcd" for b in "wxyz")
    node = next(n for n in h.parse(f"<div class='{utilities} sidebar'>text</div>") if n.tag == "div")
    assert node.words[-1] == "sidebar" and len(node.words) == 17


def test_pages_of_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    model = h.default_model()
    good = 0
    for r in rows:
        got = h.main_text(r.html, model)
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        good += got == "\n".join(x for x in want if x)
    assert good >= 0.95 * len(rows)


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) >= 0.5 * len(ids)
        assert docs.count() == len(now)
        if k < 4:
            assert docs.columns == before.columns == corpus_pipeline.COLUMNS
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        if k >= 2:
            assert now <= ids
        ids = now
    assert corpus_pipeline.run(spark, SF).count() == len(ids)


def mask_brute(text, spans):
    """The text with each stretch of kind:start:end spans replaced by the name of its first."""
    out, at = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",") if x):
        start, end = int(start), int(end)
        if start >= at:
            out += [text[at:start], pii.PLACEHOLDER[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def cut_brute(text, hit):
    """The text without its stretches of hit words; None if more than half of the words are hit."""
    found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))]
    if hit and len(hit) > 0.5 * len(found):
        return None
    out, at = "", 0
    for k in hit:
        if k - 1 not in hit:
            out += text[at : found[k][0]]
        at = found[k][1]
    return out + text[at:]


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, rows):
        out = stages[name](spark, rows, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, sorted((r.doc_id, r.text) for r in out.collect()) if name != "mixing" else out

    before = sorted((r.doc_id, r.text) for r in docs.collect())
    scores = {r.doc_id: r.score for r in score_toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2).collect()}
    docs, got = kept("toxicity", docs)
    assert got == [x for x in before if scores[x[0]] < 0.3] and len(got) < len(before)
    before = got
    docs, got = kept("near_copies", docs)
    least = {i: c for i, _, c in jaccard_brute(before, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)}
    assert got == [x for x in before if least[x[0]] == x[0]] and len(got) < len(before)
    before = got
    docs, got = kept("decontamination", docs)
    hits = {x[0]: x[5] for x in contamination_brute(before, [(str(r.item_id), r.text) for r in items.collect()], 10)}
    cut = [(i, cut_brute(t, hits[i])) for i, t in before]
    assert got == [x for x in cut if x[1] is not None]
    before = got
    docs, got = kept("pii", docs)
    assert got == [(i, mask_brute(t, s)) for (i, t), s in zip(before, pii_terms_brute([t for _, t in before]), strict=True)]
    mixed, _ = kept("mixing", docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/pii/*.parquet'")
    names = ["doc_id", "size", "source_size", "taken"]
    assert sorted(map(tuple, mixed.select(*names).collect())) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({mixing.SQL})").fetchall())


def test_near_copies_keep_a_unique_text_of_a_shared_id(spark):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(1, a), (5, a), (5, "a wholly different text of its own"), (None, a), (None, a + " more")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [(1, a), (5, rows[2][1])]


def test_pipeline_of_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text of some words", "en", "a", 23), (4, "same text of some words", "en", None, 23), (5, "x@y.org is it", "en", "b", 12), (None, "lonely", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 3:
            assert {r.doc_id: r.text for r in docs.collect()} == {1: None, 2: "", 3: "same text of some words", 5: "[EMAIL] is it", None: "lonely"}
    assert docs.count() == 5


def test_near_copies_keep_one_of_each_group_whatever_the_ids(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    z, lone = " ".join(f"z{i}" for i in range(40)), "lonely text"
    # 5 is used by two texts, of which one is a near copy; null ids are copies of a kept row and of each other
    rows = [(5, x), (5, y), (3, y + " more"), (None, x), (None, z), (None, z), (None, z + " more"), (None, lone), (7, lone + " too"), (8, x), (8, x)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    of_z = [g for g in got if g[1].startswith("z0 ")]
    assert len(of_z) == 1 and of_z[0][0] is None
    assert sorted((g for g in got if g not in of_z), key=str) == sorted([(5, x), (3, y + " more"), (None, lone), (7, lone + " too")], key=str)

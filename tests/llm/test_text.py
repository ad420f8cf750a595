"""Language, pages, neighbours and the pipeline: held-out accuracy, hand-made pages, brute force."""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from teleproof.llm import html_text, language, neighbours
from teleproof.llm.queries import QUERIES


def test_op7_held_out(spark, sf, documents):
    lang = {d: x for d, _, x in documents}
    rows = QUERIES["op7_language"](spark, sf).collect()
    assert len(rows) == len(documents)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.95


def test_language_edges(spark, documents):
    base = [(d, t, x, "a") for d, t, x in documents]
    df = spark.createDataFrame(base + [(None, None, "en", "b"), (9001, "", None, "c"), (9002, "123 ... !", "en", "d"), (9003, "漢字 かな", None, "e")], "doc_id long, text string, lang string, lang_pred string")
    model = language.fit(df, per_language=30, centroids=3)
    assert set(model.languages) == {x for _, _, x in documents}
    again = language.fit(df.repartition(5), per_language=30, centroids=3)
    assert (again.centroids == model.centroids).all()
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    for doc in (None, 9001, 9002):
        assert (got[doc].lang_pred, got[doc].lang_score, got[doc].lang_rejected) == ("und", 0.0, True)
    assert got[9003].lang_pred in model.languages and got[9003].lang_rejected
    assert got[0].lang_pred in model.languages and not got[0].lang_rejected
    nothing = language.fit(df.where("false"))
    assert nothing.languages == [] and {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_ngrams_count_the_whole_text():
    a, b = language.counts("Ab cd"), language.counts("ab-cd 77")
    assert (a == b).all() and language.counts("12 .") is None and language.counts(None) is None
    long = language.counts("ab cd " * 300_000)
    assert long.sum() > 3 * 1_700_000


def page(inner, head="", tail=""):
    return f"<html><head><title>T</title></head><body><nav><a>Menu</a></nav>{head}<article>{inner}</article>{tail}<footer>End</footer></body></html>"


WEIGHTS = {"p": -0.01, "/p": -0.01, "h1": -0.01, "/h1": -0.01, "b": -0.01, "/b": -0.01, "article": -2.0, "/article": -2.0}


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    (page("<h1>A &amp; B</h1><p>one\n two <b>th</b>ree&nbsp;&#52;</p><p> </p>"), "A & B\none two three 4"),
    (page("<p>a</p><div class='ad'>Buy <div>now</div></div><p>b</p>"), "a\nb"),
    (page("<p>a</p><!-- <p>no</p> --><script>if (a<b) '</p>'</script><style>p{}</style><p>b</p>"), "a\nb"),
    (page("<p>a b c</p>", tail="<div id='comments'><p>first of many reader words</p></div>"), "a b c"),
    (page("<p>a</p><aside>side</aside><form><p>f</p></form><p>b &lt;i&gt;"), "a\nb <i>"),
    ("<body><article><p>cut of", "cut of"), ("<body><article><p>cut</p><fo", "cut"), ("<nav>only menu</nav>", ""),
])
def test_pages_by_hand(source, want):
    assert html_text.main_text(source, WEIGHTS) == want


@pytest.mark.parametrize("source, want", [
    *((f"<body><div class='{c}'><article><p>a b c</p></article></div>", "a b c") for c in ("site no-sidebar", "content has-sidebar", "content nav-open", "post comments-open", "sidebar")),
    (page("<p>a</p><section id='related-work'><h2 id='search'>Search</h2><p>b</p></section>"), "a\nSearch\nb"),
    (page("<p>a</p><figure><figcaption>seen here</figcaption></figure><p>b</p>"), "a\nseen here\nb"),
    (page("<p>a</p><ul><li>one<li class='share'>Share<li>two</ul><p>b</p>"), "a\none\ntwo\nb"),
    (page("<p>a</p><ul><li class='share'>Share</ul><p class='notice'>Notice<p>b</p>"), "a\nb"),
    (page("<p>a</p><div><p class='notice'>Notice</div><p>b</p><table><tr><td class='ad'>Ad<td>c<tr><td>d</table>"), "a\nb\nc\nd"),
    (page("<p>a</p><dl><dt class='ad'>t<dd>d</dl><div class='ad-box'>Buy</div><div id='x' class='share-buttons'>Go</div><p>b</p>"), "a\nd\nb"),
    (page("<p>a</p><ul class='menu'><li>x<li>y<p>z</ul><p>b</p>"), "a\nb"),
])
def test_named_parts_end_where_html_ends_them(source, want):
    weights = {**WEIGHTS, **dict.fromkeys("section.related-work /section h2.search /h2 figure /figure figcaption /figcaption ul /ul li li! p! div /div table /table tr td td! dl /dl dt! dd ul! div!".split(), -0.01)}
    assert html_text.main_text(source, weights) == want


def test_teasers_with_the_tags_of_the_article(spark, sf):
    """Teasers after the article use its own p, one of them with 5,000 words; on the other pages no paragraph is lost and none is added.

    The page with 5,000 words beside an article of 142 is open: its best run is the longer text."""
    words = lambda n: "w " * n
    inner = "".join(f"<p>{words(n)}</p>" for n in (4, 30, 60, 3, 40, 5))
    tail = lambda n: f"<div class='more'><p>{words(n)}</p><p>{words(8)}</p></div>"
    rows = [(k, "u", page(inner, tail=tail(5000 if k == 7 else 15) if k % 10 == 7 else "")) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = "\n".join(" ".join("w" * n) for n in (4, 30, 60, 3, 40, 5))
    assert {r.text for r in html_text.extract(df, html_text.learn(df)).where("page_id != 7").collect()} == {want}


def test_op8_against_marked_articles(spark, sf):
    got = {r.page_id: r for r in QUERIES["op8_html"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*$", "", inner)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_pages_edges(spark, sf):
    rows = [(None, None, None, "x"), (1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (2, None, page("<p>" + "w " * 50_000), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, len(r.text)) for r in html_text.extract(df, html_text.learn(df)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 99_999)]
    assert html_text.learn(df.where("false")) == {} and html_text.extract(df.where("false"), {}).collect() == []


def nearest_by_hand(rows, queries, most):
    usable = [(i, np.array(e, float)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = {}
    for q, e in usable:
        if queries(q):
            found = sorted((float(np.sqrt(((x - e) ** 2).sum())), i) for i, x in usable if i != q)[:most]
            out[q] = [i for _, i in found]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return dict(out)


def test_op9_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = nearest_by_hand(rows, lambda q: q % 100 == 0, 10), found(QUERIES["op9_neighbours"](spark, sf))
    assert want.keys() == got.keys()
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_with_one_large_vector(spark, sf, kind):
    """A single vector of size 1e7 takes no precision from the graph of the others."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    e = rng.normal(size=(1500, 6)) @ rng.normal(size=(6, 32))
    e = np.float32(e / np.linalg.norm(e, axis=1, keepdims=True))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(e)] + [(5001, [1e7] * 32)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0, neighbours=10, beam=20))
    want = nearest_by_hand(rows, lambda q: q % 100 == 0, 10)
    assert want.keys() == got.keys()
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_neighbours_edges(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(40)]
    rows = [(i, e) for i, e in rows if any(e)] + [(100, [1.0, 0.0, 0.0, 0.0]), (101, [1.0, 0.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0])]
    rows += [(300, None), (400, [0.0] * 4), (500, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = found(neighbours.nearest(df, F.col("vec_id") % 100 == 0, most=3))
    assert got == nearest_by_hand(rows, lambda q: q % 100 == 0, 3)
    few = df.where("vec_id IN (100, 101, 300)")
    assert found(neighbours.nearest(few, F.col("vec_id") % 100 == 0)) == {100: [101]}
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_pipeline(spark, sf, documents):
    """Each stage against brute force on what the one before kept."""
    from llm.test_duplicates import joined, removed, similar_lines, slow_fingerprint
    from llm.test_tokens import held

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "simhash", "repeats", "packing"]
    step = lambda name, rows: stages[name](spark, spark.createDataFrame(rows, docs.schema), sf).collect()

    kept = stages["language"](spark, docs, sf)
    assert kept.columns == columns
    kept = kept.collect()
    assert len(kept) >= 0.99 * len(documents)

    lines = step("lines", kept)
    gone = similar_lines([(r.doc_id, r.text) for r in kept])
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id, r.text]) for r in kept}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)

    bits = {r.doc_id: slow_fingerprint(r.text) for r in lines}
    groups = joined(sorted(bits), lambda a, b: (bits[a] ^ bits[b]).bit_count() <= 2)
    single = step("simhash", lines)
    assert sorted(r.doc_id for r in single) == sorted(set(groups.values()))

    cut = step("repeats", single)
    left = {d: n - g for d, n, g, _, _ in removed([(r.doc_id, r.text) for r in single], 400)}
    assert all(0 <= len(r.text.encode()) - left[r.doc_id] <= 40 for r in cut)
    held(step("packing", cut), [(r.doc_id, r.text) for r in cut], 2048, 1)

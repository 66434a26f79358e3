"""Every operator against a brute-force version, and on awkward tables."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholia.llm import bpe, chat, decontamination, html_text, language, lines, neighbours, sharding, simhash, training_order
from scholia.llm.registry import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Columns that documents may bring, named like those the operators use inside.
EXTRA = ["id", "tk", "line", "fp", "row", "spans", "_text", "bucket", "data", "n", "g", "lane", "label", "h1", "first", "exact", "near", "host", "rank", "block"]


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def awkward(spark, ids: str = "doc_id"):
    """Nulls, empty, blank and very long texts, repeated rows, equal texts, clashing columns."""
    rnd = random.Random(3)
    long = "\n".join(sentence(rnd, 30) for _ in range(3000))
    texts = [None, "", "   \n ", "one", "Zéro ́ x", long, long, sentence(rnd, 12), sentence(rnd, 40), sentence(rnd, 40) + "\n" + sentence(rnd, 9)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, texts[8]), (8, texts[8]), (None, "no id here at all, friend"), (20, None), (21, "")]
    frame = spark.createDataFrame(rows, f"{ids} long, text string").withColumn("lang", F.lit("xx"))
    return frame.withColumns({name: F.lit("clash") for name in EXTRA if name != ids})


def empty(frame):
    return frame.limit(0)


def rows_of(frame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_takes_item_ids_of_any_type(spark, block_bytes):
    rnd = random.Random(2)
    texts = [sentence(rnd, 20) for _ in range(3)]
    docs = spark.createDataFrame([(1, texts[0] + " " + texts[1]), (2, texts[2]), (3, "nothing of it")], "doc_id long, text string")
    items = [("b1", texts[0]), ("a1", texts[1]), ("10", texts[1]), ("9", texts[2]), (None, texts[2])]
    found = {r["doc_id"]: r["item_ids"] for r in decontamination.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes).collect()}
    assert found == {1: ["10", "a1", "b1"], 2: ["9"], 3: []}


# --- 1 --------------------------------------------------------------------------------------------------------------


def bench_items(rnd):
    return [(1, sentence(rnd, 30)), (2, sentence(rnd, 13)), (10, sentence(rnd, 5)), (3, "word"), (4, ""), (5, None), (None, sentence(rnd, 20)), (2, sentence(rnd, 15))]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_matches_brute_force(spark, block_bytes):
    rnd = random.Random(1)
    items = bench_items(rnd)
    docs = []
    for i in range(60):
        parts = [sentence(rnd, rnd.randint(0, 40))]
        if i % 3 == 0:
            words = (rnd.choice(items)[1] or "").split()
            at = rnd.randint(0, max(0, len(words) - 13))
            parts.append(" ".join(words[at : at + rnd.randint(10, 20)]).upper().replace(" ", "--"))
        docs.append((i, " ".join(parts) + rnd.choice(["", ".", " été"])))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.digest(decontamination.contamination(frame, bench, block_bytes=block_bytes))
    want = decontamination.brute_force(docs, items)
    assert rows_of(found) == sorted(want, key=repr)
    assert any(w[5] for w in want) and not all(w[5] for w in want)
    kept = decontamination.decontaminate(frame, bench, block_bytes=block_bytes)
    bad = {w[0] for w in want if w[5]}
    assert rows_of(kept) == sorted([d for d in docs if d[0] not in bad], key=repr)


def test_decontamination_awkward(spark):
    frame = awkward(spark)
    bench = spark.createDataFrame([(1, sentence(random.Random(9), 13))], "item_id long, text string")
    assert decontamination.digest(decontamination.contamination(frame, bench)).count() == frame.count()
    assert decontamination.decontaminate(frame, empty(bench)).columns == frame.columns
    assert decontamination.decontaminate(frame, empty(bench)).count() == frame.count()
    assert decontamination.contamination(empty(frame), bench).count() == 0
    assert decontamination.contamination(empty(frame), bench, block_bytes=1).count() == 0
    dotted = frame.select("doc_id", "text").toDF("doc.id", "the text").withColumn("meta.src", F.lit(1))
    for size in (1, 1 << 20):
        assert decontamination.decontaminate(dotted, bench, "doc.id", "the text", block_bytes=size).columns == dotted.columns
        assert rows_of(decontamination.digest(decontamination.contamination(dotted, bench, "doc.id", "the text", block_bytes=size), "doc.id")) == rows_of(decontamination.digest(decontamination.contamination(frame, bench)))


@pytest.mark.parametrize("slots", [1 << 16, 128])
def test_decontamination_tables_of_both_kinds_agree(spark, monkeypatch, slots):
    """The hashed shift table, also one so small that blocks meet, loses no place that the exact one stops at."""
    monkeypatch.setattr(decontamination, "LEAST_SLOTS", slots)
    monkeypatch.setattr(decontamination, "MOST_SLOTS", slots)
    rnd = random.Random(21)
    items = [(i, sentence(rnd, rnd.randint(1, 30)).encode()) for i in range(40)]
    frame = spark.createDataFrame([(i, bytearray(t)) for i, t in items], "item long, text binary")
    table, lengths = decontamination.shift_table(frame, 13)
    assert len(table) == slots and lengths == sorted({min(13, len(t.split())) for _, t in items})
    for words in ([w for _, t in rnd.sample(items, 6) for w in t.split()] + sentence(rnd, 40).encode().split() for _ in range(20)):
        for matcher in decontamination.Matcher(items).tables:
            starts = {s for s, _, _ in matcher.find(words)}
            assert starts <= set(decontamination.candidates(words, table, matcher.length))


# --- 2 --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="with-sidebar">
<header class="site-header"><p>Brand and slogan</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav>
<div class="wrap"><div class="post-{n} body"><header><h1>Title {n} &amp; more</h1><span>by someone</span></header>
<p>First  paragraph
 of page {n}<br>goes &eacute; on, and it is long enough to be text.<p>Second <i>one</i>, also with enough words to count as text.
<div class="share">Share me</div><script>var x = "</p>";</script><!-- hidden --><form><input name="q">Find</form></div>
<div id="comments"><p>What a good article, I read it at once and want to say much about it, much more than it says.</p></div></div>
<aside><p>Other news</p></aside><div class="cookie-notice">Cookies!</div><footer><p>Imprint</p></footer></body></html>"""


def test_html_text_takes_the_article(spark):
    pages = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(6)]
    odd = "<div class='intro'>" + "An odd page with its own shape and a good deal of text in it. " * 5 + "</div>"
    pages += [(50, "http://a.example/odd", odd), (51, None, odd), (52, "not a url", None), (53, "http://b.example/", ""), (54, "http://b.example/", "<p>loose text & more"), (54, "http://b.example/", "<p>loose text & more")]
    found = html_text.digest(html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(pages)
    assert texts[3] == "Title 3 & more\nFirst paragraph of page 3 goes é on, and it is long enough to be text.\nSecond one, also with enough words to count as text."
    assert texts[50] == texts[51] == " ".join(("An odd page with its own shape and a good deal of text in it. " * 5).split())
    assert (texts[52], texts[53], texts[54]) == ("", "", "loose text & more")
    assert all(r["n_chars"] == len(r["text"]) for r in found)


PROSE = "Plain prose that goes on for a while, with words enough to be an article. " * 4
LONG, P = " ".join(PROSE.split()), f"<p>{PROSE}</p>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<h1>T</h1><div class="content no-sidebar">{P}</div>', "T\nLONG"),
        (f'<h1>T</h1><div class="entry comments-open">{P}</div>', "T\nLONG"),
        (f'<body class="has-ads"><form id="aspnetForm"><div><h1>T</h1>{P}</div></form></body>', "T\nLONG"),
        (f'<article><h1>T</h1>{P}<section id="discussion"><h2>Discussion</h2>{P}</section><p class="related">Related prose.</p></article>', "T\nLONG\nDiscussion\nLONG\nRelated prose."),
        (f'<article><header><h1>T</h1><p>A lede.</p><span>by me</span></header>{P}</article>', "T\nA lede.\nLONG"),
        (f'<div><div class="cookie-banner"><h1>Cookies</h1><p>We use cookies.</p></div><h1>T</h1>{P}</div>', "T\nLONG"),
        (f'<article><h1>T</h1>{P}<div class="user-posts"><p>Great read.</p></div><div class="related"><a href="/a">Another one</a></div></article>', "T\nLONG"),
        (f'<article><h1>T</h1>{P}<div class="zz"><div class=i><b class="author">Al</b><p>I disagree.</p></div><div class=i><b class="author">Bo</b><p>No.</p></div></div></article>', "T\nLONG"),
        (f"<article><h1>T</h1>{P}<article>{P * 4}</article></article>", "T\nLONG"),
        (f'<div class="post">{P}<p class="ad">Buy this.</p><ul class="share"><li>Share</ul><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table></div>', "LONG\nOne\nTwo\na\nb"),
        (f'<div class="liveblog"><div class=e><time>9:00</time>{P}</div><div class=e><time>9:30</time>{P}</div></div>', "9:00\nLONG\n9:30\nLONG"),
        # Names with other words in them, and those that articles use too, need a second sign.
        (f'<article><h1>T</h1>{P}<p class="ad-hoc">An ad hoc committee met.</p><p class="commercial-law">Law of trade.</p><ul class="menu"><li>Soup<li>Fish</ul><section class="notice-of-death"><p>He died.</p></section></article>', "T\nLONG\nAn ad hoc committee met.\nLaw of trade.\nSoup\nFish\nHe died."),
        (f'<article><h1>T</h1>{P}<ul class="menu"><li><a href="/a">One</a><li><a href="/b">Two</a></ul><div class="promoted"><form>x</form></div><div class="sidebar-left"><p>Side.</p></div><div class="comments-area">{P}</div></article>', "T\nLONG"),
        (f'<article><h1>T</h1>{P}<aside><blockquote>Said so.</blockquote></aside><aside><p>Other news</p></aside></article>', "T\nLONG\nSaid so."),
        (f'<article><h1>T</h1>{P}<ul><li><cite>Emma</cite> by Austen<li><cite>Ulysses</cite> by Joyce</ul><ol><li><time>1914</time> War.<li><time>1918</time> Peace.</ol></article>', "T\nLONG\nEmma by Austen\nUlysses by Joyce\n1914 War.\n1918 Peace."),
        (f'<article><h1>T</h1>{P}<div class="visitor-notes"><div><b>Al</b> I liked it.</div><div><b>Bo</b> I did not.</div></div></article>', "T\nLONG"),
        (f'<article><header><h1>T</h1><p class="byline">By Al, 3 May</p><span>x</span></header>{P}</article>', "T\nLONG"),
    ],
)
def test_html_text_names_weigh_and_do_not_decide(html, want):
    assert html_text.extract(html).replace(LONG, "LONG") == want


def host_pages():
    """A host whose promotion is longer than most articles, with a page of another kind and copies of one page; a host with a thread."""
    promo = f"<div class='zq'>{P}{P}<p>Always the same offer.</p></div>"
    pages = [(i, "a.example", f"<div class='top{i}'>{promo}<div class='kk'><h2>Title {i}</h2><p>{'Words of page number %d here. ' % i * 9}</p></div><p class='lic'>Free to use.</p></div>") for i in range(8)]
    pages += [(100 + i, "a.example", pages[3][2]) for i in range(6)] + [(200, "a.example", f"<div class='other'>{P}<p>An odd page.</p></div>"), (201, "a.example", None), (202, "a.example", " ")]
    for i in range(20):
        article, talk = "Short article text %d. " % i * (4 if i else 2), "A long opinion on number %d that goes on. " % i * (1 if i else 12)
        pages.append((300 + i, "b.example", f"<div class='wrap'><div class='art'><p>{article}</p></div><div class='talk'><p>{talk}</p></div></div>"))
    return [*pages, (400, "", "<p>one page without a host"), (401, "c.example", f"<div class='x'>{P}</div>"), (402, "c.example", f"<div class='x'>{P}</div>")]


def test_html_text_follows_the_host(spark):
    pages = host_pages()
    frame = spark.createDataFrame([(i, f"http://{h}/{i}" if h else None, html) for i, h, html in pages], "page_id long, url string, html string").withColumns({"host": F.lit(1), "main": F.lit(2), "a.b": F.lit(3)})
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame.repartition(5)).collect()}
    assert got == html_text.brute_force(pages)
    # The promotion is the best container of every page by itself, and stock of the host; the thread is longer than page 300's article.
    alone = {i: html_text.extract(html) for i, _, html in pages}
    assert alone[2].startswith("Plain prose") and got[2] == "Title 2\n" + " ".join(("Words of page number 2 here. " * 9).split())
    assert got[100] == got[3] and "offer" not in got[3] and "Free to use" not in got[3]
    assert alone[300].startswith("A long opinion") and got[300] == "Short article text 0. Short article text 0."
    assert got[200].endswith("An odd page.") and got[201] == got[202] == "" and got[401] == got[402] == LONG


def repeated_pages(framed: str) -> list[tuple]:
    """Ten articles of one host: three framed anew from one, and a lede, a list and a quotation that others share."""
    pages = []
    for i in range(10):
        own = 2 if i in (2, 5, 7) else i
        body = f"<h1>Title {own}</h1>" + ("<p class='lede'>A lede that some share.</p>" if own in (2, 3, 4) else "") + f"<p>{'Text of article number %d goes on. ' % own * 12}</p>"
        body += ("<ul><li>Salt<li>Water</ul>" if own in (0, 1, 3) else "") + ("<blockquote><p>To be or not to be.</p></blockquote>" if own in (4, 6, 8) else "")
        nav = "".join(f"<li><a href='/{i}{k}'>link {i} {k}</a>" for k in range(i + 2))
        pages.append((i, "r.example", f"<html><body><nav><ul>{nav}</ul></nav>" + framed.format(body) + "<div class='foot'><p>Imprint of the host.</p></div></body></html>"))
    return pages


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize("framed", ["<article>{}</article>", "<article><div class='body'>{}</div></article>", "<div class='body'>{}</div>"])
def test_html_text_keeps_what_a_few_pages_share(spark, monkeypatch, framed, most):
    monkeypatch.setattr(html_text, "BROADCAST_PATHS", most)
    pages = repeated_pages(framed)
    frame = spark.createDataFrame([(i, f"http://{h}/{i}", html) for i, h, html in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    article = lambda n: " ".join(("Text of article number %d goes on. " % n * 12).split())
    assert got == html_text.brute_force(pages)
    assert got[2] == got[5] == got[7] == "Title 2\nA lede that some share.\n" + article(2)
    assert got[3] == "Title 3\nA lede that some share.\n" + article(3) + "\nSalt\nWater" and got[0] == "Title 0\n" + article(0) + "\nSalt\nWater"
    assert got[4].endswith("\nTo be or not to be.") and got[9] == "Title 9\n" + article(9)


def test_html_text_keeps_an_article_that_most_pages_repeat(spark):
    """Where one article is most of a host, nothing else on those pages comes near it."""
    pages = [(i, "http://m.example/x", f"<nav><a href='/{i}'>go to {i}</a></nav><article><h1>T</h1>{P}</article>") for i in range(6)]
    got = {r["text"].replace(LONG, "LONG") for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {"T\nLONG"}


def test_html_text_share_of_votes_decides(monkeypatch):
    html = f"<div class='a'><p>{'Few words. ' * 8}</p></div><div class='b'><p>{'Many more words. ' * 20}</p></div>"
    assert html_text.extract(html).startswith("Many") and html_text.extract(html, {"div.a": 0.9, "div.b": 0.02}).startswith("Few")
    assert html_text.extract(html, {"div.a": 0.1, "div.b": 0.9}).startswith("Many")
    assert html_text.extract(html, {"div.a": 0.9}, {"div.a": {html_text.ANY}}).startswith("Many")
    assert html_text.extract(html, {}, {"div.b": {html_text.ANY}}).startswith("Few")


def test_html_text_broken_markup_and_depth(spark):
    deep = "<div>" * 3000 + "<p>deep down there is text" + "</div>" * 10
    assert html_text.extract(deep) == "deep down there is text"
    assert html_text.extract("<" * 5000) == "<" * 5000
    assert html_text.extract('<p title="a > b">quoted <b>x</p><p>y') == "quoted x\ny"
    pages = spark.createDataFrame([(1, "u", deep)], "page_id long, url string, html string").withColumns({"host": F.lit(1), "paths": F.lit(2), "meta.src": F.lit(3)})
    assert html_text.main_text(pages).count() == 1
    assert html_text.main_text(empty(pages)).count() == 0
    dotted = pages.select("page_id", "url", "html").toDF("page.id", "the url", "page.html")
    assert html_text.digest(html_text.main_text(dotted, "page.id", "the url", "page.html")).columns == ["page.id", "url", "text", "n_chars"]


def test_html_text_joins_hosts_either_way(spark, small, monkeypatch):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = rows_of(html_text.main_text(pages))
    monkeypatch.setattr(html_text, "BROADCAST_PATHS", 0)
    assert rows_of(html_text.main_text(pages)) == want


# --- 3 --------------------------------------------------------------------------------------------------------------


def vectors(spark, n=700, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dims)).astype(np.float32)
    rows[50:90] = rows[40]
    rows[300:310] *= 3
    return rows, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


def grouped(found) -> dict[int, list[tuple[int, float]]]:
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def recall_of(found, want) -> float:
    got = grouped(found)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in lists[0]}) for q, lists in want.items())
    return hits / sum(len(lists[0]) for lists in want.values())


def test_neighbours_exact_at_factor_one(spark):
    rows, frame = vectors(spark)
    bad = spark.createDataFrame([(1000, None), (1001, [0.0] * 12), (1020, [float("nan")] + [1.0] * 11), (1040, [float("inf")] * 12), (1060, [None] + [1.0] * 11), (None, [1.0] * 12)], frame.schema)
    frame = frame.unionByName(bad).withColumns({"vector": F.lit("clash"), "mark": F.lit(1), "dims": F.lit(2), "a.b": F.lit(3)})
    found = neighbours.neighbours(frame, F.col("id") % 20 == 0, factor=1.0, shard_rows=100, query_rows=16, leaf=16)
    want = neighbours.brute_force(np.arange(700), rows.astype(float), np.arange(0, 700, 20))
    got = grouped(found)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q][0]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q][0]], rtol=0, atol=1e-12)


def test_neighbours_take_every_row_of_an_id(spark):
    rows = [(1, [0.5, 0.5]), (1, [0.9, 0.1]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [0.1, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in neighbours.neighbours(frame, F.col("id") == 20, factor=1.0).collect())
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = sorted((k, v, s) for ranks in neighbours.brute_force(ids, matrix, np.array([20]))[20] for k, (v, s) in enumerate(ranks, 1))
    assert got == want and len(got) == 15 and (1, 1, 0.9) in got and (1, 20, 1.0) in got


def test_neighbours_keep_to_vectors_of_one_length(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 8)] + [(i, [1.0, float(i), 2.0]) for i in range(20, 25)] + [(40, [1.0] * 5)]
    found = grouped(neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id").isin(2, 20, 40), shard_rows=3))
    assert {v for v, _ in found[2]} == {1, 3, 4, 5, 6, 7} and {v for v, _ in found[20]} == {21, 22, 23, 24} and 40 not in found


def test_neighbours_recall_and_few_rows(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    pdf = frame.toPandas()
    ids, rows = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float)
    want = neighbours.brute_force(ids, rows, ids[ids % 20 == 0])
    assert recall_of(neighbours.neighbours(frame, F.col("id") % 20 == 0, shard_rows=64, leaf=8), want) >= 0.9
    few = neighbours.neighbours(frame.where("vec_id < 5"), F.col("id") % 20 == 0)
    assert few.count() == 4
    assert neighbours.neighbours(empty(frame), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["unequal norms", "clusters", "one direction"])
def test_neighbours_recall_where_norms_differ(spark, kind):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(6000, 64))
    if kind == "unequal norms":
        rows *= rng.lognormal(sigma=3, size=(6000, 1))
    elif kind == "clusters":
        rows = rng.normal(size=(60, 64))[rng.integers(60, size=6000)] + 0.3 * rows
    else:
        rows[:, 0] += 8 * rng.exponential(size=6000)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    want = neighbours.brute_force(np.arange(6000), rows, np.arange(0, 6000, 20))
    assert recall_of(neighbours.neighbours(frame, F.col("id") % 20 == 0, shard_rows=1500), want) >= 0.9


@pytest.mark.parametrize("scale", [1e200, 1e-200])
@pytest.mark.parametrize("factor", [None, 1.0])
def test_neighbours_of_extreme_magnitudes(spark, scale, factor):
    """Every finite vector takes part: products that overflow are infinite, those that vanish are zero, ties go to the smaller id."""
    extreme = [(i, [scale * (i + 1), scale]) for i in range(30)]
    frame = spark.createDataFrame(extreme, "vec_id long, embedding array<double>")
    ids, rows = np.arange(30), np.array([v for _, v in extreme])
    got, want = grouped(neighbours.neighbours(frame, F.col("id") % 20 == 0, factor=factor, shard_rows=8)), neighbours.brute_force(ids, rows, np.array([0, 20]))
    assert sum(map(len, got.values())) == 40 and all(got[q] == want[q][0] for q in want)
    rng = np.random.default_rng(3)
    mixed = np.concatenate([rng.normal(size=(40, 2)), rng.normal(size=(20, 2)) * 1e160, rng.normal(size=(20, 2)) * 1e-170, [[1e300, -1e300], [1e300, 1e300]]])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(mixed)], "vec_id long, embedding array<double>")
    got, want = grouped(neighbours.neighbours(frame, F.col("id") % 3 == 0, factor=1.0, shard_rows=16, leaf=4)), neighbours.brute_force(np.arange(len(mixed)), mixed, np.arange(0, len(mixed), 3))
    assert got == {q: ranks[0] for q, ranks in want.items()}


def test_neighbours_choose_a_factor_for_each_length_and_for_the_queries(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(5000)] + [(10_000 + i, (rng.normal(size=(40, 3))[i % 40] * 5 + rng.normal(size=3)).tolist()) for i in range(3000)]
    # Queries of both lengths that are unlike the table.
    rows += [(20_000 + 20 * i, (rng.exponential(size=64) * 3).tolist()) for i in range(60)] + [(30_000 + 20 * i, rng.exponential(size=3).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = grouped(neighbours.neighbours(frame, F.col("id") >= 20_000, shard_rows=4096))
    hits = total = 0
    for dims in (64, 3):
        own = [(i, v) for i, v in rows if len(v) == dims]
        ids = np.array([i for i, _ in own])
        for q, lists in neighbours.brute_force(ids, np.array([v for _, v in own]), ids[ids >= 20_000]).items():
            hits, total = hits + len({v for v, _ in found[q]} & {v for v, _ in lists[0]}), total + len(lists[0])
    assert hits >= 0.9 * total


# --- 4 --------------------------------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_trees_equal_the_library():
    tokenizer, codec, rnd = library(), bpe.Codec(tokenizer_path(), leaf=200, window=32), random.Random(5)
    pieces = ["abcdefgh", "'s", "'", ".", "!?,", "ABCé", "ß", "é", "̣́", "12", "漢", "<|endoftext|>", "<|startoftext|>", "한", "\U0001f600", "İ", "Σ", " ", "\x1c", " ", "\n\n"]
    for _ in range(400):
        chosen = rnd.sample(pieces, rnd.randint(1, 6))
        text = "".join(rnd.choice(chosen) if rnd.random() < 0.7 else rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([1, 30, 300, 2000])))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
        before, parts = False, []
        for piece, after in bpe.parts_of(text, rnd.choice([100, 300])):
            parts.append(bpe.encode_part(codec, piece, before, after))
            before = after
        assert np.frombuffer(bpe.combine(codec, parts), "<u4").tolist() == want
        assert codec.decode(np.array(want, int)) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_whole_texts(spark):
    frame, tokenizer = awkward(spark), library()
    run = "x" * 9000 + "'s" + "ab1" * 2000
    more = spark.createDataFrame([(30, run), (30, run), (31, "word " * 3000 + run)], "doc_id long, text string")
    docs = frame.select("doc_id", "text").unionByName(more)
    found = bpe.encode(docs, tokenizer_path(), part=4000)
    want = []
    for doc, text in docs.collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(bpe.digest(found).drop("joins")) == sorted(want, key=repr)
    assert bpe.encode(frame, tokenizer_path()).count() == frame.count()
    assert bpe.encode(empty(frame), tokenizer_path()).count() == 0
    dotted = frame.select("doc_id", "text").toDF("doc.id", "the text").withColumn("ids", F.lit(1))
    assert bpe.encode(dotted, tokenizer_path(), "doc.id", "the text").count() == frame.count()


def test_bpe_long_texts_are_trees(spark):
    """Halves are cut wherever the middle falls, so nearly every cut goes through a run and is joined by a window."""
    rnd, tokenizer = random.Random(12), library()
    texts = {1: sentence(rnd, 20000), 2: "short text", 3: "x" * 30000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r for r in bpe.encode(docs, tokenizer_path(), part=2000).collect()}
    for doc, text in texts.items():
        assert np.frombuffer(found[doc]["ids"], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    leaves = [p for p, _ in bpe.parts_of(texts[1], 2000)]
    assert "".join(leaves) == texts[1] and len(leaves) == 64 and max(map(len, leaves)) <= 2000
    opened = sum(after for _, after in bpe.parts_of(texts[1], 2000))
    assert found[1]["joins"] == opened > 30 and found[2]["joins"] == 0 and found[3]["joins"] == 15


def test_bpe_query_joins_parts_of_the_longest_texts(spark):
    """On the tables themselves: texts over one part come out of joins, and equal the library's."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    long = docs.where(F.length("text") > bpe.PART)
    found = bpe.encode(long, tokenizer_path()).join(long, "doc_id").collect()
    assert found and sum(r["joins"] for r in found) > 0
    tokenizer = library()
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == tokenizer.encode(r["text"], add_special_tokens=False).ids


def test_bpe_memo_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 12)
    monkeypatch.setattr(bpe, "RUNS", 3)
    rnd, tokenizer, codec = random.Random(2), library(), bpe.Codec(tokenizer_path(), leaf=50)
    texts = [" ".join(rnd.choice(["Été", "ab-c", "İx", "한국", "x" * 60, "a\xa0b", "\u0301q", "don't", "<|endoftext|>", "e\u0301t"]) for _ in range(rnd.randint(0, 9))) + rnd.choice(["", "\x1c", " \u2003 "]) for _ in range(300)]
    for at in range(0, 300, 7):
        for text, (got, _) in zip(texts[at : at + 7], codec.encode_all(texts[at : at + 7]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_columns_equal_single_texts():
    import pyarrow as pa

    rnd, codec = random.Random(3), bpe.Codec(tokenizer_path(), leaf=60)
    for odd in ("", "\x85", "\u2003", "\x0b"):
        texts = [rnd.choice(["", " ", "\n a", "b\t"]) + " ".join(rnd.choice([*WORDS, "Été,", "y" * 200, "İx"]) for _ in range(rnd.randint(0, 9))) + rnd.choice(["", " ", odd]) for _ in range(200)]
        ids, ends, joins = codec.encode_column(pa.array(texts).slice(5))
        for k, text in enumerate(texts[5:]):
            assert ids[ends[k - 1] if k else 0 : ends[k]].tobytes() == codec.encode(text)
        assert [n > 0 for n in joins] == ["y" * 200 in t for t in texts[5:]]


def test_bpe_plain_runs_equal_the_library():
    rnd, tokenizer, codec = random.Random(7), library(), bpe.Codec(tokenizer_path())
    letters, marks = "abcdefgxyzABÀÉßàéèñöüÿØÞ", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    runs = {"".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) + "".join(rnd.choice(marks) for _ in range(rnd.choice([0, 0, 1, 1, 2, 5]))) for _ in range(5000)} - {""}
    assert all(bpe._PLAIN.fullmatch(r) for r in runs)
    for run, (got, _) in zip(runs, codec.encode_all(list(runs)), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(run, add_special_tokens=False).ids
    assert not any(bpe._PLAIN.fullmatch(r) for r in ["don't", "a1", "<|endoftext|>", "e\u0301", "Σ", "a.b", "\x7f"])


def test_bpe_refuses_other_kinds_of_files(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(bpe.UnsupportedTokenizer):
        bpe.encode(frame, tokenizer_path("byte_bpe_50k.json"))


# --- 5 --------------------------------------------------------------------------------------------------------------


def line_docs(seed=2):
    rnd = random.Random(seed)
    pool = [sentence(rnd, rnd.randint(1, 20)).split() for _ in range(60)]
    docs = []
    for i in range(80):
        out = []
        for _ in range(rnd.randint(0, 8)):
            words = list(rnd.choice(pool))
            kind, at = rnd.randint(0, 5), rnd.randrange(len(words))
            if kind == 0:
                words[at] = rnd.choice(WORDS)
            elif kind == 1:
                words.insert(at, rnd.choice(WORDS))
            elif kind == 2:
                words.pop(at)
            elif kind == 3:
                words[at] = words[at].upper()
            out.append(" ".join(words))
        docs.append((i, "\n".join(out)))
    return [*docs, (200, None), (201, ""), (202, "short line")]


@pytest.mark.parametrize("most", [500_000, 1])
def test_lines_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST_LINES", most)
    docs = line_docs()
    found = lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))
    want = lines.brute_force(docs)
    got = dict(map(tuple, found.collect()))
    assert got == want
    assert any(got[d] != t for d, t in docs)


def test_short_lines_lose_exact_repeats(spark):
    docs = [(1, "All rights reserved.\nand ornd.\n\n \nx"), (2, "ALL  rights reserved.\nand ornd\n\n \nand ornd."), (3, "x"), (4, "one two three four\none two three four five"), (5, "one two three four six")]
    found = dict(map(tuple, lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert found == lines.brute_force(docs)
    assert found[1] == "All rights reserved.\nand ornd.\n\n \nx" and found[2] == "and ornd\n\n " and found[3] == "" and found[4] == docs[3][1] and found[5] == ""


def test_lines_edit_distance():
    words = "a b c d e".split()
    assert lines.one_apart(words, words)
    assert lines.one_apart(words, words[1:]) and lines.one_apart(words, [*words, "f"]) and lines.one_apart(words, ["x", *words[1:]])
    assert not lines.one_apart(words, words[2:]) and not lines.one_apart(words, ["b", "a", *words[2:]])


def test_lines_awkward(spark):
    frame = awkward(spark)
    found = lines.deduplicate(frame)
    assert found.columns == frame.columns and found.count() == frame.count()
    texts = {r["doc_id"]: r["text"] for r in found.collect()}
    before = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert texts[0] is None and texts[6] == "" and texts[5] == before[5] and texts[8] == before[8] and texts[None] == before[None]
    assert lines.deduplicate(empty(frame)).count() == 0
    dotted = frame.select("doc_id", "text").toDF("doc.id", "the text").withColumn("meta.src", F.lit(1))
    assert lines.deduplicate(dotted, "doc.id", "the text").columns == dotted.columns and lines.deduplicate(dotted, "doc.id", "the text").count() == frame.count()


# --- 6 --------------------------------------------------------------------------------------------------------------


def near_docs(seed=4):
    rnd = random.Random(seed)
    docs = []
    for g in range(12):
        words = sentence(rnd, 120).split()
        for _ in range(rnd.randint(1, 8)):
            changed = list(words)
            for _ in range(rnd.randint(0, 2)):
                changed[rnd.randrange(len(changed))] = rnd.choice(WORDS)
            docs.append((len(docs), " ".join(changed)))
    return [*docs, (500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE two"), (504, "ONE two")]


def test_simhash_matches_brute_force(spark):
    docs = near_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = simhash.brute_force(docs)
    assert rows_of(simhash.digest(simhash.near_duplicates(frame))) == sorted(want, key=repr)
    kept = [r["doc_id"] for r in simhash.deduplicate(frame).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


@pytest.mark.parametrize("long_keys", [False, True])
def test_simhash_finds_every_pair(spark, long_keys):
    """Every way to differ in up to four bits meets in some segment, and in some part of the other bits."""
    rnd = random.Random(8)
    prints = set()
    for _ in range(150):
        base = rnd.getrandbits(64)
        prints.add(base)
        for _ in range(4):
            prints.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, long_keys)
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(6)
    path = list(range(1000, 1300))
    rnd.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *[(5, x) for x in range(6, 40)], *[(99, x) for x in range(60, 99)], (1, 1), (200, 201), (201, 200)]
    roots = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {roots[x] for x in path} == {1000} and roots[39] == 5 and {roots[x] for x in range(60, 100)} == {60} and roots[201] == 200 and 1 not in roots


def test_hot_keys_are_looked_up_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 10)
    monkeypatch.setattr(simhash, "HOT_KEYS", 5)
    test_components_of_paths_and_stars(spark)
    test_simhash_matches_brute_force(spark)
    docs = [(i, f"copies of one text {i // 40}") for i in range(100)] + near_docs()
    found = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(simhash.digest(found)) == sorted(simhash.brute_force(docs), key=repr)


def test_simhash_keeps_the_smallest_text_of_an_id(spark):
    rnd = random.Random(8)
    texts = sorted(sentence(rnd, 40) for _ in range(4))
    rows = [(1, texts[2], {"k": 1}), (1, texts[0], {"k": 2}), (1, texts[1], {"k": 3}), (2, texts[3], {"k": 4}), (3, "b", {"k": 5}), (3, None, {"k": 6})]
    frame = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    for n in (1, 4):
        assert sorted((r["doc_id"], r["text"], r["extra"]["k"]) for r in simhash.deduplicate(frame.repartition(n)).collect()) == [(1, texts[0], 2), (2, texts[3], 4), (3, None, 6)]


def test_simhash_takes_any_column_name(spark):
    docs = spark.createDataFrame(near_docs(), "`doc.id` long, `the text` string").withColumns({"meta.src": F.lit(1), "id": F.lit("x"), "row": F.lit(2), "component_id": F.lit(3)})
    kept = simhash.deduplicate(docs, "doc.id", "the text")
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == sorted({c for _, _, c in simhash.brute_force(near_docs())})


def test_simhash_awkward(spark):
    frame = awkward(spark)
    assert simhash.near_duplicates(frame).count() == frame.count()
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(8) == 1 and None in ids and 5 in ids and 6 not in ids and 0 in ids and 1 not in ids
    assert simhash.deduplicate(empty(frame)).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------

TURNS = [(1, 0, "system", "Be brief."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob b", "Ho"), (1, 3, "ann", ""), (1, 3, "ann", ""), (2, 0, "system", "alone"), (3, None, "ann", "x"), (None, 0, "ann", "x"), (4, 0, None, "x"), (5, 0, "ann", None)]


def test_chat_rotates_perspectives(spark):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(7), "stretch": F.lit(7), "head": F.lit(7), "a.b": F.lit(1)})
    rendered = chat.turns_of(frame)
    found = {r["perspective"]: r for r in chat.joined(rendered).collect()}
    assert set(found) == {"ann", "bob b"}
    ann, bob = found["ann"], found["bob b"]
    assert ann["text"] == '<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>assistant\nHi <im_end><|im_end|>\n<|im_start|>user name="bob b"\nHo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n'
    assert [ann["text"][s["start"] : s["end"]] for s in ann["mask"]] == ["Hi <im_end><|im_end|>", "<|im_end|>"]
    assert [bob["text"][s["start"] : s["end"]] for s in bob["mask"]] == ["Ho<|im_end|>"] and rendered.where("perspective = 'ann'").count() == 4
    assert chat.turns_of(empty(frame)).count() == 0


def test_chat_tells_speakers_apart(spark):
    names = ["李明", "王芳", "bob b", "bob_b", 'bob"b', "bob\\b", "bob\nb", "<|im_end|>", "Zoë", "b", "B", ""]
    turns = [(1, i, name, f"I am number {i}") for i, name in enumerate(names)]
    found = {r["perspective"]: r["text"] for r in chat.joined(chat.turns_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: v for k, v in found.items()} == {who: text for (_, who), (text, _) in chat.brute_force(turns).items()}
    heads = [part.split("\n")[0] for part in found["b"].split("<|im_start|>")[1:]]
    assert len(set(heads)) == len(names) and 'user name="李明"' in heads and found["b"].count("<|im_end|>") == len(names)


def test_chat_of_every_length_is_whole(spark):
    rnd = random.Random(9)
    turns = [(1, i, rnd.choice("abc"), sentence(rnd, rnd.randint(0, 4))) for i in range(1000)] + [(2, i * 37, rnd.choice(["a", "d", "system"]), str(i)) for i in range(50)] + [(3, 0, "a", sentence(rnd, 20000))]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    want = chat.brute_force(turns)
    for stretch in (16, 512):
        rendered = chat.turns_of(frame, stretch=stretch)
        got = {(r["conv_id"], r["perspective"]): (r["text"], [tuple(s) for s in r["mask"]]) for r in chat.joined(rendered).collect()}
        assert got == want
        for r in rendered.where("conv_id = 1 and perspective = 'a'").collect():
            assert want[1, "a"][0][r["start"] :].startswith(r["text"]) and r["place"] == r["turn"]


# --- 8 --------------------------------------------------------------------------------------------------------------


def check_shards(found: pd.DataFrame, docs: pd.DataFrame, shards: int):
    assert len(found) == len(docs)
    sizes = found.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


@pytest.mark.parametrize("groups", [[2] * 40, [100, 30, 30, 5, 5, 2], [400], [25] * 16])
def test_sharding_is_even_and_keeps_groups(spark, groups):
    rnd = random.Random(7)
    texts = [sentence(rnd, 20) for _ in groups]
    rows = [t for t, n in zip(texts, groups, strict=True) for _ in range(n)] + [sentence(rnd, 15) for _ in range(0 if groups[0] in (25, 400) else 200)]
    docs = pd.DataFrame({"doc_id": range(len(rows)), "text": rows})
    found = sharding.balanced_shards(spark.createDataFrame(docs), shards=8).toPandas()
    check_shards(found, docs, 8)
    quota = -(-len(rows) // 8)
    spread = found.merge(docs, on="doc_id").groupby("text")["shard"].nunique()
    cut = sum(spread[t] > -(-n // quota) for t, n in zip(texts, groups, strict=True))
    assert cut <= 8


def test_sharding_awkward(spark):
    frame = awkward(spark)
    found = sharding.digest(sharding.balanced_shards(frame)).toPandas()
    check_shards(found, frame.toPandas(), 24)
    assert found.loc[found["doc_id"] == 0, ["size", "text_crc32"]].iloc[0].tolist() == [8, 0]
    assert sharding.balanced_shards(empty(frame)).count() == 0


@pytest.mark.parametrize("groups", [[2, 2, 2], [3, 1], [4, 4, 1, 1, 1, 1], [6, 2, 2, 2], [5, 3, 2, 2], [2] * 6 + [1] * 4, [7], [3, 3, 3, 3]])
def test_sharding_keeps_about_as_many_links_as_can_be(spark, groups):
    rows = [f"text number {g}" for g, n in enumerate(groups) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    placed = sharding.balanced_shards(docs, shards=3)
    kept, total = sharding.cut_edges(placed, docs).first()
    best = sharding.brute_force(groups, 3)
    assert total == sum(n * (n - 1) // 2 for n in groups) and kept <= best
    KEPT.append((kept, best))


KEPT: list[tuple[int, int]] = []


def test_sharding_against_the_optimum():
    """Over all the tables of the test before, which have a few rows to a shard: where counts must be even, more than half of what can be kept."""
    assert len(KEPT) in (0, 8) and (not KEPT or sum(k for k, _ in KEPT) >= 0.6 * sum(b for _, b in KEPT))


def test_sharding_cuts_few_links_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept, total = sharding.cut_edges(sharding.balanced_shards(docs), docs).first()
    assert total > 50 and kept >= 0.9 * total


def test_sharding_plans_are_native(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(sharding, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.checkpoint())
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(60)], "doc_id long, text string").withColumn("a.b", F.lit(1))
    plans.append(sharding.digest(sharding.balanced_shards(docs, shards=4))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any(word in plan for plan in plans for word in ("Python", "Pandas", "Arrow"))


# --- 9 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("total", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_one_to_one(total):
    slots = training_order.permute(np.arange(total), total, 7)
    assert sorted(slots) == list(range(total))
    assert (training_order.permute(slots, total, 7, back=True) == np.arange(total)).all()
    if total > 100:
        assert (slots != training_order.permute(np.arange(total), total, 8)).any()


def split_stream(read: dict[int, bytes], key: int, vocabulary: int) -> list[list[int]]:
    """Documents in order from the sequences of all slots."""
    order = training_order.permute(np.arange(len(read)), len(read), key)
    ids = np.concatenate([np.frombuffer(read[int(s)], "<u2" if vocabulary < 1 << 16 else "<u4") for s in order]).tolist()
    ends = [i for i, t in enumerate(ids) if t == vocabulary]
    return [ids[a + 1 : b] for a, b in zip([-1, *ends[:-1]], ends, strict=True)]


def test_training_order_matches_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    docs = [(i, sentence(rnd, rnd.randint(1, 200))) for i in range(40)] + [(90, ""), (91, None), (92, "x" * 700), (92, "x" * 700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"data": F.lit("clash"), "task": F.lit(1), "a.b": F.lit(2)})
    want = training_order.brute_force([list((t or "").encode()) for _, t in docs], 128, 16, 5, 256)
    one = training_order.digest(training_order.shards(frame.coalesce(1), length=128, records=16, key=5))
    assert {r["shard"]: r["payload_sha256"] for r in one.collect()} == want
    path = str(tmp_path / "shards")
    training_order.write(frame.repartition(5), path, length=128, records=16, key=5, lane=2)
    read = dict(training_order.read_from(spark, path, 0, 16, lane=2))
    total = -(-sum(len((t or "").encode()) + 1 for _, t in docs if t) // 128)
    assert list(read) == list(range(total)) and {len(t) for s, t in read.items()} <= {256, len(read[training_order.permute(np.array([total - 1]), total, 5)[0]])}
    assert sorted(split_stream(read, 5, 256)) == sorted(list(t.encode()) for _, t in docs if t)
    for slot in (1, total // 2, total - 1):
        assert list(training_order.read_from(spark, path, slot, 16, lane=2)) == [(s, t) for s, t in read.items() if s >= slot]
    assert list(training_order.read_from(spark, path, total, 16, lane=2)) == []


def test_training_order_reads_by_lane(spark, tmp_path):
    """A lane is picked in the scan, by the files' own bounds, and without a shuffle of the table."""
    frame = spark.createDataFrame([(i, "y" * 500) for i in range(60)], "doc_id long, text string")
    path = str(tmp_path / "lanes")
    training_order.write(frame, path, length=64, records=4, lane=4)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    rows = spark.read.parquet(path).where("lane = 3")
    # Files are ranges of lanes in order.
    bounds = sorted(tuple(r) for r in spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.min("shard"), F.max("shard")).select("min(shard)", "max(shard)").collect())
    assert len(bounds) > 1 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    assert rows.select("shard").distinct().count() == 4 == rows.count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lane,3)" in plan and "Exchange" not in plan


@pytest.mark.parametrize(("vocabulary", "stride"), [(49_152, 4 + 2 * 16), (65_535, 4 + 2 * 16), (65_536, 4 + 4 * 16), (200_000, 4 + 4 * 16)])
def test_training_order_takes_ids(spark, tmp_path, vocabulary, stride):
    rnd = random.Random(4)
    docs = [(i, [rnd.randrange(vocabulary) for _ in range(n)]) for i, n in enumerate([1, 15, 16, 17, 32, 33, 100])]
    docs[3][1][:2] = [0, vocabulary - 1]
    arrays = spark.createDataFrame([*docs, (90, []), (91, None)], "doc_id long, ids array<int>")
    binary = spark.createDataFrame([(d, bytearray(np.array(ids, "<u4").tobytes())) for d, ids in docs] + [(90, bytearray()), (91, None)], "doc_id long, ids binary")
    for name, frame, width in (("arrays", arrays, None), ("binary", binary, 4)):
        path = str(tmp_path / name)
        training_order.write(frame, path, text_col="ids", length=16, records=8, key=5, vocabulary=vocabulary, width=width)
        read = dict(training_order.read_from(spark, path, 0, 8, vocabulary))
        assert sorted(split_stream(read, 5, vocabulary)) == sorted(ids for _, ids in docs)
        rows = spark.read.parquet(path).collect()
        assert {r["stride"] for r in rows} == {stride} and all(len(r["payload"]) == stride * r["n_records"] for r in rows)
        assert sum(r["n_tokens"] for r in rows) == sum(len(ids) + 1 for _, ids in docs)


def test_training_order_encodes_texts_in_one_pass(spark):
    docs = [*awkward(spark).select("doc_id", "text").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    tokenizer, vocabulary = library(), bpe.vocabulary(tokenizer_path())
    ids = [tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in docs]
    want = training_order.brute_force(ids, 64, 16, 5, vocabulary)
    found = training_order.digest(training_order.shards(frame, length=64, records=16, key=5, vocabulary=vocabulary, tokenizer=tokenizer_path()))
    assert {r["shard"]: r["payload_sha256"] for r in found.collect()} == want and len(want) > 10
    assert training_order.shards(empty(frame), vocabulary=vocabulary, tokenizer=tokenizer_path()).count() == 0


def test_training_order_refuses_other_ids(spark):
    for ids in ([-1, 2], [300], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            training_order.packed(np.array(ids), None, 300)
    for data in (np.array([7, 300], "<u4").tobytes(), b"12345"):
        with pytest.raises(ValueError):
            training_order.packed(data, 4, 300)
    with pytest.raises(ValueError):
        training_order.shards(spark.createDataFrame([(1, bytearray(b"ab"))], "doc_id long, text binary"))


def test_training_order_query_has_the_encoder_s_ids(spark, small):
    from tokenizers import Tokenizer

    import __spark_entry__ as entry

    tokenizer = Tokenizer.from_file(tokenizer_path())
    counts = [len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    tokens = sum(n + 1 for n in counts if n)
    got = entry.queries()["op9_training_order"](spark, small).agg(F.sum("n_records"), F.sum("n_tokens"), F.max("stride")).first()
    assert tuple(got) == (-(-tokens // training_order.LENGTH), tokens, 4 + 2 * training_order.LENGTH)


def test_training_order_awkward(spark):
    frame = awkward(spark)
    found = training_order.shards(frame).agg(F.sum("n_tokens"), F.sum("n_records")).first()
    assert found[0] == frame.where("text <> ''").agg(F.sum(F.octet_length("text") + 1)).first()[0]
    assert training_order.shards(empty(frame)).count() == 0


# --- 10 -------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.digest(language.identify(docs, language.fit(docs))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98
    assert not found["rejected"].any() and found["score"].between(0, 1).all()


def test_language_rejects_what_is_far(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    rnd = random.Random(1)
    noise = "".join(rnd.choice("bcdfghjklmnpqrstvwxz ") for _ in range(3000))
    langs, scores, rejected = model.predict([noise, "Привет " * 100, None, "", "12 !?", "«»"])
    assert rejected.all() and langs[2:] == ["und"] * 4 and not scores[2:].any()
    assert set(langs[:2]) <= {"en", "fr", "de", "es"}


def test_language_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.fit(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()][:60] + [None, "", "12 !?", "x", "Été à l'œuvre", "漢字 kanji"]
    langs, scores, _ = model.predict(texts)
    want = language.brute_force(model, texts)
    assert langs == [lang for lang, _ in want] and np.allclose(scores, [s for _, s in want], atol=1e-4)


def test_language_learns_from_a_text_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs, sample=20)
    one = docs.where("lang = 'en' and length(text) > 500").limit(1)
    copies = one.crossJoin(spark.range(400).withColumnRenamed("id", "n")).select((F.col("n") * 4 + 10**6).alias("doc_id"), "text", "lang")
    again = language.fit(docs.unionByName(docs).unionByName(copies).repartition(5), sample=20)
    assert model.langs == again.langs and (model.centroids == again.centroids).all() and (model.idf == again.idf).all()


def test_language_counts_do_not_depend_on_chunks(monkeypatch):
    text = sentence(random.Random(2), 500)
    whole = language.counts_of(text)
    monkeypatch.setattr(language, "CHUNK", 97)
    assert (language.counts_of(text) == whole).all()


def test_language_awkward(spark):
    frame = awkward(spark)
    for docs in (frame, empty(frame)):
        model = language.fit(docs)
        assert language.identify(frame, model).count() == frame.count()
        kept = language.accepted(frame, model)
        assert kept.columns == frame.columns and kept.where("text is null or text = ''").count() == 0
    assert language.fit(empty(frame)).predict(["some text"])[0] == ["und"]
    assert language.identify(empty(frame), language.fit(frame)).count() == 0
    dotted = frame.select("doc_id", "text", "lang").toDF("doc.id", "the text", "the.lang")
    model = language.fit(dotted, "doc.id", "the text", "the.lang")
    assert language.digest(language.identify(dotted, model, "doc.id", "the text"), "doc.id").count() == frame.count() and language.accepted(dotted, model, "the text").columns == dotted.columns


def test_no_operator_hides_import_errors():
    root = Path(bpe.__file__).parent
    assert not any("ImportError" in p.read_text() for p in root.glob("*.py"))

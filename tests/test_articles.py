"""XML records, quality, chunks, stores, crawl, retrieval, answers, topics, streams, the engine end to end."""

import json
import random
import re
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.operators import answers, articles, retrieval, topics
from scholia.plans import engine
from scholia.plans.predicate import search
from scholia.plans.request import TopicRequest
from scholia.sources import generations, records
from scholia.streaming import jobs

XML = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle Status="x"><MedlineCitation Status="MEDLINE"/><Language>eng</Language><PMID>11</PMID><ArticleTitle>Plain title <i>of</i> the thing</ArticleTitle>
<Abstract><AbstractText Label="BACKGROUND">One &lt; two</AbstractText><AbstractText> </AbstractText><AbstractText Label="">Three <i>it</i> tail</AbstractText></Abstract>
<AuthorList><Author><LastName>Li</LastName><ForeName>Ann</ForeName><Initials>A</Initials></Author><Author><LastName>Bo</LastName><Initials>B</Initials></Author><Author><LastName>Solo</LastName></Author><Author><ForeName>No</ForeName></Author><Author><CollectiveName> The Group </CollectiveName></Author><Author><CollectiveName/></Author></AuthorList>
<Journal><Title/></Journal><MedlineTA>J Med</MedlineTA><PubDate><Year>2022</Year><Month>Dec</Month><Day>3</Day></PubDate><ArticleId IdType="pii">p</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId>
<MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading><MeshHeading><DescriptorName>Mice</DescriptorName></MeshHeading><Keyword>k1</Keyword><Keyword/><PublicationType>Review</PublicationType></PubmedArticle>
<PubmedArticle><MedlineCitation Status="In-Process"/><Language>lat</Language><ArticleId IdType="pmc">P1</ArticleId><ArticleId IdType="mid">N1</ArticleId><PMID>12</PMID><ArticleTitle><i>Lead</i> rest</ArticleTitle><Journal><Title>J</Title></Journal><PubDate><MedlineDate>2020 Jan-Feb</MedlineDate></PubDate></PubmedArticle>
<PubmedArticle><PMID>13</PMID><ArticleTitle>x</bad></PubmedArticle>
<PubmedArticle><ArticleTitle>Four</ArticleTitle><PubDate/><ArticleDate><Year>2021</Year><Month>Spring</Month></ArticleDate></PubmedArticle>
<PubmedArticle><PMID>11</PMID><PubDate><Year>2022</Year><Day>4</Day></PubDate></PubmedArticle></PubmedArticleSet>"""


@pytest.fixture(scope="module")
def extracted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("xml")
    (folder / "a.xml").write_text(XML)
    return articles.extract_articles(records.read_xml_records(spark, str(folder)))


def test_extraction(extracted):
    rows = {r["article_index"]: r.asDict() for r in extracted.collect()}
    assert sorted(rows) == [1, 2, 4, 5]
    assert rows[1] == {
        "article_index": 1, "pmid": "11", "title": "Plain title ", "abstract": "BACKGROUND: One < two Three", "authors": "Li, Ann; Bo, B; Solo; The Group", "journal": "J Med",
        "publication_date": "2022-12-03", "doi": "10.1/x", "mesh_terms": ["Humans", "Mice"], "keywords": ["k1"], "publication_types": ["Review"], "lang": "en", "subsets": ["medline", "full text"],
    }
    assert (rows[2]["title"], rows[2]["publication_date"], rows[2]["journal"], rows[2]["doi"]) == ("No Title", "Unknown Date", "J", None)
    assert (rows[4]["pmid"], rows[4]["publication_date"], rows[4]["abstract"], rows[4]["authors"]) == ("unknown", "2021-Spring", "No Abstract", "Unknown Authors")
    assert rows[5]["publication_date"] == "2022" and rows[5]["mesh_terms"] == []
    assert (rows[2]["lang"], rows[2]["subsets"]) == ("lat", ["in process", "pmc", "full text", "free full text", "nihms"]) and (rows[4]["lang"], rows[4]["subsets"]) == (None, [])
    found = lambda q: sorted(r["article_index"] for r in search(articles.with_date_bounds(extracted), q).collect())
    assert found("medline[sb]") == [1] and found("full text[sb] NOT free full text[sb]") == [1] and found("english[lang]") == [1] and found("NOT medline[sb]") == [2, 4, 5]


def test_records_are_read_as_xml_is(spark):
    """What patterns get wrong: markup in attributes, CDATA, comments, entities, names that begin alike."""
    texts = [
        """<PubmedArticle><PMID Version="1>0">1</PMID><ArticleTitle><![CDATA[A <b>title</b> & more]]></ArticleTitle><AbstractText NlmCategory='a>b' Label="BMI > 30">First</AbstractText><AbstractText Label='"q" &lt;x&gt; &#38;'>Second</AbstractText></PubmedArticle>""",
        """<PubmedArticle><PMIDList>9</PMIDList><PMID>2</PMID><!-- <ArticleTitle>no</ArticleTitle> > --><ArticleTitle>One<!-- > --> two</ArticleTitle><AbstractText><![CDATA[]]></AbstractText><Author><LastName>O&apos;B&#x65;</LastName><ForeName> </ForeName><Initials>C</Initials></Author>
        <ArticleId IdType='doi' Note="a>b">10/x</ArticleId><PubDate>\n<Year>2020</Year><Month>07</Month></PubDate></PubmedArticle>""",
        "<PubmedArticle><PMID>3</PMID><ArticleTitle>&undefined;</ArticleTitle></PubmedArticle>", "<PubmedArticle><PMID>4</PMID>", "", " \n", "<PubmedArticle/>",
    ]
    frame = spark.createDataFrame([*enumerate(texts), (99, None)], "article_index int, xml string")
    rows = {r["article_index"]: r for r in articles.extract_articles(frame).collect()}
    assert sorted(rows) == [0, 1, 6]
    assert (rows[0]["pmid"], rows[0]["title"], rows[0]["abstract"]) == ("1", "A <b>title</b> & more", 'BMI > 30: First "q" <x> &: Second')
    assert (rows[1]["pmid"], rows[1]["title"], rows[1]["abstract"], rows[1]["authors"], rows[1]["doi"], rows[1]["publication_date"]) == ("2", "One two", "No Abstract", "O'Be, C", "10/x", "2020-07")
    assert (rows[6]["pmid"], rows[6]["title"], rows[6]["lang"], rows[6]["subsets"]) == ("unknown", "No Title", None, [])


def test_records_are_numbered_over_blocks(spark, tmp_path):
    """Records keep their numbers by file however many blocks and files a task reads, and no record is shuffled."""
    for name, n in (("a", 300), ("b", 40), ("c", 0)):
        (tmp_path / f"{name}.xml").write_text("<PubmedArticleSet>" + "\n".join(f"<PubmedArticle><PMID>{name}{i}</PMID>{'pad ' * (i % 50)}</PubmedArticle>" for i in range(1, n + 1)) + "</PubmedArticleSet>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        found = records.read_xml_records(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 5
        got = sorted((r["file"][-5], r["article_index"], r["xml"].split("<PMID>")[1].split("<")[0]) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("a", i, f"a{i}") for i in range(1, 301)] + [("b", i, f"b{i}") for i in range(1, 41)])
    assert "BroadcastHashJoin" in plan

@pytest.mark.parametrize(
    ("pmid", "title", "abstract", "good"),
    [("1", "t" * 10, "a" * 50, True), ("1", "t" * 9, "a" * 50, False), ("1", "t" * 49, "a" * 49, False), ("1", "t" * 50, "a" * 49, True), ("1", "t" * 50, "No Abstract", True), ("unknown", "t" * 50, "a" * 50, False), (None, "t" * 50, "a" * 50, False), ("1", "No Title", "a" * 50, False), ("1", " " * 5 + "t" * 9, "a" * 50, False), ("1", "t" * 10, None, False)],
)
def test_quality(spark, pmid, title, abstract, good):
    frame = spark.createDataFrame([(pmid, title, abstract)], "p string, t string, a string")
    assert frame.select(articles.is_valid(F.col("p"), F.col("t"), F.col("a"))).first()[0] is good


def test_date_bounds(spark):
    frame = articles.with_date_bounds(spark.createDataFrame([("2022-02-03",), ("2020-02",), ("2021",), ("Unknown Date",)], "publication_date string"))
    assert [(str(r[1]), str(r[2])) for r in frame.collect()] == [("2022-02-03", "2022-02-03"), ("2020-02-01", "2020-02-29"), ("2021-01-01", "2021-12-31"), ("None", "None")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=3000))
def test_splitter(text):
    pieces = articles.split_text(text)
    assert all(len(p) <= 400 or not any(s in p[1:] for s in articles.SEPARATORS) for p in pieces)
    squeezed = lambda t: "".join(t.split())
    at, whole = 0, squeezed(text)
    for piece in map(squeezed, pieces):  # pieces cover the text in order, with overlaps
        found = whole.find(piece, max(0, at - 60))
        assert 0 <= found <= at
        at = max(at, found + len(piece))
    assert at == len(whole)


def test_splitter_keeps_separators_in_front():
    text = ". ".join(f"Sentence number {i} of a long abstract" for i in range(40))
    pieces = articles.split_text(text)
    assert len(pieces) > 3 and all(p.startswith(". ") for p in pieces[1:]) and pieces[0].startswith("Sentence")


def test_chunks(spark):
    base = articles.articles_of_documents(spark.createDataFrame([(1, "T" * 20 + "\n" + "word " * 155 + "word", "en", "s"), (3, "T" * 20 + "\n" + "word " * 156, "en", "s"), (2, "A title here\n" + "w. " * 300, "en", "s")], "doc_id long, text string, lang string, source string"))
    rows = articles.chunks(base).collect()
    by = {}
    for r in rows:
        by.setdefault(r["metadata"]["pubmed_id"], []).append(r)
    assert len(by["1"]) == 1 and len(by["3"]) > 2
    split = [r for r in by["2"] if r["metadata"]["chunk_type"] == "abstract_split"]
    assert split[1]["content"].startswith("Abstract Chunk 2: ") and split[1]["metadata"]["chunk_id"] == "2_abs_1" and split[0]["metadata"]["chunk_index"] == 0
    main = next(r for r in by["2"] if r["metadata"]["chunk_type"] == "title_abstract")
    assert main["content"].startswith("[PMID: 2]\nTitle: A title here\nAuthors: Unknown Authors\n\nAbstract: A title") and main["metadata"]["chunk_id"] is None


def test_stores(spark, tmp_path):
    base = articles.articles_of_documents(spark.createDataFrame([(1, "A title here\n" + "w. " * 300, "en", "s"), (2, "B title", "en", "t")], "doc_id long, text string, lang string, source string"))
    records.write_chunk_store(articles.chunks(base), str(tmp_path / "chunks"))
    found = records.read_chunk_store(spark, str(tmp_path / "chunks"), "s")
    assert found.count() == articles.chunks(base).where("metadata.topic_id = 's'").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*topic#\d+ = s", plan) and found.columns == ["content", "metadata"]
    with pytest.raises(records.NotFound):
        records.read_chunk_store(spark, str(tmp_path / "chunks"), "zzz")
    odd = articles.articles_of_documents(spark.createDataFrame([(1, "A title here", "en", "x/../y"), (2, "B title", "en", "007"), (3, "C title", "en", "7")], "doc_id long, text string, lang string, source string"))
    records.write_chunk_store(articles.chunks(odd), str(tmp_path / "odd"))
    assert [records.read_chunk_store(spark, str(tmp_path / "odd"), t).count() for t in ("x/../y", "007", "7")] == [1, 1, 1]
    assert records.topic_folder(spark, str(tmp_path / "odd"), "topic", "x/../y") == f"{tmp_path}/odd/topic=x%2F..%2Fy" and (tmp_path / "odd" / "topic=x%2F..%2Fy").is_dir()
    with pytest.raises(ValueError):
        records.topic_folder(spark, "base", "topic", " ")
    (tmp_path / "one.json").write_text(json.dumps([{"content": "c", "metadata": {"topic_id": "q", "pubmed_id": "5"}}]))
    assert records.read_chunk_store(spark, str(tmp_path / "one.json"), "q", multiline=True).first()["metadata"]["pubmed_id"] == "5"
    (tmp_path / "search.json").write_text(json.dumps({"esearchresult": {"count": "7", "idlist": ["3", "4"]}}))
    assert sorted(map(tuple, records.read_search_response(spark, str(tmp_path / "search.json")).collect())) == [(7, "3"), (7, "4")]


def test_crawl(spark):
    html = '<div class="article big"><h2>Head &amp; more</h2><p>One <b>bold</b> end</p><div><p>Two</div><a href="/x?y=1">go</a></div><div class="article"><h2></h2><p>no title</p></div><div class="other"><h2>No</h2><p>No</p></div>'
    found = records.crawl_items(spark.createDataFrame([(1, "http://h.example/a/b", html), (2, None, None)], "page_id long, url string, html string")).collect()
    assert [tuple(r) for r in found] == [(1, "Head & more", ["One ", " end", "Two"], "http://h.example/x?y=1")]


def test_nearest_scopes_and_ties(spark):
    rows = [(i, "a" if i % 2 else "b", [1.0, 0.0] if i < 8 else [0.0, float(i)]) for i in range(20)] + [(99, "a", None)]
    frame = spark.createDataFrame(rows, "vec_id long, scope string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "c", [1.0, 0.0])], "query_id long, scope string, query_embedding array<double>")
    found = retrieval.nearest(frame, asked, 4, scope_col="scope").orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 3, 5, 7] and {r["query_id"] for r in found} == {1}


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_nearest_in_blocks(spark, monkeypatch, most):
    """More queries than a block, more vectors than a shard, in one pass over the vectors, sent or joined."""
    rng = np.random.default_rng(0)
    rows, asks = rng.normal(size=(500, 8)), rng.normal(size=(2000, 8))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").unionByName(spark.createDataFrame([(9000, [1.0]), (9001, None), (9002, [])], "vec_id long, embedding array<double>"))
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asks)], "query_id long, query_embedding array<double>")
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 60)
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", most)
    ranked = retrieval.nearest(frame, asked, 5)
    assert len(re.findall("MapInArrow", ranked._jdf.queryExecution().optimizedPlan().toString())) == (2 if most else 1)
    found = ranked.toPandas()
    assert len(found) == 10000
    away = ((asks[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2)
    for q, part in found.groupby("query_id"):
        assert part.sort_values("rank")["vec_id"].tolist() == np.argsort(away[q], kind="stable")[:5].tolist()


def slow_mmr(query, rows, k, weight):
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    chosen = []
    while len(chosen) < min(k, len(rows)):
        best, score = None, -np.inf
        for i in range(len(rows)):
            if i not in chosen:
                now = weight * cosine(query, rows[i]) - (1 - weight) * max([cosine(rows[i], rows[j]) for j in chosen], default=0) if chosen else cosine(query, rows[i])
                if now > score + 1e-12:
                    best, score = i, now
        chosen.append(best)
    return chosen


def test_mmr():
    rng = np.random.default_rng(1)
    rows, query = rng.normal(size=(40, 6)), rng.normal(size=6)
    assert retrieval.mmr_order(query, rows, 15) == slow_mmr(query, rows, 15, 0.7)
    by_cosine = np.argsort(-(rows @ query) / np.linalg.norm(rows, axis=1))
    assert retrieval.mmr_order(query, rows, 10, 1.0) == by_cosine[:10].tolist()
    assert sorted(retrieval.mmr_order(query, rows, 99)) == list(range(40))


def test_embedding_is_stable(spark):
    frame = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "i int, t string")
    rows = {r["i"]: np.array(r["embedding"]) for r in retrieval.embed(frame, "t").collect()}
    assert not np.array_equal(rows[1], retrieval.hash_embedder()(["b a b"])[0])
    slow = np.zeros(256)
    for word in ["a", "b", "a"]:
        code = xxhash.xxh64_intdigest(word)
        slow[code % 256] += 1 if code >> 63 else -1
    assert np.allclose(rows[1], slow / np.linalg.norm(slow), atol=1e-6)
    assert np.allclose(rows[1], retrieval.hash_embedder()(["a b a"])[0]) and abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and not rows[2].any() and not rows[3].any()
    custom = retrieval.embed(frame, "t", lambda texts: np.ones((len(texts), 3), np.float32))
    assert custom.first()["embedding"] == [1.0, 1.0, 1.0]


def test_answers(spark):
    asked = spark.createDataFrame([(1, "s", "What about insulin resistance?"), (2, "s", "Anything on volcanoes?"), (3, "t", "insulin")], "query_id long, topic_id string, text string")
    passages = spark.createDataFrame([(1, 2, "Insulin falls. Cats sleep."), (1, 1, "Birds fly. There is insulin resistance in mice."), (2, 1, "Nothing fits.")], "query_id long, position int, content string")
    counts = spark.createDataFrame([("s", 3)], "topic_id string, articles long")
    found = dict(map(tuple, answers.answer_questions(asked, passages, counts).collect()))
    assert found[1].startswith("There is insulin resistance in mice. Insulin falls.")
    assert found[2] == found[3] and found[2].startswith("I don't have specific information")
    loud = dict(map(tuple, answers.answer_questions(asked, passages, counts, lambda prompts: [p.upper() for p in prompts]).collect()))
    assert "INSULIN RESISTANCE" in loud[1]


def test_paging_parts_the_whole(spark):
    frame = spark.range(95).select(F.lit("s").alias("topic_id"), F.col("id").alias("pmid"))
    seen = [r["pmid"] for o in range(0, 100, 20) for r in topics.page(frame, F.col("topic_id") == "s", 20, o).collect()]
    assert seen == list(range(95))
    assert topics.page_info(frame, F.col("topic_id") == "s", 20, 80).first()["has_more"] is False
    with pytest.raises(ValueError):
        topics.expired(frame, F.current_timestamp(), 0)


def test_status_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s).isoformat()

    def drop(name, *events):
        (source / name).write_text("\n".join(json.dumps({"topic_id": t, "event": e, "max_results": n, "ts": at(s)}) for t, e, n, s in events))

    stream = jobs.status_machine(jobs.read_events(spark, str(source)), "1 second")
    query = stream.writeStream.outputMode("append").format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "cp")).start()
    kept = []
    try:
        for n, events in enumerate([
            [("a", "start", 1, 0), ("b", "start", 1, 0), ("c", "start", 1, 1), ("c", "error", 1, 5), ("d", "start", 1, 2)],
            [("a", "done", 1, 30), ("d", "done", 1, 90)],  # d ends in time order, but after its deadline of 64
            [("z", "start", 1, 500)], [("c", "start", 1, 600), ("z", "done", 1, 501)],  # c starts again too early
            [("y", "start", 1, 5000)], [("c", "start", 1, 5001)], [("x", "start", 1, 20000)],
        ]):
            drop(f"{n}.json", *events)
            query.processAllAvailable()
            progress = query.lastProgress
            kept.append(progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else None)
    finally:
        query.stop()
    found = {}
    for r in spark.sql("select topic_id, status from statuses").collect():
        found.setdefault(r["topic_id"], []).append(r["status"])
    assert found["a"] == ["processing", "completed"] and found["b"] == ["processing", "timeout"] and found["d"] == ["processing", "timeout"]
    assert found["c"][:3] == ["processing", "failed", "processing"] and found["z"] == ["processing", "completed"] and "x" in found
    assert kept[-1] < len(found)  # states of ended jobs go
    told = spark.createDataFrame([("d", "start", 1, at(2), 1), ("d", "done", 1, at(90), 2), ("a", "start", 1, at(0), 3), ("a", "done", 1, at(30), 4)], "topic_id string, event string, max_results int, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {r["topic_id"]: r["status"] for r in topics.outcomes(told, F.lit(at(100)).cast("timestamp")).collect()}
    assert batch == {"d": "timeout", "a": "completed"}


def test_ingest_stream(spark, small, tmp_path):
    source = tmp_path / "requests"
    source.mkdir()
    rows = [("t", "the", 5), ("bad", "the AND", 5), ("worse", "the", 0)]
    (source / "1.json").write_text("\n".join(json.dumps({"topic_id": t, "query": q, "max_results": n, "ts": "2024-01-01T00:00:00"}) for t, q, n in rows))
    documents = articles.articles_of_documents(spark.read.parquet(f"{small}/documents.parquet"))
    path = str(tmp_path / "store")
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest_requests(documents, jobs.read_events(spark, str(source), jobs.REQUESTS), path, str(tmp_path / "cp"), date(2024, 1, 1)).awaitTermination(120)
    log = engine.read_log(spark, path)
    assert {t: engine.topic_status(log, t) for t, _, _ in rows} == {"t": "completed", "bad": "failed", "worse": "failed"}
    assert log.where("topic_id = 't'").count() == 2 and spark.read.parquet(f"{path}/articles").count() == 5


def dated_articles(spark):
    rows = [(str(i), f"Insulin study number {i}", ("Insulin works in mice. " * (i % 4 + 1)) + "It was a long study of many sides and ends. " * (25 if i % 5 == 0 else 1), f"{2015 + i % 10}-0{i % 9 + 1}") for i in range(1, 31)]
    base = articles.articles_of_documents(spark.createDataFrame([(int(i), t + "\n" + a, "en", "s") for i, t, a, _ in rows], "doc_id long, text string, lang string, source string"))
    dates = spark.createDataFrame([(i, d) for i, _, _, d in rows], "pmid string, day string")
    return base.join(dates, "pmid").withColumn("publication_date", F.col("day")).drop("day"), rows


def test_hits_by_relevance_and_date(spark):
    source, rows = dated_articles(spark)
    found = [r["pmid"] for r in engine.hits(source, spark, TopicRequest(topic="mice", max_results=8), date(2024, 6, 1)).collect()]
    assert found == [i for i, _, a, _ in sorted(rows, key=lambda r: (-r[2].lower().count("mice"), r[0]))][:8]
    recent = engine.hits(source, spark, TopicRequest(topic="mice", max_results=100, filters={"publication_date": "1_year"}), date(2024, 6, 1)).collect()
    assert {r["pmid"] for r in recent} == {i for i, _, _, d in rows if "2023-06" <= d <= "2024-06"} and recent
    asked = engine.hits(source, spark, TopicRequest(topic="what is the latest treatment with insulin?", auto_transform=False, max_results=100), date(2024, 6, 1))
    assert asked.count() == 0
    latest = engine.query_of(spark, TopicRequest(topic="latest side effects of insulin"), date(2024, 6, 1))
    assert latest.endswith('("2019"[Date - Publication] : "3000"[Date - Publication])')


def test_engine_end_to_end(spark, small, tmp_path):
    """Fetch, status, ask, follow up, page, clean up."""
    source, _ = dated_articles(spark)
    path = str(tmp_path / "store")
    done = engine.ingest(source, spark, TopicRequest(topic="insulin", max_results=20), None, path, date(2024, 1, 1))
    t1 = done["topic_id"]
    assert len(t1) == 36 and done["status"] == "completed" and done["article_count"] == 20 and done["chunk_count"] > 20
    bare = engine.ingest(source, spark, TopicRequest(topic="insulin", max_results=5, create_embeddings=False), "t2", path, date(2024, 1, 1))
    none = engine.ingest(source, spark, TopicRequest(topic="qqqqqq"), "t3", path, date(2024, 1, 1))
    bad = engine.ingest(source, spark, TopicRequest(advanced_query="insulin AND"), "t4", path, date(2024, 1, 1))
    slow = engine.ingest(source.withColumn("title", F.udf(lambda t: __import__("time").sleep(2) or t)("title")), spark, TopicRequest(topic="insulin"), "t5", path, date(2024, 1, 1), timeout=1.5)
    assert (bare["article_count"], none["article_count"], bad["status"], slow["status"]) == (5, 0, "failed", "timeout") and "too early" in bad["error"]
    log = engine.read_log(spark, path)
    assert [engine.topic_status(log, t) for t in (t1, "t2", "t3", "t4", "t5", "t8")] == ["completed", "completed", "completed", "failed", "timeout", "not_found"] and engine.active_tasks(log) == 0
    assert json.loads(log.where(f"topic_id = '{t1}' and status = 'completed'").first()["detail"]) == {"article_count": 20, "chunk_count": done["chunk_count"]}
    rows, info = engine.articles_page(spark, path, t1, 10, 15)
    assert rows.count() == 5 and tuple(info.first()) == (20, 10, 15, False)
    assert engine.articles_page(spark, path, "t4")[0].count() == 0
    asked = spark.createDataFrame([(1, "Does insulin work in mice?"), (2, "What of volcanoes?")], "query_id long, text string")
    first = {r["query_id"]: r for r in engine.answer(spark, path, asked, t1).collect()}
    assert "Insulin works in mice." in first[1]["answer"] and first[2]["answer"].startswith("I don't have specific") and first[1]["conversation_id"] != first[2]["conversation_id"]
    again = spark.createDataFrame([(3, "And in people?", first[1]["conversation_id"]), (4, "Any more?", first[1]["conversation_id"])], "query_id long, text string, conversation_id string")
    seen = []
    told = {r["query_id"]: r for r in engine.answer(spark, path, again, t1).collect()}
    assert "Insulin works in mice." in told[3]["answer"]  # the question alone has no word of it
    turns = engine.memory(spark, path).where(F.col("conversation_id") == first[1]["conversation_id"]).orderBy("turn").collect()
    assert [(r["turn"], r["role"]) for r in turns] == [(n, ("user", "assistant")[n % 2]) for n in range(6)] and [r["text"] for r in turns][::2] == ["Does insulin work in mice?", "And in people?", "Any more?"]
    assert engine.memory(spark, path, keep=1).select("conversation_id").distinct().count() == 1 and not seen
    for topic in ("t2", "t8"):
        with pytest.raises(records.NotFound):
            engine.answer(spark, path, asked, topic)
    with pytest.raises(RuntimeError):
        engine.answer(spark, path, asked, "t4")
    with pytest.raises(records.NotFound):
        engine.articles_page(spark, path, "t8")
    assert engine.storage_status(spark, path)["topics"] == 1
    found = engine.catalog_status(spark, path)
    assert found["log"] == 10 and found["articles"] == 25 and engine.catalog_status(spark, str(tmp_path / "none"))["index"] is None
    assert engine.model_status() == {"embedder": "hashing", "dims": 256, "generator": "extractive"}
    assert engine.embedding_rate(spark, spark.createDataFrame([("a b",)], "text string"))["texts"] == 1
    with pytest.raises(records.NotFound):
        engine.cleanup_topic(spark, path, "x/..")
    engine.append_status(spark, path, "x/..", "completed")
    assert engine.cleanup_topic(spark, path, "x/..")["files_cleaned"] is False and (tmp_path / "store" / "index").is_dir() and engine.storage_status(spark, path)["topics"] == 1
    assert engine.cleanup_old(spark, path, datetime(2020, 1, 1)) == {"total": 0, "cleaned": 0, "failed": 0}
    assert engine.cleanup_topic(spark, path, t1) == {"topic_id": t1, "files_cleaned": True, "conversations_removed": 2, "status": "cleaned"}
    assert engine.cleanup_old(spark, path, datetime(2100, 1, 1)) == {"total": 4, "cleaned": 1, "failed": 3}
    assert engine.topic_status(engine.read_log(spark, path), t1) == "cleaned" and engine.memory(spark, path).count() == 0
    assert engine.health(spark)["status"] == "ok"


def test_ingest_in_generations(spark, tmp_path):
    """A topic fetched twice is there once, a fetch that fails changes nothing, and readers keep what they began with."""
    source, _ = dated_articles(spark)
    path, day = str(tmp_path / "store"), date(2024, 1, 1)
    first = engine.ingest(source, spark, TopicRequest(topic="insulin", max_results=20), "t", path, day)
    reading, _ = engine.articles_page(spark, path, "t", 100)
    for _ in range(2):
        again = engine.ingest(source, spark, TopicRequest(topic="insulin", max_results=20), "t", path, day)
        assert again == first
    rows, info = engine.articles_page(spark, path, "t", 100)
    assert rows.count() == 20 and info.first()["total"] == 20 and sorted(rows.columns) == sorted(reading.columns) and "generation" not in rows.columns
    found = engine.catalog_status(spark, path)
    assert (found["articles"], found["chunks"], found["log"]) == (20, first["chunk_count"], 6) and found["index"] == first["chunk_count"]
    # One generation is kept for readers who began with it, older ones are gone.
    folders = sorted(p.name for p in (tmp_path / "store" / "articles" / "topic_id=t").iterdir())
    valid = engine.valid_generation(engine.read_log(spark, path), "t")
    assert len(folders) == 2 and f"generation={valid}" in folders
    reading, _ = engine.articles_page(spark, path, "t", 100)
    failed = engine.ingest(source, spark, TopicRequest(advanced_query="insulin AND"), "t", path, day)
    broken = engine.ingest(source.withColumn("abstract", F.raise_error(F.lit("gone"))), spark, TopicRequest(topic="insulin"), "t", path, day)
    log = engine.read_log(spark, path)
    assert failed["status"] == broken["status"] == "failed" == engine.topic_status(log, "t") and engine.valid_generation(log, "t") == valid
    assert engine.articles_page(spark, path, "t", 100)[0].count() == 20 and len(list((tmp_path / "store" / "articles" / "topic_id=t").iterdir())) == 2
    asked = spark.createDataFrame([(1, "Does insulin work in mice?")], "query_id long, text string")
    assert "Insulin works in mice." in engine.answer(spark, path, asked, "t").first()["answer"]
    smaller = engine.ingest(source, spark, TopicRequest(topic="insulin", max_results=5), "t", path, day)
    assert smaller["article_count"] == 5 and engine.articles_page(spark, path, "t", 100)[0].count() == 5 and reading.count() == 20
    # The same generation written again replaces itself.
    for n in (7, 3):
        engine.ingest(source, spark, TopicRequest(topic="insulin", max_results=n), "u", path, day, generation="g1")
    assert engine.articles_page(spark, path, "u", 100)[0].count() == 3
    engine.cleanup_topic(spark, path, "t")
    assert engine.valid_generation(engine.read_log(spark, path), "t") is None
    before = engine.read_log(spark, path).orderBy("event_id").collect()
    generations.compact(spark, path, date(2100, 1, 1))
    days = list((tmp_path / "store" / "log").glob("day=*"))
    assert engine.read_log(spark, path).orderBy("event_id").collect() == before and all(len(list(d.glob("part-*"))) == 1 for d in days)


def test_numbers_of_an_ingest_are_observed(spark, tmp_path):
    """No job counts what was written; the store's numbers come with the writing."""
    source, _ = dated_articles(spark)
    done = engine.ingest(source, spark, TopicRequest(topic="insulin", max_results=9), "t", str(tmp_path / "s"), date(2024, 1, 1))
    assert done["article_count"] == 9 and done["chunk_count"] == spark.read.json(f"{tmp_path}/s/chunks").count()


def test_cleanup_is_one_job_for_all_topics(spark, tmp_path):
    path = str(tmp_path / "store")
    old = datetime(2020, 1, 1)
    log = spark.createDataFrame([(f"t{i}", "completed", old, i, None, f"g{i}") for i in range(30)] + [("new", "completed", datetime(2100, 1, 1), 99, None, "g")], generations.LOG)
    generations.append(log, path)
    vectors = spark.createDataFrame([(f"t{i}", [1.0]) for i in range(0, 30, 3)] + [("new", [1.0])], "topic_id string, embedding array<double>")
    generations.write(vectors, f"{path}/index", "g")
    assert engine.cleanup_old(spark, path, datetime(2024, 1, 1), 7) == {"total": 30, "cleaned": 10, "failed": 20}
    found = engine.read_log(spark, path)
    assert found.where("status = 'cleaned'").count() == 30 and engine.topic_status(found, "new") == "completed" and engine.storage_status(spark, path)["topics"] == 1
    told = {f for f in (tmp_path / "store" / "log").glob("day=*/part-*") if f.parent.name not in ("day=2020-01-01", "day=2100-01-01")}
    assert 1 <= len(told) <= 4  # not a file for each topic
    assert engine.cleanup_old(spark, path, datetime(2024, 1, 1), 7)["total"] == 0


def test_settings_have_an_effect(spark, tmp_path, monkeypatch):
    from scholia.session import Settings

    source, _ = dated_articles(spark)
    path = str(tmp_path / "store")
    few = Settings(embedding_dims=32, max_answer_sentences=1)
    engine.ingest(source, spark, TopicRequest(topic="insulin", max_results=9), "t", path, date(2024, 1, 1), settings=few)
    assert spark.read.parquet(f"{path}/index").select(F.max(F.size("embedding"))).first()[0] == 32
    asked = spark.createDataFrame([(1, "Does insulin work in mice?")], "query_id long, text string")
    answer = engine.answer(spark, path, asked, "t", settings=few).first()["answer"]
    assert len(re.findall(r"[.!?](?:\s|$)", answer.split("\n\n")[0])) == 1
    monkeypatch.setenv("SCHOLIA_MAX_CONVERSATIONS", "1")
    engine.answer(spark, path, spark.createDataFrame([(2, "And rats?"), (3, "And men?")], "query_id long, text string"), "t", settings=few)
    assert engine.memory(spark, path).select("conversation_id").distinct().count() == 1
    monkeypatch.setenv("SCHOLIA_RETENTION_DAYS", "100000")
    assert engine.cleanup_old(spark, path, datetime(2100, 1, 1))["total"] == 0


def test_settings(monkeypatch):
    from scholia.session import Settings

    assert Settings.from_env({}) == Settings() and Settings.from_env({"SCHOLIA_RETENTION_DAYS": "3"}).retention_days == 3
    for env in ({"SCHOLIA_RETENTION_DAYS": "0"}, {"SCHOLIA_MAX_CONVERSATIONS": "many"}):
        with pytest.raises(ValueError):
            Settings.from_env(env)


def test_newest_conversations_keep_first_seen_order(spark):
    frame = spark.createDataFrame(pd.DataFrame({"conv_id": [1, 2, 3, 1], "at": [1, 2, 3, 9]}))
    assert [r["conv_id"] for r in answers.newest_conversations(frame, "at", keep=2).collect()] == [3, 2]

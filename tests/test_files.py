"""The data sources of article files and search responses."""

import json
import os

import pytest

from scholia.sources import files


def record(i: int, day: str = "2020") -> str:
    return f"<PubmedArticle><PMID>{i}</PMID><ArticleTitle>Title {i} &gt; 0</ArticleTitle><Language>{'eng' if i % 2 else 'fre'}</Language><PubDate><Year>{day}</Year></PubDate></PubmedArticle>"


@pytest.fixture
def folder(spark, tmp_path):
    files.register(spark)
    place = tmp_path / "in"
    place.mkdir()
    for n in range(3):
        text = "<PubmedArticleSet>" + "".join(record(10 * n + i, str(2015 + i)) for i in range(10)) + "<PubmedArticle><PMID>x</bad></PubmedArticle>" + record(100 + n) + "</PubmedArticleSet>"
        (place / f"{n}.xml").write_text(text)
        os.utime(place / f"{n}.xml", (1000 + n, 1000 + n))
    (place / "_ignored").write_text("x")
    return place


def test_articles_of_files(spark, folder):
    rows = spark.read.format("scholia_articles").load(str(folder))
    assert rows.count() == 33 and rows.rdd.getNumPartitions() == 3
    assert {(r["article_index"], r["pmid"], r["title"]) for r in rows.where("pmid in ('7', '101')").collect()} == {(8, "7", "Title 7 > 0"), (12, "101", "Title 101 > 0")}
    found = rows.where("publication_date >= '2022' and lang = 'en' and title like '%7%'")
    assert sorted(r["pmid"] for r in found.collect()) == ["17", "27", "7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # What the source takes is not evaluated again; the rest is.
    filters = [line for line in plan.splitlines() if "Filter" in line and "Scan" not in line]
    assert filters and all("publication_date" not in line and "lang" not in line for line in filters) and any("title" in line for line in filters)
    assert spark.read.format("scholia_articles").load(str(folder / "0.xml")).count() == 11
    empty = folder / "none"
    empty.mkdir()
    assert spark.read.format("scholia_articles").load(str(empty)).count() == 0


def test_a_restarted_stream_reads_each_file_once(spark, folder, tmp_path):
    def run():
        rows = spark.readStream.format("scholia_articles").load(str(folder)).select("file", "pmid")
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 33
    assert run() == 33
    (folder / "3.xml").write_text(record(500) + record(501))
    assert run() == 35


def test_hits_of_responses(spark, tmp_path):
    files.register(spark)
    for n in range(2):
        (tmp_path / f"{n}.json").write_text(json.dumps({"esearchresult": {"count": str(5 + n), "idlist": [f"{n}{i}" for i in range(3)]}}))
    rows = spark.read.format("scholia_hits").load(str(tmp_path))
    assert sorted((r["total"], r["pmid"]) for r in rows.collect()) == [(5, "00"), (5, "01"), (5, "02"), (6, "10"), (6, "11"), (6, "12")]
    assert rows.where("total > 5 and pmid = '12'").count() == 1

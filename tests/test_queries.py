"""Every registered query against its SQL in DuckDB; queries without SQL give rows."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from scholia.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d", n) and n != "pipeline")


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{small}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def same_rows(found, want, columns):
    key = lambda row: tuple(map(repr, row))
    return sorted(([plain(r[c]) for c in columns] for r in found), key=key) == sorted(([plain(r[c]) for c in columns] for r in want), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    frame = entry.queries()[name](spark, small)
    rows = [r.asDict() for r in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    want = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    assert sorted(columns) == sorted(frame.columns)
    assert same_rows(rows, want, columns)


def test_boolean_normalisation_of_every_item(spark, tmp_path):
    texts = ["été and hiver", "où or là", "não not já", "  caféand  thé AND\teau  ", "éor orée andá", "plain and simple", "Ärzte oder Pfleger NOT Löwe", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def normal(text):
        out = re.sub(r"\s+", " ", text.strip())
        for word in ("AND", "OR", "NOT"):
            out = re.sub(rf"\s*\b{word}\b\s*", f" {word} ", out, flags=re.IGNORECASE)
        return out

    got = {r["item_id"]: r["query"] for r in entry.queries()["parse_boolean_normalize"](spark, str(tmp_path)).collect()}
    assert got == {i: normal(t) for i, t in enumerate(texts)}
    assert got[0] == "été AND hiver" and got[3] == "caféand thé AND eau" and got[4] == "éor orée andá"


def test_compressed_passages_are_those_retrieved(spark, small):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    held = {r["chunk_id"]: r["content"] for r in catalogue._chunks(spark, small).collect()}
    words = lambda text: {w for w in re.split(r"[\W_]+", text.lower()) if w}
    want = {}
    for r in entry.queries()["rag_retrieve"](spark, small).collect():
        asked = {w for w in words(items[r["query_id"]]) if len(w) >= 4}
        kept = " ".join(s for s in re.split(r"(?<=[.!?])\s+|\n+", held[r["chunk_id"]]) if words(s) & asked)
        if kept:
            want[r["query_id"], r["chunk_id"]] = (r["position"], kept)
    rows = entry.queries()["compressed_passages"](spark, small).collect()
    assert {(r["query_id"], r["chunk_id"]): (r["position"], r["content"]) for r in rows} == want and len(rows) == len(want)
    assert {q for q, _ in want} == set(items) and any("abstract_split" in c for _, c in want)


def test_entry_gives_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "chunk_id", "position"] and frame.count() > 0

"""The corpus pipeline against a brute-force version of every stage."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from scholia.llm import decontamination, language, lines, simhash
from scholia.llm.registry import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Rows of every stage as the driver runs it: written, then read as the next one's documents."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(folder / name))
        docs = out[name] = spark.read.parquet(str(folder / name))
    return out


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").orderBy("doc_id").collect()]


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "decontamination", "encoding"]
    for name in names[:-1]:
        assert stages[name].schema == stages["documents"].schema
    for r in stages["lines"].collect():
        assert r["n_chars"] == len(r["text"])


def test_language_stage(stages):
    model = language.fit(stages["documents"])
    before = texts(stages["documents"])
    _, _, rejected = model.predict([t for _, t in before])
    assert texts(stages["language"]) == [d for d, gone in zip(before, rejected, strict=True) if not gone]


def test_lines_stage(stages):
    want = lines.brute_force(texts(stages["language"]))
    assert dict(texts(stages["lines"])) == want


def test_near_duplicates_stage(stages):
    before = texts(stages["lines"])
    keep = {c for _, _, c in simhash.brute_force(before)}
    assert texts(stages["near_duplicates"]) == [d for d in before if d[0] in keep]


def test_decontamination_stage(spark, small, stages):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before = texts(stages["near_duplicates"])
    bad = {r[0] for r in decontamination.brute_force(before, bench) if r[5]}
    assert texts(stages["decontamination"]) == [d for d in before if d[0] not in bad]
    assert 0 < len(bad) < len(before)


def test_encoding_stage(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["encoding"].collect()}
    for doc, text in texts(stages["decontamination"]):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got.pop(doc) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert not got


def test_run_equals_the_stages(spark, small, stages):
    found = entry.queries()["pipeline"](spark, small)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, stages["encoding"].collect()))


def written(folder, docs, bench):
    docs.write.parquet(str(folder / "documents.parquet"))
    bench.write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_awkward_tables_go_through(spark, small, tmp_path):
    """Nulls in every column, empty texts, repeated rows, a very long text, extra columns with dots and the operators' own names."""
    base = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    kinds = dict(base.dtypes)
    line = "a sentence of some seven words or so "
    odd = [(None, None, None, None, None), (None, line * 3, "en", None, 1), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, " \n ", None, "s", 3), (10**6 + 3, (line + "\n") * 4000, "en", "s", 9)]
    odd = spark.createDataFrame(odd, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", "text", "lang", "source", "n_chars")))
    docs = base.unionByName(odd).unionByName(base.limit(7)).withColumns({"meta.src": F.lit("x"), "row": F.lit(1), "id": F.lit("clash"), "fp": F.lit(2.5), "tk": F.lit(None).cast("int")})
    folder = written(tmp_path, docs, spark.read.parquet(f"{small}/benchmark.parquet"))
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame
        stage(spark, frame, folder).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert frame.dtypes == docs.dtypes and frame.count() <= before.count()
        if name == "language":
            assert frame.where("text is null or trim(text) = ''").count() == 0
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in frame.where("doc_id is not null").collect()]
            assert len(ids) == len(set(ids))
    assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "joins"] and frame.count() > 20
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(map(tuple, frame.collect()), key=repr)


def test_empty_tables_go_through(spark, small, tmp_path):
    docs, bench = (spark.read.parquet(f"{small}/{n}.parquet").limit(0) for n in ("documents", "benchmark"))
    assert corpus_pipeline.run(spark, written(tmp_path, docs, bench)).count() == 0


def test_language_stage_rejects(spark, small, tmp_path):
    base = spark.read.parquet(f"{small}/documents.parquet")
    noise = spark.createDataFrame([(10**7 + i, "bcdfg hjklm npqrst vwxz " * 200, None) for i in range(3)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.STAGES[0][1](spark, base.select("doc_id", "text", "lang").unionByName(noise), small)
    assert kept.where("doc_id >= 10000000").count() == 0 and kept.count() >= 0.98 * base.where("text rlike '[a-z]'").count()

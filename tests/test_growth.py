"""What must not grow with the table: parts of texts, what tasks keep, and where texts stay."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.functions import batches
from scholia.functions.batches import parts
from scholia.llm import bpe
from scholia.llm.registry import tokenizer_path
from scholia.operators import answers, articles, gram_index, latent, retrieval, vector_index
from scholia.plans import catalogue


def test_compression_is_no_condition_of_a_join(spark):
    passages = spark.createDataFrame([(i, f"Sleep {i}. Other words.") for i in range(9)], "query_id long, content string")
    asked = spark.createDataFrame([(i, "about sleep") for i in range(5)], "query_id long, question string")
    found = answers.compress(passages.join(asked, "query_id"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["content"] for r in found.collect()) == [f"Sleep {i}." for i in range(5)]


def test_words_that_cancel_out_have_a_vector(spark):
    # w13 and w27 have one place and opposite signs.
    frame = spark.createDataFrame([(1, "w13 w27"), (2, " "), (3, " \n"), (4, None), (5, "w13")], "i int, t string")
    norms = {r["i"]: round(float(np.linalg.norm(r["embedding"])), 4) for r in retrieval.embed(frame, "t").collect()}
    assert norms == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0}


def test_parts_are_bounded_and_whole():
    texts = pa.array(["a" * 10, None, "b" * 500, "", "é" * 4] * 40)
    few = list(parts(texts, 100, 7))
    assert pa.concat_arrays(few).equals(texts)
    assert all(len(f) == 1 or (len(f) <= 7 and sum(len((t or "").encode()) for t in f.to_pylist()) <= 100) for f in few)
    assert list(parts(texts.slice(3, 0))) == []


def test_a_task_keeps_the_nearest_alone(spark, monkeypatch):
    """Rows for the exchange do not grow with the vectors; copies and hand-overs between lose nothing."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(600, 4))
    frame = spark.createDataFrame([(f"v{i:04}", rows[i % 600].tolist()) for i in range(3000)], "vec_id string, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(q, rows[q].tolist()) for q in range(3)], "query_id long, query_embedding array<double>")
    want = {q: sorted((round(float(np.linalg.norm(np.float32(rows[i % 600]) - rows[q])), 5), f"v{i:04}") for i in range(3000))[:7] for q in range(3)}
    handed = []
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 100)
    for kept in (1 << 26, 0):
        monkeypatch.setattr(retrieval, "KEPT_BYTES", kept)
        found = retrieval.nearest(frame, asked, 7, with_vectors=True)
        got = found.collect()
        assert {q: sorted(r["vec_id"] for r in got if r["query_id"] == q) for q in range(3)} == {q: sorted(i for _, i in want[q]) for q in range(3)}
        assert all(np.allclose(r["embedding"], rows[int(r["vec_id"][1:]) % 600], atol=1e-6) for r in got)
        handed.append(len(got))
    assert handed == [21, 21]
    best = retrieval._Best(np.array([[1.0, 0.0]]).tobytes(), ["q"], [5], [None], "l2", False, False)
    for low in range(0, 5000, 500):
        best.see(pa.array(range(low, low + 500)), [None] * 500, rng.normal(size=(500, 2)))
    assert sum(b.num_rows for b in best.found({"q": pa.string(), "id": pa.int64()})) == 5


def test_articles_stay_where_they_are_when_candidates_meet_them(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, f"title {i}", "the end of the day" if i % 3 else "none") for i in range(300)], "doc_id long, title string, abstract string")
    gram_index.build(frame, str(tmp_path), ("title", "abstract"), block=64)
    for most in (gram_index.SENT_PLACES, 0):
        monkeypatch.setattr(gram_index, "SENT_PLACES", most)
        found = gram_index.search(spark, str(tmp_path), '"of the"', columns=("title", "abstract"), block=64)
        assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == [i for i in range(300) if i % 3]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("LeftSemi" in plan) == (most == 0) and ("strategy=broadcast" in plan) == (most > 0)


def test_a_batch_of_texts_is_multiplied_a_few_values_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 90, size=rng.integers(0, 40))) for _ in range(50)]
    monkeypatch.setattr(latent, "VALUES", 16)
    batch = latent.Batch.of(texts, np.ones(64))
    whole = np.zeros((50, 64))
    whole[batch.rows, batch.features] = batch.values
    thin, back = rng.normal(size=(64, 3)), np.zeros((64, 3))
    assert np.allclose(batch.times(thin), whole @ thin)
    batch.back(batch.times(thin), back)
    assert np.allclose(back, whole.T @ whole @ thin)


def test_stages_give_back_unused_memory(spark, small, monkeypatch):
    """A worker that goes from stage to stage keeps nothing of a batch that is done."""
    given = []
    monkeypatch.setattr(batches, "release", lambda: given.append(1))
    frame = pa.RecordBatch.from_arrays([pa.array(range(6))], ["n"])
    found = list(batches.thrifty(lambda some: (b.slice(1) for b in some))(iter([frame.slice(0, 3), frame.slice(3)])))
    assert [b.column(0).to_pylist() for b in found] == [[1, 2], [4, 5]] and len(given) == 3
    monkeypatch.undo()
    frames, used = type(spark.range(0)), []
    plain = frames.mapInArrow
    monkeypatch.setattr(frames, "mapInArrow", lambda self, run, *a: used.append(run) or plain(self, run, *a))
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small)
    assert len(used) >= 9 and all(run.__qualname__.startswith("thrifty") for run in used)


def test_encoders_hold_few_texts_and_ids_at_a_time(spark, monkeypatch):
    """However many rows a batch has, results leave a task every two million characters, and ids only if they are asked for."""
    frames, used = type(spark.range(0)), []
    plain = frames.mapInArrow
    monkeypatch.setattr(frames, "mapInArrow", lambda self, run, *a: used.append(run) or plain(self, run, *a))
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert bpe.encode(docs, tokenizer_path()).first()["ids"] and bpe.encode(docs, tokenizer_path(), ids=False).first()["ids"] is None
    assert corpus_pipeline.encode(spark, docs, "").collect() == bpe.digest(bpe.encode(docs, tokenizer_path())).collect()
    _, each, whole = used[:3]
    text = "some words of a text " * 380
    rows = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([text] * 600)], ["id", "text"])
    found = list(whole(iter([rows])))
    assert max(len(text) * b.num_rows for b in found) <= 2 << 20 and sum(b.num_rows for b in found) == 600
    cut = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([b"n"] * 600), pa.array([0] * 600, pa.int32()), pa.array([text] * 600), *[pa.array([False] * 600)] * 2], ["id", "name", "k", "part", "before", "after"])
    coded = list(each(iter([cut])))
    assert max(len(text) * b.num_rows for b in coded) <= 2 << 20 and [x for b in coded for x in b["body"].to_pylist()] == [x for b in found for x in b["ids"].to_pylist()]


def test_texts_are_compared_where_their_vectors_are_made(spark, small, monkeypatch):
    """No vector leaves a task but the nearest: none is packed for a join, and results are those of stored vectors."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 40, size=rng.integers(0, 12))) for _ in range(300)] + ["", None, "w1 w2", "w1 w2"]
    frame = spark.createDataFrame([(f"c{i:03}", t) for i, t in enumerate(texts)], "chunk_id string, content string").repartition(3)
    asked = spark.createDataFrame([(1, "w1 w2 w3", 5), (2, "", 400), (3, "w9", 20)], "query_id long, text string, k int")
    model = retrieval.hash_embedder(32)
    asked = retrieval.embed(asked, "text", model).withColumnRenamed("embedding", "query_embedding")
    rows, own = model([t or "" for t in texts]).astype(float), {1: "w1 w2 w3", 2: "", 3: "w9"}
    for sent in (retrieval.BROADCAST_BYTES, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", sent)
        found = retrieval.nearest(frame, asked, "k", id_col="chunk_id", with_vectors=True, embedder=model)
        got = found.collect()
        for q, k in ((1, 5), (2, 400), (3, 20)):
            away = np.linalg.norm(rows - model([own[q]])[0].astype(float), axis=1).round(9)
            want = sorted((d, f"c{i:03}") for i, d in enumerate(away.tolist()))[:k]
            assert sorted((r["distance"], r["chunk_id"]) for r in got if r["query_id"] == q) == want
        assert all(np.array_equal(np.array(r["embedding"]), rows[int(r["chunk_id"][1:])]) for r in got)
    monkeypatch.undo()
    plan = catalogue.queries()["rag_retrieve"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "vectors" not in plan


def test_a_vector_that_is_no_number_hides_no_other(spark):
    rows = [(0, [float("nan"), 0.0]), (1, [float("inf"), 0.0]), (2, [1.0, 0.0]), (3, [3.0, 0.0]), (4, [1e200, 0.0]), (5, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, query_embedding array<double>")
    for k in (2, 3):
        assert [r["vec_id"] for r in retrieval.nearest(frame, asked, k).orderBy("rank").collect()] == [2, 5, 3][:k]


def test_length_of_what_is_stripped(spark):
    spaces = " \t\n\r\u0085\u00a0\u2028\u3000"
    titles = ["a" * 9, "a" * 10, f"{spaces}{'a' * 9}{spaces}", f"{spaces}{'a' * 10}{spaces}\n", "a" + " " * 8 + "b", "a" + " " * 7 + "b", "😀" * 9, "😀" * 10, "", " " * 60, None, f"{'é' * 4}\n{'é' * 5}"]
    frame = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    valid = lambda title, abstract: {r["i"] for r in frame.where(articles.is_valid(F.lit("1"), title, abstract)).collect()}
    assert valid(F.col("t"), F.lit("x" * 50)) == {i for i, t in enumerate(titles) if t and len(t.strip()) >= 10}
    body = F.concat(F.lit(" "), F.col("t"), F.lit("x" * 40), F.lit(" \n"))
    assert valid(F.lit("t" * 10), body) == {i for i, t in enumerate(titles) if t is not None and len(f"{t}{'x' * 40}".strip()) >= 50}


def test_the_sample_of_an_index_is_taken_before_it_is_sorted(spark, monkeypatch):
    """A task hands on its share of the sample, not as many vectors as the whole sample has."""
    frame = spark.createDataFrame([(f"v{i:05}", [float(i), 1.0]) for i in range(20_000)] + [("same", [5.0, 5.0])] * 50, "id string, v array<double>").repartition(20)
    sorted_rows = []
    frames = type(spark.range(0))
    plain = frames.orderBy
    monkeypatch.setattr(frames, "orderBy", lambda self, *a, **b: sorted_rows.append(self.count()) or plain(self, *a, **b))
    got = vector_index.smallest(frame, 500, 20_050)
    assert len(sorted_rows) == 1 and 500 <= sorted_rows[0] < 800
    want = plain(frame, F.xxhash64("id", "v"), "id").limit(500).collect()
    assert got.to_pylist() == [r["v"] for r in want]
    copies = spark.createDataFrame([("same", [5.0, 5.0])] * 90 + [("other", [1.0, 1.0])], "id string, v array<double>")
    assert len(vector_index.smallest(copies, 40, 91)) == 40 and len(vector_index.smallest(copies, 400, 91)) == 91


def test_a_search_hands_on_the_nearest_of_a_task(spark, tmp_path, monkeypatch):
    """Neither estimates nor vectors of all candidates are shuffled, and cells are written without being stored before."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(6000, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    held = []
    plain = vector_index.stored
    monkeypatch.setattr(vector_index, "stored", lambda df: held.append(df.columns) or plain(df))
    monkeypatch.setattr(vector_index, "FILE_ROWS", 20)
    path = str(tmp_path / "i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    vector_index.build(frame, path, sample=500)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    cells = spark.read.parquet(f"{path}/cells")
    assert not held and cells.count() == 6000 and dict(cells.dtypes)["v"] == "array<float>"
    assert cells.select("cell", F.input_file_name()).distinct().groupBy("cell").count().agg(F.min("count")).first()[0] > 1
    asked = spark.createDataFrame([(q, rows[q].tolist()) for q in range(9)], "query_id long, query_embedding array<double>")
    found = vector_index.search(spark, path, asked, 7, depth=4, with_vectors=True)
    assert held == [["q", "v", "k", "scope", "number"]] and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    near = [set(np.linalg.norm(rows - rows[q], axis=1).argsort()[:7].tolist()) for q in range(9)]
    got = found.collect()
    assert len(got) == 63 and sum(r["vec_id"] in near[r["query_id"]] for r in got) >= 0.8 * 63
    # However the cells are dealt to tasks, the same vectors are found.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    again = vector_index.search(spark, path, asked, 7, depth=4, with_vectors=True).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(again) == sorted(got)
    whole = vector_index.search(spark, path, asked, 7, depth=0).collect()
    assert len(whole) == 63 and sum(r["vec_id"] in near[r["query_id"]] for r in whole) >= sum(r["vec_id"] in near[r["query_id"]] for r in got)
    guesses = vector_index._Guesses(np.array([3, 5]))
    first = rng.normal(size=(2, 10))
    guesses.see(np.array([0, 1]), first)
    guesses.see(np.array([1]), first[1:] + 100)
    assert [sorted(h) for h in guesses.held] == [sorted(first[0])[:3], sorted(first[1])[:5]]

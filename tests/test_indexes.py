"""Indexes of grams and of vectors against searches without them; ranking, pages, answers and learned vectors against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import answers, articles, gram_index, latent, ranking, retrieval, vector_index
from scholia.plans import predicate
from scholia.plans.request import InvalidRequest

WORDS = "insulin glucose café Ärzte mice rats trial the of a in on heart attack STROKE 12 x-ray naïve İstanbul ß".split()


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 5))) + "\n" + " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12))), rnd.choice(["en", "fr", None]), "s") for i in range(400)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "ab", "en", "s")]
    base = articles.articles_of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5))
    path = str(tmp_path_factory.mktemp("grams") / "index")
    gram_index.build(base, path, buckets=8, block=16)
    return base, path


QUERIES = [
    '"heart attack" OR "the of"', "insulin NOT mice", "NOT insulin", "a AND insulin", "café OR ärzte", "naïve AND ß OR i̇stanbul", "insulin AND (mice OR rats) NOT the",
    "(insulin OR heart)[title] AND trial[abstract]", "unheardof OR insulin[author]", "insulin OR english[lang]", 'insulin NOT ("2019"[Date - Publication] : "3000"[Date - Publication])',
]


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_the_scan(spark, indexed, query):
    base, path = indexed
    want = sorted(r["doc_id"] for r in predicate.search(base, query).select("doc_id").collect())
    got = sorted(r["doc_id"] for r in gram_index.search(spark, path, query, buckets=8, block=16).select("doc_id").collect())
    assert got == want


@pytest.mark.parametrize("query", ["NOT mic", "(the OR mic) NOT rat NOT in NOT ins"])
def test_exact_terms_are_subtracted(spark, tmp_path, query):
    """With all indexed columns searched, a NOT of three letters is taken from postings."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(4)), "en", "s") for i in range(200)]
    base = articles.articles_of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3))
    columns = ("title", "abstract")
    gram_index.build(base, str(tmp_path / "i"), columns, 8, 16)
    got = sorted(r["doc_id"] for r in gram_index.search(spark, str(tmp_path / "i"), query, columns=columns, buckets=8, block=16).collect())
    assert got == sorted(r["doc_id"] for r in predicate.search(base, query).collect())
    if query == "NOT mic":
        assert isinstance(gram_index.plan_of(query, columns=columns), gram_index.Without)


def test_only_buckets_and_blocks_of_the_query_are_read(spark, indexed, monkeypatch):
    _, path = indexed
    plan = gram_index.plan_of("insulin NOT mice")
    grams = {g for t in gram_index.terms_in(plan) for g in t.grams}
    counts = gram_index.counts_of(spark, path, grams, 8)
    assert grams == gram_index.grams_of("insulin") and set(counts) == grams
    chosen = sorted(grams, key=lambda g: (counts[g], g))[: gram_index.RAREST]
    buckets = sorted({gram_index.bucket_of(g, 8) for g in chosen})
    rows = gram_index.candidates(spark, path, plan, counts, 8, 16)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*IN \({','.join(map(str, buckets))}\)", text) and len(buckets) < 8
    found = gram_index.search(spark, path, "i̇stanbul AND naïve AND x-ray AND stroke", buckets=8, block=16)
    assert "PushedFilters" in found._jdf.queryExecution().executedPlan().toString() and "block" in found._jdf.queryExecution().executedPlan().toString()
    # Beyond the number of blocks that are named, the join alone.
    want = sorted(r["doc_id"] for r in gram_index.search(spark, path, "insulin", buckets=8, block=16).collect())
    monkeypatch.setattr(gram_index, "NAMED_BLOCKS", 1)
    assert sorted(r["doc_id"] for r in gram_index.search(spark, path, "insulin", buckets=8, block=16).collect()) == want


def test_short_terms_and_other_columns_are_left_open():
    assert isinstance(gram_index.plan_of("a"), gram_index.Open) and isinstance(gram_index.plan_of("ab OR insulin"), gram_index.Open)
    assert isinstance(gram_index.plan_of("ab AND insulin"), gram_index.Term) and isinstance(gram_index.plan_of("NOT insulin"), gram_index.Open)
    assert isinstance(gram_index.plan_of("insulin AND mice[mh]"), gram_index.Term)
    with pytest.raises(InvalidRequest):
        gram_index.plan_of("insulin AND")


# --- vectors --------------------------------------------------------------------------------------------------------


def table(kind: str, n: int = 6000, dims: int = 32) -> np.ndarray:
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(n, dims))
    if kind == "clusters":
        rows = rng.normal(size=(60, dims))[rng.integers(60, size=n)] + 0.3 * rows
    elif kind == "unequal":
        rows *= rng.lognormal(sigma=1.5, size=(n, 1))
    return rows


def searched(spark, tmp_path, rows, asked, **options):
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    path = str(tmp_path / "index")
    vector_index.build(frame.repartition(6), path, sample=4000)
    questions = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "query_id long, query_embedding array<double>")
    found = vector_index.search(spark, path, questions, 20, **options)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got, found, path


def nearest_of(rows, asked, k=20):
    return [np.lexsort((np.arange(len(rows)), np.sqrt(((rows - q) ** 2).sum(1)).round(9)))[:k].tolist() for q in asked]


@pytest.mark.parametrize("kind", ["clusters", "unequal", "alike"])
def test_index_recall(spark, tmp_path, kind):
    rows = table(kind)
    asked = rows[::100] + 0.05 * np.random.default_rng(1).normal(size=(60, rows.shape[1]))
    got, found, path = searched(spark, tmp_path, rows, asked)
    want = nearest_of(rows, asked)
    assert sum(len(set(got[q]) & set(w)) for q, w in enumerate(want)) >= 0.9 * 20 * len(want)


def test_all_cells_are_exact_and_few_cells_are_few_files(spark, tmp_path):
    rows = table("clusters", 3000)
    rows[10:20] = rows[10]
    asked = np.concatenate([rows[10:11], rows[500:503]])
    got, _, path = searched(spark, tmp_path, rows, asked, exact=True)
    assert got == dict(enumerate(nearest_of(rows, asked)))
    one = spark.createDataFrame([(7, rows[500].tolist())], "query_id long, query_embedding array<double>")
    found = vector_index.search(spark, path, one, 5, probe=2)
    assert [r["rank"] for r in found.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[[^\]]*IN \(([\d,]+)\)", plan)
    assert filters and all(len(f.split(",")) == 2 for f in filters) and spark.read.parquet(f"{path}/cells").select("cell").distinct().count() > 10


def test_index_scopes_nulls_and_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"v{i}", "ab"[i % 2], rng.normal(size=4).tolist()) for i in range(300)] + [("n", "a", None), ("e", "a", []), ("o", "a", [1.0]), ("d", "a", rng.normal(size=4).tolist())]
    frame = spark.createDataFrame(rows, "chunk_id string, topic_id string, embedding array<double>")
    vector_index.build(frame, str(tmp_path / "i"), "chunk_id", scope_col="topic_id", sample=100)
    asked = spark.createDataFrame([(1, "a", [0.0] * 4, 3), (2, "b", [0.0] * 4, 200), (3, "c", [0.0] * 4, 5), (4, "a", None, 5), (5, "a", [1.0] * 3, 5), (6, "b", [1.0] * 4, 2)], "query_id long, topic_id string, query_embedding array<double>, k int")
    want = retrieval.nearest(frame, asked, "k", id_col="chunk_id", scope_col="topic_id").count()
    for size in (vector_index.QUERY_BYTES, 40):
        monkeypatch.setattr(vector_index, "QUERY_BYTES", size)
        for exact in (True, False):
            found = vector_index.search(spark, str(tmp_path / "i"), asked, "k", id_col="chunk_id", scope_col="topic_id", exact=exact, probe=99, depth=99).collect()
            assert len(found) == 3 + 150 + 2 and {r["query_id"] for r in found} == {1, 2, 6}
    assert want == 3 + 150 + 2
    vector_index.build(frame.limit(0), str(tmp_path / "none"), "chunk_id")
    assert vector_index.search(spark, str(tmp_path / "none"), asked, 3, id_col="chunk_id").count() == 0


def test_indexed_passages_are_mostly_those_of_the_scan(spark, small):
    import __spark_entry__ as entry

    exact = {(r["query_id"], r["chunk_id"]) for r in entry.queries()["rag_retrieve"](spark, small).collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in entry.queries()["rag_retrieve_indexed"](spark, small).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.85 * len(exact)


# --- ranking and pages ----------------------------------------------------------------------------------------------


def test_pages_of_ranges_part_the_whole(spark, tmp_path):
    rnd = random.Random(2)
    keys = [rnd.randrange(1000) for _ in range(95)]  # with repeats
    frame = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, title string").repartition(4)
    path = str(tmp_path / "r")
    ranking.write_ranges(frame, path, "doc_id", 10)
    assert spark.read.parquet(f"{path}/counts").count() > 5
    for limit, offset in ((20, 0), (7, 33), (10, 90), (5, 95), (5, 200)):
        assert [r["doc_id"] for r in ranking.page(spark, path, "doc_id", limit, offset).collect()] == sorted(keys)[offset : offset + limit]
    plan = ranking.page(spark, path, "doc_id", 3, 50)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range", plan)


def test_bm25_of_requests(spark, indexed, tmp_path):
    """hits() through the index and by BM25, against the formula."""
    import math
    from datetime import date

    from scholia.plans import engine
    from scholia.plans.request import Filters, TopicRequest

    base, _ = indexed
    path, grams = str(tmp_path / "s"), str(tmp_path / "g")
    ranking.statistics(base, path)
    gram_index.build(articles.with_date_bounds(base), grams)
    request = TopicRequest(advanced_query='insulin OR "heart attack"', max_results=15)
    got = [r["pmid"] for r in engine.hits(base, spark, request, date(2024, 1, 1), index=grams, statistics=path).collect()]
    held = {r["pmid"]: re.findall(r"[^\W_]+", f"{r['title'] or ''}\n{r['abstract'] or ''}".lower()) for r in base.select("pmid", "title", "abstract").collect()}
    mean = sum(map(len, held.values())) / len(held)
    df = {w: sum(w in own for own in held.values()) for w in ("insulin", "heart", "attack")}

    def score(own):
        return round(sum(math.log(1 + (len(held) - n + 0.5) / (n + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, n in df.items()), 6)

    found = [p for p, own in held.items() if "insulin" in own or "heart attack" in " ".join(own)]
    assert got == sorted(found, key=lambda p: (-score(held[p]), p))[:15]


def test_extracted_sentences_match_brute_force(spark, tmp_path):
    import math

    rnd = random.Random(7)
    words = "insulin glucose mice rats trial dose heart attack renal".split()
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 7))).capitalize() + "."
    corpus = [" ".join(sentence() for _ in range(4)) for _ in range(40)]
    base = articles.articles_of_documents(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(corpus)], "doc_id long, text string, lang string, source string"))
    path = str(tmp_path / "s")
    ranking.statistics(base, path, ("abstract",))
    questions = [(1, "insulin in mice?"), (2, "heart attack dose"), (3, "no passages"), (4, "unknown words"), (5, None)]
    passages = [(q, p, corpus[(7 * q + 3 * p) % 40] + (" " + corpus[5] if p == 2 else "")) for q in (1, 2, 4, 5) for p in range(1, 6)] + [(2, 6, ""), (2, 7, None), (1, 6, corpus[8])]
    got = {r["query_id"]: r["answer"] for r in answers.extracted(spark.createDataFrame(questions, "query_id long, text string"), spark.createDataFrame(passages, "query_id long, position int, content string"), path).collect()}

    def split(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    df = {w: sum(w in split(t) for t in corpus) for w in words}

    def vector(text):
        own = split(text)
        return {w: own.count(w) * math.log(1 + (40 - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in set(own)}

    def cosine(a, b):
        size = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / max(size(a) * size(b), 1e-30)

    for q, text in questions:
        lines = [s for p in sorted(x for x in passages if x[0] == q) for s in re.split(r"(?<=[.!?])\s+|\n+", p[2] or "") if s.strip()]
        if not lines:
            assert q not in got
            continue
        vectors = [vector(s) for s in lines]
        like = [[0.0 if i == j else cosine(a, b) for j, b in enumerate(vectors)] for i, a in enumerate(vectors)]
        start = [cosine(v, vector(text)) for v in vectors]
        start = [x / sum(start) for x in start] if sum(start) > 0 else [1 / len(lines)] * len(lines)
        rank = start
        for _ in range(50):
            lost = sum(r for r, row in zip(rank, like, strict=True) if sum(row) == 0)
            rank = [0.3 * s + 0.7 * (sum(rank[i] * like[i][j] / sum(like[i]) for i in range(len(lines)) if sum(like[i]) > 0) + lost * s) for j, s in enumerate(start)]
        chosen = []
        for n in sorted(range(len(lines)), key=lambda n: (-round(rank[n], 12), n)):
            if len(chosen) < 3 and all(cosine(vectors[n], vectors[c]) < 0.8 for c in chosen):
                chosen.append(n)
        assert got[q] == " ".join(lines[n] for n in sorted(chosen))


def test_directions_are_those_of_a_decomposition(spark, tmp_path):
    """Equal to numpy's up to sign on a small table; a stored model is the same model."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(words[10 * (i % 5) : 10 * (i % 5) + 20] or words) for _ in range(15)) for i in range(120)] + [None, "", "..."]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    model = latent.fit(frame, dims=6, features=256, passes=12)
    rows = latent.Batch.of(texts, model.idf)
    matrix = np.zeros((len(texts), 256))
    matrix[rows.rows, rows.features] = rows.values
    _, strengths, right = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(model.strengths, strengths[:6], atol=1e-6)
    assert np.allclose(np.abs((model.directions * right[:6].T).sum(axis=0)), 1, atol=1e-4)
    df = {w: sum(w in (t or "").split() for t in texts) for w in words}
    assert abs(model.idf[latent.counts_of(["w3"], 256)[1][0]] - (np.log((1 + len(texts)) / (1 + sum(df[w] for w in words if latent.counts_of([w], 256)[1][0] == latent.counts_of(["w3"], 256)[1][0]))) + 1)) < 0.2
    latent.save(model, spark, str(tmp_path / "m"))
    again = latent.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again(texts), model(texts)) and np.allclose(np.linalg.norm(model(texts), axis=1), [1] * 120 + [0] * 3)
    assert retrieval.embed(frame, "text", again).where(F.size("embedding") == 6).count() == len(texts)
    assert latent.fit(frame.limit(0), dims=4, features=64)(["w1"]).shape == (1, 4)


def test_learned_vectors_find_more_near_copies_than_hashing(spark):
    """Held-out texts of the same themes, in other words of the theme: hashing sees only the words that both have."""
    rnd = random.Random(12)
    themes = [[f"t{n}w{i}" for i in range(40)] for n in range(12)]
    common = [f"c{i}" for i in range(30)]
    text = lambda n, k: " ".join([rnd.choice(themes[n]) for _ in range(k)] + [rnd.choice(common) for _ in range(12)])
    corpus = [(n, text(n, 10)) for n in range(12) for _ in range(40)]
    held_out = [(n, text(n, 3)) for n in range(12) for _ in range(5)]
    model = latent.fit(spark.createDataFrame(corpus, "theme long, text string"), dims=16, features=4096)

    def hits(embedder):
        rows, asked = embedder([t for _, t in corpus]), embedder([t for _, t in held_out])
        near = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :10]
        return sum(corpus[i][0] == n for (n, _), own in zip(held_out, near, strict=True) for i in own)

    assert hits(model) > 1.2 * hits(retrieval.hash_embedder(256))

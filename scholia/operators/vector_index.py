"""A vector index that is searched, not scanned: coarse cells with product-quantised residuals.

build() fits two small models on a bounded sample (SAMPLE vectors of the smallest
hashes): centres of cells by k-means, and for what is left of a vector without its
cell's centre a codebook for each part of the components. Every vector is then
assigned, coded and written, a partition folder for each cell. How many cells a query
looks into and how many candidates it ranks are measured on the sample too: the
fewest that find RECALL of its own nearest vectors.

search() picks for each query the nearest cells, reads of those folders the codes
alone, and adds up distances from tables of the query against the codebooks. How
near the best of them are, `depth` times as many as are wanted, is one number a
query; vectors that are no farther by their codes are then ranked by exact distance
where they are read, and only as many as are wanted leave a task. With a depth of 0
nothing is estimated, and all vectors of the cells are ranked; with `exact` those of
every cell.

Queries go to tasks in blocks of QUERY_BYTES and GUESSES at most, one after the other. Null and
empty vectors and those of another length than the sample's are not indexed; they
are no candidates for a query either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scholia.functions.batches import thrifty
from scholia.operators.kept import SEEN_ROWS, Best, other_scopes
from scholia.session import stored

#: Vectors that the models are fitted on, and rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Most cells; vectors of the sample for each; parts of a residual, and codes of a part.
CELLS, PER_CELL, PARTS, CODES = 1024, 39, 16, 256
#: Share of a sample's nearest vectors that a search must find, how many of them, and for how many queries that is measured.
RECALL, NEAREST, QUERIES = 0.97, 20, 128
#: Bytes of queries that go to every task at a time.
QUERY_BYTES = 16 << 20
#: Estimates that a task holds for a block of queries, and bytes of found vectors from which it hands them on.
GUESSES, KEPT_BYTES = 8 << 20, 64 << 20
#: Vectors of a cell that a task writes, about.
FILE_ROWS = 100_000


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of at most k clusters; empty ones take the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = rows[np.sort(rng.permutation(len(rows))[:k])].copy()
    for _ in range(rounds):
        own, away = nearest_centres(rows, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        for c, far in zip(np.flatnonzero(~full), np.argsort(-away, kind="stable"), strict=False):
            centres[c] = rows[far]
    return centres


def nearest_centres(rows: np.ndarray, centres: np.ndarray, size: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance."""
    own, away = np.empty(len(rows), np.int64), np.empty(len(rows))
    for low in range(0, len(rows), size):
        some = squared(rows[low : low + size], centres)
        own[low : low + size] = some.argmin(axis=1)
        away[low : low + size] = some.min(axis=1)
    return own, away


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * rows @ centres.T)


class Model:
    """Centres of cells, a codebook for each part of residuals, cells to look into and candidates to rank for each one wanted."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray], probe: int = 1, depth: int = 1):
        self.centres, self.books, self.probe, self.depth = centres, books, probe, depth
        self.bounds = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, parts: int, codes: int) -> Model:
        centres = k_means(sample, min(cells, max(1, len(sample) // PER_CELL)))
        own, _ = nearest_centres(sample, centres)
        rest = sample - centres[own]
        bounds = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        model = cls(centres, [k_means(rest[:, a:b], min(codes, len(sample))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        model.measure(sample)
        return model

    def measure(self, sample: np.ndarray) -> None:
        """Set probe and depth to the least that find RECALL of the nearest of some vectors of the sample."""
        asked = sample[:QUERIES]
        own, codes = self.encode(sample)
        near = np.argsort(squared(asked, self.centres), axis=1, kind="stable")
        order = np.argsort(squared(asked, sample), axis=1, kind="stable")[:, 1 : NEAREST + 1]  # the first is the vector itself
        # Which cell of a query's list each vector is in, and which of its candidates it is.
        place = np.argsort(near, axis=1)[:, own]
        guess = np.empty(place.shape)
        for cell in range(len(self.centres)):
            guess[:, own == cell] = self.estimate(asked, cell, codes[own == cell])
        share = lambda hits: hits.mean() if hits.size else 1.0
        steps = [*(1 << n for n in range((len(self.centres) - 1).bit_length())), len(self.centres)]
        rows = np.arange(len(asked))[:, None]
        self.probe = next(p for p in steps if share(place[rows, order] < p) >= RECALL or p == len(self.centres))
        ranks = np.argsort(np.argsort(np.where(place < self.probe, guess, np.inf), axis=1, kind="stable"), axis=1)[rows, order]
        seen = place[rows, order] < self.probe
        self.depth = next(d for d in (2, 4, 8, 16, 32, 64, 128) if share(ranks[seen] < d * NEAREST) >= RECALL or d == 128)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes (a byte a part) of each row."""
        own, _ = nearest_centres(rows, self.centres)
        rest = rows - self.centres[own]
        codes = [nearest_centres(rest[:, a:b], book)[0] for a, b, book in zip(self.bounds[:-1], self.bounds[1:], self.books, strict=True)]
        return own, np.stack(codes, 1).astype(np.uint8)

    def estimate(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded vectors of a cell."""
        rest = queries - self.centres[cell]
        out = np.zeros((len(queries), len(codes)))
        for n, (a, b, book) in enumerate(zip(self.bounds[:-1], self.bounds[1:], self.books, strict=True)):
            out += squared(rest[:, a:b], book)[:, codes[:, n]]
        return out


class _Guesses:
    """The smallest estimates of each query among those that a task has made: `want` of each at most."""

    def __init__(self, want: np.ndarray):
        self.want, self.held, self.bars = want, [np.empty(0)] * len(want), np.full(len(want), np.inf)

    def see(self, queries: np.ndarray, guess: np.ndarray) -> None:
        for q, own in zip(queries.tolist(), guess, strict=True):
            held = np.concatenate([self.held[q], own[own < self.bars[q]]])
            if len(held) >= self.want[q]:
                held = np.partition(held, self.want[q] - 1)[: self.want[q]]
                self.bars[q] = held[-1]
            self.held[q] = held


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def smallest(rows: DataFrame, n: int, count: int) -> pa.Array:
    """The vectors of the n rows (id, v), of `count`, of the smallest hashes.

    Rows of larger hashes are left out before any are sorted, so that tasks hand on
    little more than n together, not n each.
    """
    code = F.xxhash64("id", F.col("v").cast("array<double>"))
    share = 1.25 * n / max(count, 1)
    while True:
        # Hashes are signed; copies of a row have one hash, so that a share may hold too few.
        few = rows.where(code <= int(share * 2**64) - 2**63) if share < 1 else rows
        found = few.orderBy(code, "id").limit(n).select("v").toArrow().column("v").combine_chunks()
        if len(found) >= n or share >= 1:
            return found
        share *= 4


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", scope_col: str | None = None, cells: int = CELLS, parts: int = PARTS, sample: int = SAMPLE) -> None:
    """Write the index of vectors to path: cells/ by cell, and the models."""
    spark = vectors.sparkSession
    scope = F.col(scope_col).cast("string") if scope_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), scope.alias("scope")).where("v is not null and size(v) > 0")
    count = rows.count()
    few = smallest(rows, sample, count)
    sizes = pc.list_value_length(few).to_numpy(zero_copy_only=False)
    dims = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    held = _matrix(few.filter(pa.array(sizes == dims))) if len(sizes) else np.zeros((0, 0))
    model = Model.fit(held, cells, parts, CODES) if len(held) else Model(np.zeros((0, 0)), [])
    _keep(spark, model, path)
    # Of each cell, in how many parts it is written.
    ways = -(-np.bincount(nearest_centres(held, model.centres)[0], minlength=len(model.centres)) * count // (max(1, len(held)) * FILE_ROWS)) if len(held) else np.zeros(0)
    kind = rows.schema["v"].dataType
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL(f"scope string, codes binary, v {kind.simpleString()}, cell int, ways long").fields])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, SEEN_ROWS):
                batch = whole.slice(low, SEEN_ROWS)
                own, codes = model.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(own, pa.int32()), pa.array(np.maximum(1, ways[own]), pa.int64())], schema.fieldNames())

    coded = rows.where(F.size("v") == dims).mapInArrow(thrifty(code), schema) if len(held) else spark.createDataFrame([], schema)
    # A cell is written by one task, and a large one by several; ranges would need a pass of their own.
    dealt = coded.repartition("cell", F.pmod(F.xxhash64("id"), F.col("ways")))
    dealt.drop("ways").write.partitionBy("cell").parquet(f"{path}/cells")


def _cells(spark: SparkSession, path: str) -> DataFrame:
    """The coded vectors; folder names are texts in some sessions."""
    return spark.read.parquet(f"{path}/cells").withColumn("cell", F.col("cell").cast("int"))


def _keep(spark: SparkSession, model: Model, path: str) -> None:
    rows = [("centre", 0, n, c.tolist()) for n, c in enumerate(model.centres)] + [("book", p, n, c.tolist()) for p, book in enumerate(model.books) for n, c in enumerate(book)]
    rows += [("probe", 0, model.probe, []), ("depth", 0, model.depth, [])]
    spark.createDataFrame(rows, "kind string, part int, n int, v array<double>").coalesce(1).write.parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    """The models of an index: CELLS centres and CODES codes of each part at most."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "n").collect()
    centres = [r["v"] for r in rows if r["kind"] == "centre"]
    parts = sorted({r["part"] for r in rows if r["kind"] == "book"})
    books = [np.array([r["v"] for r in rows if r["kind"] == "book" and r["part"] == p], float) for p in parts]
    return Model(np.array(centres, float) if centres else np.zeros((0, 0)), books, *(next(r["n"] for r in rows if r["kind"] == kind) for kind in ("probe", "depth")))


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int | str, query_col: str = "query_id", query_vector_col: str = "query_embedding", id_col: str = "vec_id",
    scope_col: str | None = None, probe: int | None = None, depth: int | None = None, exact: bool = False, with_vectors: bool = False, vector_col: str = "embedding",
) -> DataFrame:
    """query, id, distance (Euclidean), rank of the k nearest vectors found; ties to the smaller id.

    k is a number or a column of queries; probe and depth are those measured when
    the index was built, unless they are given; depth as measured is that of a table
    of the sample's size, and finds fewer in larger ones.
    """
    model = load(spark, path)
    probe, depth = probe or model.probe, 0 if exact else model.depth if depth is None else depth
    scope = F.col(scope_col).cast("string") if scope_col else F.lit(None).cast("string")
    dims = model.centres.shape[1] if len(model.centres) else 0
    asked = queries.select(F.col(query_col).alias("q"), F.col(query_vector_col).cast("array<double>").alias("v"), (F.lit(k) if isinstance(k, int) else F.col(k)).cast("int").alias("k"), scope.alias("scope"))
    asked = stored(asked.where(F.col("v").isNotNull() & (F.size("v") == dims)).withColumn("number", F.monotonically_increasing_id()))
    count, wanted = asked.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0))).first()
    blocks = max(1, -(-count * dims * 8 // QUERY_BYTES), -(-wanted * depth // GUESSES))
    # An index of nothing has no files to tell the type of its ids.
    names = {"q": queries.schema[query_col].dataType, "id": _cells(spark, path).schema["id"].dataType if dims else T.StringType()}
    found = None
    for block in range(blocks if count else 0):
        few = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).orderBy("number").collect()  # QUERY_BYTES or little more
        if few:
            rows = _search_block(spark, path, model, few, names, probe, depth, exact, scope_col is not None)
            found = rows if found is None else found.unionByName(rows)
    schema = T.StructType([T.StructField("q", names["q"]), T.StructField("k", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("id", names["id"]), T.StructField("distance", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    found = spark.createDataFrame([], schema) if found is None else found
    order = Window.partitionBy("number").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k"))
    extra = [F.col("v").cast("array<double>").alias(vector_col)] if with_vectors else []
    return ranked.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "distance", "rank", *extra)


def _search_block(spark: SparkSession, path: str, model: Model, few: list, names: dict, probe: int, depth: int, exact: bool, scoped: bool) -> DataFrame:
    """q, k, number, id, distance, v of the nearest of each task, exactly ranked, for a block of queries."""
    matrix = np.array([r["v"] for r in few], float)
    depths, scopes, numbers = [r["k"] for r in few], [r["scope"] for r in few], [r["number"] for r in few]
    cells = len(model.centres)
    near = np.argsort(squared(matrix, model.centres), axis=1, kind="stable")[:, : cells if exact else probe]
    looks: dict[int, np.ndarray] = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near).tolist()}
    index = _cells(spark, path)
    # As many cells as there are at most.
    held = index if exact else index.where(F.col("cell").isin(sorted(looks)))
    keys, place = {r["number"]: r["q"] for r in few}, {n: q for q, n in enumerate(numbers)}
    kinds = {n: to_arrow_type(t) for n, t in names.items()}
    kind = index.schema["v"].dataType
    types = {"q": pa.int64(), "id": kinds["id"], "v": to_arrow_type(kind)}

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("q")
            columns = [pa.array([keys[n] for n in number.to_pylist()], kinds["q"]), batch.column("k"), number, batch.column("id"), batch.column("distance"), batch.column("v")]
            yield pa.RecordBatch.from_arrays(columns, ["q", "k", "number", "id", "distance", "v"])

    want = np.maximum(1, depth * np.array(depths))

    def estimates(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By cell: queries that look into it, places of its vectors, and their estimates; infinite in other scopes."""
        cell_of, own_scopes = batch.column("cell").to_numpy(), batch.column("scope").to_pylist() if scoped else None
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        for cell in np.unique(cell_of).tolist():
            some = looks.get(cell, np.zeros(0, int))
            if len(some):
                at = np.flatnonzero(cell_of == cell)
                # Rounded, so that equal codes are equally near in whatever batch they are.
                guess = model.estimate(matrix[some], cell, codes[at]).round(9)
                if scoped:
                    guess[other_scopes([scopes[q] for q in some], [own_scopes[n] for n in at])] = np.inf
                yield some, at, guess

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = _Guesses(want)
        for batch in batches:
            for low in range(0, batch.num_rows, SEEN_ROWS):
                for some, _, guess in estimates(batch.slice(low, SEEN_ROWS)):
                    guesses.see(some, guess)
        for number, q in place.items():
            if len(guesses.held[q]):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([guesses.held[q].tobytes()], pa.binary())], ["number", "guesses"])

    def bar(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["number"].iloc[0])
        held, most = np.concatenate([np.frombuffer(g) for g in pdf["guesses"]]), want[place[number]]
        return pd.DataFrame({"number": [number], "bar": [np.partition(held, most - 1)[most - 1] if len(held) > most else np.inf]})

    bars = np.full(len(few), np.inf)
    if depth:
        dealt = held.select("scope", "codes", "cell").mapInArrow(thrifty(guessed), "number long, guesses binary")
        # One number a query.
        for number, most in dealt.groupBy("number").applyInPandas(bar, "number long, bar double").collect():
            bars[place[number]] = most

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(matrix.tobytes(), numbers, depths, scopes, "l2", scoped, True)
        for whole in batches:
            for low in range(0, whole.num_rows, SEEN_ROWS):
                batch, apart = whole.slice(low, SEEN_ROWS), None
                if not exact:
                    apart = np.ones((len(matrix), batch.num_rows), bool)
                    if depth:
                        for some, at, guess in estimates(batch):
                            apart[np.ix_(some, at)] = (guess > bars[some][:, None]) | np.isinf(guess)
                    else:
                        cell_of = batch.column("cell").to_numpy()
                        for cell in np.unique(cell_of).tolist():
                            apart[np.ix_(looks.get(cell, np.zeros(0, int)), np.flatnonzero(cell_of == cell))] = False
                best.see(batch.column("id"), batch.column("scope").to_pylist(), _matrix(batch.column("v")), apart)
                if best.size() > KEPT_BYTES:
                    yield from named(best.found(types))
        yield from named(best.found(types))

    rows = held.select("id", "scope", "v", "cell", *(["codes"] if depth else []))
    return rows.mapInArrow(thrifty(rank), f"q {names['q'].simpleString()}, k int, number long, id {names['id'].simpleString()}, distance double, v {kind.simpleString()}")

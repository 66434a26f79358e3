"""Centroid clustering by scalar lookup tables, exact in whole numbers.

A vector's components become whole numbers, floor(256 * x). A round tabulates, for
each dimension, the squared difference of every whole number that occurs there
with every centroid; a vector's distances are rows gathered from those tables, one
for each dimension, and added up. Tables are made in the task, for the rows of an
Arrow batch, so that they hold what occurs in the batch and never more numbers
than it has rows. Nothing is rounded: sums are exact, ties go to the smaller number.

The vectors that take part are stored once and read once a round. Of a round the
driver sees the sums of the centroids alone, at most `k` times `dims` numbers,
which Spark has added up; each task gives one set of partial sums. Sums are split
into limbs of 32 bits, so that no magnitude overflows.

Defined results: null vectors, those of another length and those with a null or
non-finite component take no part and have no row; repeated rows are vectors each,
with a row each; centroids start as the `k` vectors with the smallest hash, equal
ids in the order of their components, null ids last; fewer vectors than `k` give
as many centroids; an empty table gives no rows. Components of any finite
magnitude are clustered exactly (with Python's whole numbers where 64 bits do not
do); a distance or sum that no long can hold is null. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.session import stored

DIMS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Whole numbers up to here have squared distances in 1,024 dimensions or fewer that fit 64 bits.
SAFE = 1 << 25
#: Bits of a limb of a sum.
LIMB = 32
MOST = (1 << 63) - 1


def integers(matrix: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles, in 64 bits where squares fit, else as Python's numbers; scale is a power of two."""
    with np.errstate(over="ignore"):
        found = np.floor(matrix * float(scale))
    if not found.size or np.abs(found).max() <= SAFE:
        return found.astype(np.int64)
    # From 2^53 on a double is whole itself.
    whole = [int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in matrix.ravel().tolist()]
    return np.array(whole, object).reshape(matrix.shape)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number vectors to centroids, by a table for each dimension."""
    small = centroids.dtype != object and vectors.dtype != object
    out = np.zeros((len(vectors), len(centroids)), np.int64 if small else object)
    for d in range(vectors.shape[1]):
        occurring, place = np.unique(vectors[:, d], return_inverse=True)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        out += table[place]
    return out


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one of equals, and its squared distance."""
    away = distances(vectors, centroids)
    best = np.array(away.argmin(axis=1), np.int64)
    return best, away[np.arange(len(away)), best]


def participants(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """id and v (doubles) of vectors with exactly `dims` components, none null or non-finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(v.isNotNull() & (F.size(v) == dims) & finite)


def _centroid_array(rows: list[list[int]], dims: int) -> np.ndarray:
    """Centroids in 64 bits where squares fit."""
    if all(abs(x) <= SAFE for row in rows for x in row):
        return np.array(rows, np.int64).reshape(len(rows), dims)
    return np.array([x for row in rows for x in row], object).reshape(len(rows), dims)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def start(kept: DataFrame, k: int, seed: int, dims: int, scale: int) -> list[list[int]]:
    """The whole-number vectors of the k smallest sha256 of `seed:id`, in the order of the hash; k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()
    return integers(np.array([r["v"] for r in rows], float).reshape(len(rows), dims), scale).tolist()


def partial_sums(kept: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """c, d, limb, value: limbs of each centroid's sum in each dimension, and as dimension -1 its vectors' number; added up over all tasks."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = integers(_matrix(batch.column(0), dims), scale)
            best, _ = nearest(vectors, centroids)
            own = np.zeros(centroids.shape, vectors.dtype)
            np.add.at(own, best, vectors)
            sums += own.astype(object)
            counts += np.bincount(best, minlength=len(centroids))
        rows = [(c, -1, 0, int(n)) for c, n in enumerate(counts) if n]
        for c in np.flatnonzero(counts).tolist():
            for d, total in enumerate(sums[c].tolist()):
                sign, rest, limb = (-1 if total < 0 else 1), abs(int(total)), 0
                while rest:
                    rows.append((c, d, limb, sign * (rest & ((1 << LIMB) - 1))))
                    rest, limb = rest >> LIMB, limb + 1
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "d", "limb", "value"])

    return kept.select("v").mapInArrow(run, "c int, d int, limb int, value long").groupBy("c", "d", "limb").agg(F.sum("value").alias("value"))


def moved(centroids: list[list[int]], rows: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Centroids after a round: exact floor of the mean where there are vectors, else as they were."""
    counts = {c: n for c, d, _, n in rows if d < 0}
    out = [list(row) for row in centroids]
    for c in counts:
        out[c] = [0] * len(out[c])
    for c, d, limb, value in rows:
        if d >= 0:
            out[c][d] += value << (LIMB * limb)
    for c, n in counts.items():
        out[c] = [x // n for x in out[c]]
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE
) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster, distance (squared) of every vector that takes part, and the final centroids."""
    kept = stored(participants(vectors, id_col, vector_col, dims))
    centroids = start(kept, k, seed, dims, scale)
    for _ in range(rounds if centroids else 0):
        rows = partial_sums(kept, _centroid_array(centroids, dims), scale).collect()  # at most k * dims sums
        centroids = moved(centroids, [tuple(r) for r in rows])
    final = _centroid_array(centroids, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, away = nearest(integers(_matrix(batch.column(1), dims), scale), final)
                away = pa.array([x if x <= MOST else None for x in away.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), away], ["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType), *T.StructType.fromDDL("cluster int, distance long").fields])
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col), centroids


def digest(found: DataFrame, centroids: list[list[int]], id_col: str = "vec_id") -> DataFrame:
    """Rows of cluster() with the inertia of each one's cluster and of all, and the hash of its centroid."""
    found = stored(found)
    exact = F.col("distance").cast("decimal(38,0)")
    # Null distances are beyond a long, and so are their sums.
    total = F.when(F.count("*") == F.count("distance"), F.sum(exact))
    each = found.groupBy("cluster").agg(total.alias("own"))
    whole = each.agg(F.when(F.count("*") == F.count("own"), F.sum("own")).alias("whole")).first()["whole"]
    names = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    known = found.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    inertia = int(whole) if whole is not None and whole <= MOST else None
    # A row for each centroid, `k` at most.
    facts = each.join(known, "cluster").select("cluster", F.expr("try_cast(own as bigint)").alias("cluster_inertia"), "centroid_sha256")
    return found.join(F.broadcast(facts), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")


def brute_force(rows: list[tuple], k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> list[tuple]:
    """The digest's rows for (id, vector), vector by vector with fractions of whole numbers; for tests."""
    from fractions import Fraction
    from math import floor, isfinite

    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    whole = [[floor(Fraction(x) * scale) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, hashlib.sha256(f"{seed}:{kept[n][0]}".encode()).hexdigest(), kept[n][1]))
    centroids = [whole[n] for n in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for v in whole]

    for _ in range(rounds):
        places = assigned()
        for c in range(len(centroids)):
            own = [v for v, (_, n) in zip(whole, places, strict=True) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    places = assigned()
    fits = lambda x: x if x <= MOST else None
    sums = {c: sum(d for d, n in places if n == c) for _, c in places}
    return [
        (i, c, fits(d), fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, places, strict=True)
    ]


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> str:
    """The query in SQL, with the rounds one after the other; by sums over components, without tables."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT n, arg_min(c, (away, c)) AS c, min(away) AS away FROM (
    SELECT v.n, m.c, sum((v.x - m.x) * (v.x - m.x)) AS away FROM v JOIN m{r} AS m ON v.d = m.d GROUP BY v.n, m.c) GROUP BY n)"""
    move = """
m{s} AS MATERIALIZED (
  SELECT m.c, m.d, coalesce(t.x, m.x) AS x FROM m{r} AS m LEFT JOIN (
    SELECT c, d, CAST((s - ((s % k) + k) % k) // k AS BIGINT) AS x FROM (
      SELECT a.c, v.d, CAST(sum(v.x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS k FROM a{r} AS a JOIN v ON a.n = v.n GROUP BY a.c, v.d)) AS t
  ON m.c = t.c AND m.d = t.d)"""
    head = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id IS NULL, sha256('{seed}:' || CAST(vec_id AS VARCHAR)), embedding) AS n, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}),
v AS MATERIALIZED (SELECT n, unnest(range(1, {dims} + 1)) AS d, CAST(floor({scale} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
m0 AS MATERIALIZED (SELECT n - 1 AS c, d, x FROM v WHERE n <= {k}),"""
    steps = ",".join(assign.format(r=r) + "," + move.format(r=r, s=r + 1) for r in range(rounds))
    tail = f"""
SELECT kept.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.away AS BIGINT) AS distance, CAST(sum(a.away) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.away) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} AS a JOIN kept ON a.n = kept.n JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM m{rounds} GROUP BY c) AS h ON h.c = a.c"""
    return head + steps + "," + assign.format(r=rounds) + tail


ORACLE = _oracle()

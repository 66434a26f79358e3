"""Nearest neighbours by inner product with vantage-point trees, one forest for each shard.

Vectors are dealt to shards by a hash of their row, about `shard_rows` to each,
and a task builds a shard's trees, which are written as an index. Inside a shard
vectors lie in bands of similar length; a band is a tree of its own, in which
inner products become distances by one more coordinate that gives all its
vectors the length of the longest; queries are scaled to it. A node keeps a
vantage point and, for each half of its points, the least and largest distance
to it.

A search takes the bands from the longest vectors down and leaves out those
whose length cannot reach the k-th product found. In a tree it goes down the
nearer half first and into a half only if the triangle inequality allows a
nearer point: a half is left out if its lower bound times `factor` is beyond the
k-th distance found. Factor one is exact search; larger factors leave out more.
Without a given factor the largest one of FACTORS is taken that finds RECALL of
the true neighbours on a bounded sample, for each number of components by itself:
SAMPLE rows and SAMPLE_QUERIES of the queries, those of the smallest hashes, so
that it fits the data and what is asked of it.

Bounds need squared lengths that are numbers. Vectors whose largest component is
beyond EXTREME or below its inverse stand beside the trees: every query is
compared with them, and as queries they are compared with every vector.

Queries are packed in blocks; every pair of a block and a shard is a row of its
own, and the k best of a query over all shards remain.

Scores are inner products of the original vectors in double precision, summed in
the same order for every pair; ties go to the smaller id. Products that overflow
are infinite and equal, those that vanish are zero, and sums of both infinities
stand as minus infinity.

Defined results: null vectors, zero vectors and those with null or non-finite
components take no part, nor do rows with a null id; vectors of different
lengths (numbers of components) have no product, so that a query's candidates
are the vectors of its own length; rows that share an id are candidates and
queries of their own, and each such query has its ranks from 1; a query row is
not its own neighbour, another row of its id may be; fewer candidates than k are
all returned; an empty table gives none; columns beyond the id and the vector
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.session import cut

K = 20
#: Pruning factors tried on the sample, and the recall that one needs there.
FACTORS = (16.0, 12.0, 10.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5)
RECALL = 0.97
SAMPLE, SAMPLE_QUERIES = 4096, 128
#: Rows of the smallest hashes that are ranked for one that is taken.
SPARE = 4
SHARD_ROWS, QUERY_ROWS = 8192, 1024
LEAF = 128
#: Least length in a band, as a share of the longest.
BAND = 0.8
#: Points and queries compared at a time where there are no bounds.
SCAN = 256
#: Slack for rounding in bounds and in products that only pick candidates.
EPS = 1e-9

#: Largest magnitude of a vector's largest component, and the inverse of the smallest, for which bounds are computed.
EXTREME = 1e75

Forest = dict[str, np.ndarray]


def build(ids: np.ndarray, marks: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Forest:
    """Vantage-point trees as arrays; nodes hold ranges of the reordered points.

    marks: a number for each row, by which a query knows itself.
    nodes: vantage point, first child, second child (-1: leaf), start, end.
    bounds: least and largest distance of each half to the vantage point.
    bands: root node and longest vector of each tree, longest first. Points of
    extreme magnitude come last and are in no tree.
    """
    apart = is_extreme(rows)
    norms = np.sqrt(np.einsum("ij,ij->i", *(np.where(apart[:, None], 0.0, rows),) * 2))
    order = np.lexsort((marks, ids, -norms, apart))
    order, extreme = order[: len(order) - int(apart.sum())], order[len(order) - int(apart.sum()) :]
    nodes: list[list[int]] = []
    bounds: list[list[float]] = []
    bands: list[list[float]] = []
    begin = 0
    while begin < len(order):
        longest = float(norms[order[begin]])
        # Shorter vectors join while the band would be less than a leaf.
        end = max(int(np.searchsorted(-norms[order], -BAND * longest, side="right")), min(len(order), begin + leaf))
        bands.append([len(nodes), longest])
        _grow(order, begin, end, rows, norms, longest, leaf, nodes, bounds)
        begin = end
    order = np.concatenate([order, extreme])
    table = np.array(nodes, np.int64).reshape(-1, 5)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    inner = table[:, 0] >= 0
    table[inner, 0] = place[table[inner, 0]]
    return {"ids": ids[order], "marks": marks[order], "rows": rows[order], "nodes": table, "bounds": np.array(bounds).reshape(-1, 4), "bands": np.array(bands).reshape(-1, 2)}


def _grow(order: np.ndarray, begin: int, finish: int, rows: np.ndarray, norms: np.ndarray, longest: float, leaf: int, nodes: list, bounds: list) -> None:
    """Add the nodes of one tree over order[begin:finish], which is reordered."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - norms**2))
    stack = [(begin, finish, -1, 0)]
    while stack:
        start, end, parent, side = stack.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][1 + side] = here
        nodes.append([-1, -1, -1, start, end])
        bounds.append([0.0, 0.0, 0.0, 0.0])
        if end - start <= leaf:
            continue
        own = order[start:end]
        # The point farthest from the first one spreads distances most.
        far = own[int(np.argmin(rows[own] @ rows[own[0]] + rest[own] * rest[own[0]]))]
        away = np.sqrt(np.maximum(0.0, 2 * longest**2 - 2 * (rows[own] @ rows[far] + rest[own] * rest[far])))
        ranked = np.argsort(away, kind="stable")
        order[start:end], away = own[ranked], away[ranked]
        half = (end - start) // 2
        nodes[here][0] = int(far)
        bounds[here] = [away[0], away[half - 1], away[half], away[-1]]
        stack += [(start + half, end, here, 1), (start, start + half, here, 0)]


def is_extreme(rows: np.ndarray) -> np.ndarray:
    """Which vectors are too large or small for squared lengths."""
    most = np.abs(rows).max(axis=1)
    return (most > EXTREME) | (most < 1 / EXTREME)


class Search:
    """The k best of a block of queries in one shard: scores, ids, and which of them are real."""

    def __init__(self, trees: Forest, query_marks: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.tree, self.query_marks, self.queries, self.k, self.factor = trees, query_marks, queries, k, factor
        apart = is_extreme(queries)
        self.norms = np.sqrt(np.einsum("ij,ij->i", *(np.where(apart[:, None], 1.0, queries),) * 2))
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.real = np.zeros((len(queries), k), bool)
        self.compared = 0
        size = len(trees["ids"])
        beside = int(trees["nodes"][trees["bands"][:, 0].astype(np.int64), 4].max()) if len(trees["bands"]) else 0
        for low in range(beside, size, SCAN):
            self._compare(low, min(size, low + SCAN), np.flatnonzero(~apart))
        for low in range(0, size, SCAN):
            self._compare(low, min(size, low + SCAN), np.flatnonzero(apart))
        for root, longest in trees["bands"].tolist():
            self.longest, self.scale = longest, longest / self.norms
            able = ~apart & (longest * self.norms * (1 + EPS) >= self.scores[:, -1])
            self._visit(int(root), np.flatnonzero(able))

    def _reach(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        worst = self.scores[active, -1] * self.scale[active]
        return np.sqrt(np.maximum(0.0, 2 * self.longest**2 - 2 * worst))

    def _visit(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        vantage, first, second, start, end = self.tree["nodes"][node].tolist()
        if first < 0:
            self._scan(start, end, active)
            return
        away = np.sqrt(np.maximum(0.0, 2 * self.longest**2 - 2 * self.scale[active] * (self.queries[active] @ self.tree["rows"][vantage])))
        lo1, hi1, lo2, hi2 = self.tree["bounds"][node].tolist()
        low = np.stack([np.maximum(np.maximum(away - hi1, lo1 - away), 0), np.maximum(np.maximum(away - hi2, lo2 - away), 0)])
        near_first = away <= (hi1 + lo2) / 2
        for child, side, group in ((first, 0, near_first), (second, 1, ~near_first), (second, 1, near_first), (first, 0, ~near_first)):
            own = active[group]
            self._visit(child, own[low[side, group] * self.factor <= self._reach(own) + EPS])

    def _scan(self, start: int, end: int, active: np.ndarray) -> None:
        rows = self.tree["rows"][start:end]
        self.compared += len(active) * (end - start)
        rough = self.queries[active] @ rows.T
        slack = EPS * self.longest / self.scale[active] * self.longest
        hits, at = np.nonzero(rough >= (self.scores[active, -1] - slack)[:, None])
        self._add(start, end, active, hits, at)

    def _compare(self, start: int, end: int, active: np.ndarray) -> None:
        """Every query of `active` with every point of a range, without bounds."""
        self.compared += len(active) * (end - start)
        for low in range(0, len(active), SCAN):
            some = active[low : low + SCAN]
            self._add(start, end, some, *np.divmod(np.arange(len(some) * (end - start)), end - start))

    def _add(self, start: int, end: int, active: np.ndarray, hits: np.ndarray, at: np.ndarray) -> None:
        """Take pairs of a query (a place in active) and a point (a place from start on) into what is held."""
        rows, ids = self.tree["rows"][start:end], self.tree["ids"][start:end]
        other = self.query_marks[active[hits]] != self.tree["marks"][start:end][at]
        hits, at = hits[other], at[other]
        if not len(hits):
            return
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            exact = np.einsum("ij,ij->i", self.queries[active[hits]], rows[at])
        exact[np.isnan(exact)] = -np.inf
        touched, group = np.unique(hits, return_inverse=True)
        who = active[touched]
        owner = np.concatenate([np.repeat(np.arange(len(who)), self.k), group])
        score = np.concatenate([self.scores[who].ravel(), exact])
        name = np.concatenate([self.found[who].ravel(), ids[at]])
        real = np.concatenate([self.real[who].ravel(), np.ones(len(at), bool)])
        order = np.lexsort((name, ~real, -score, owner))
        owner, score, name, real = owner[order], score[order], name[order], real[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        keep = rank < self.k
        for held, new in ((self.scores, score), (self.found, name), (self.real, real)):
            held[who] = new[keep].reshape(-1, self.k)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (doubles) of the rows that take part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.forall("vector", number) & F.exists("vector", lambda x: x != 0))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vector"].to_list()).astype(np.float64)


def choose_factors(rows: DataFrame, asked: F.Column, k: int = K, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """dims, factor: for each number of components the largest of FACTORS with that recall on its sample; one if none has it.

    rows: id, vector, mark, dims; asked: a condition for those that are queries.
    """

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash", "mark"], kind="stable")
        held, wanted = pdf[pdf["place"] <= SAMPLE], pdf[pdf["query_place"] <= SAMPLE_QUERIES]
        trees = build(held["id"].to_numpy(np.int64), held["mark"].to_numpy(np.int64), _matrix(held), leaf)
        chosen = 1.0
        if len(wanted):
            marks, queries = wanted["mark"].to_numpy(np.int64), _matrix(wanted)
            # Scores, not ids, so that ties are no misses.
            exact = Search(trees, marks, queries, k, 1.0)
            for factor in FACTORS:
                got = Search(trees, marks, queries, k, factor)
                hits = sum((g[r] >= w[r][-1] - 1e-12 * abs(w[r][-1])).sum() for g, w, r in zip(got.scores, exact.scores, exact.real, strict=True) if r.any())
                if hits >= recall * exact.real.sum():
                    chosen = factor
                    break
        return pd.DataFrame({"dims": [int(pdf["dims"].iloc[0])], "factor": [chosen]})

    # At most SAMPLE rows and SAMPLE_QUERIES queries of each number of components.
    hashed = rows.withColumn("hash", F.xxhash64("id", "vector")).withColumn("asked", F.coalesce(asked, F.lit(False)))
    order = Window.partitionBy("dims").orderBy("hash", "mark")
    sizes = hashed.groupBy("dims").agg(F.count("*").alias("rows"), F.count_if("asked").alias("queries"))  # a row for each number of components
    # Hashes are even, so that those below a few times the wanted share hold the smallest ones; only these are ranked.
    share = F.pmod(F.shiftrightunsigned("hash", 11), F.lit(1 << 53)) / float(1 << 53)
    near = hashed.join(sizes, "dims").select("dims", "mark", "asked", F.shiftrightunsigned("hash", 11).alias("hash"), share.alias("share"), "rows", "queries")
    some = near.where(F.col("share") * F.col("rows") <= SPARE * SAMPLE).withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE).select("mark", "place")
    few = near.where(F.col("asked") & (F.col("share") * F.col("queries") <= SPARE * SAMPLE_QUERIES)).withColumn("query_place", F.row_number().over(order)).where(F.col("query_place") <= SAMPLE_QUERIES).select("mark", "query_place")
    none = F.lit(None).cast("int")
    places = some.select("mark", "place", none.alias("query_place")).unionByName(few.select("mark", none.alias("place"), "query_place"))
    places = places.groupBy("mark").agg(F.min("place").alias("place"), F.min("query_place").alias("query_place"))
    sample = hashed.join(places, "mark").select("dims", "id", "mark", "vector", "hash", F.coalesce("place", F.lit(SAMPLE + 1)).alias("place"), F.coalesce("query_place", F.lit(SAMPLE_QUERIES + 1)).alias("query_place"))
    return sample.groupBy("dims").applyInPandas(measure, "dims int, factor double")


def neighbours(
    vectors: DataFrame, queries: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    factor: float | None = None, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of each query.

    queries: a condition on the column `id` that picks the query rows.
    factor: None for those that choose_factors() measures.
    """
    # Rows are numbered once: the checkpoint keeps the numbers.
    rows = cut(valid_vectors(vectors, id_col, vector_col).withColumn("mark", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")))
    count, asked = rows.agg(F.count("*"), F.count_if(queries)).first()
    shards, blocks = max(1, -(-count // shard_rows)), max(1, -(-asked // query_rows))
    # A row for each number of components.
    factors = rows.select("dims", F.lit(factor).cast("double").alias("factor")).distinct() if factor is not None else cut(choose_factors(rows, queries, k, leaf=leaf))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = build(pdf["id"].to_numpy(np.int64), pdf["mark"].to_numpy(np.int64), _matrix(pdf), leaf)
        return pd.DataFrame({"dims": [int(pdf["dims"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], **{n: [trees[n].tobytes()] for n in _FOREST}})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mark")
        names = {n: [pdf[c].to_numpy(np.int64).tobytes()] for n, c in (("query_ids", "id"), ("query_marks", "mark"))}
        return pd.DataFrame({"dims": [int(pdf["dims"].iloc[0])], **names, "queries": [_matrix(pdf).tobytes()]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int"))
    trees = cut(dealt.groupBy("dims", "shard").applyInPandas(index, "dims int, shard int, " + ", ".join(f"{n} binary" for n in _FOREST)))
    packed = rows.where(queries).withColumn("block", F.pmod(F.xxhash64("mark", F.lit(7)), F.lit(blocks)).cast("int"))
    packed = packed.groupBy("dims", "block").applyInPandas(pack, "dims int, query_ids binary, query_marks binary, queries binary")
    pairs = packed.join(factors, "dims").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, ["dims", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                dims = row["dims"]
                found = {n: np.frombuffer(row[n], kind).reshape(shape(dims)) for n, (kind, shape) in _FOREST.items()}
                names, marks = (np.frombuffer(row[n], np.int64) for n in ("query_ids", "query_marks"))
                done = Search(found, marks, np.frombuffer(row["queries"]).reshape(-1, dims), k, row["factor"])
                owner, mark = (np.repeat(x, k).reshape(-1, k)[done.real] for x in (names, marks))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(mark), pa.array(done.found[done.real]), pa.array(done.scores[done.real])], ["query_id", "mark", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: What a shard's row in the index holds, with types and shapes.
_FOREST = {
    "ids": (np.int64, lambda dims: (-1,)), "marks": (np.int64, lambda dims: (-1,)), "rows": (np.float64, lambda dims: (-1, dims)),
    "nodes": (np.int64, lambda dims: (-1, 5)), "bounds": (np.float64, lambda dims: (-1, 4)), "bands": (np.float64, lambda dims: (-1, 2)),
}


def brute_force(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, k: int = K) -> dict[int, list[list[tuple[int, float]]]]:
    """The exact k nearest of every query row, a list for each row of an id; for tests and recall."""
    out: dict[int, list] = {}
    wanted = set(query_ids.tolist())
    for place, q in enumerate(ids.tolist()):
        if q in wanted:
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.nan_to_num(np.einsum("ij,j->i", rows, rows[place]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            order = [n for n in np.lexsort((ids, -scores)) if n != place][:k]
            out.setdefault(q, []).append([(int(ids[n]), float(scores[n])) for n in order])
    return out

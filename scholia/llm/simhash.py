"""SimHash near-duplicates with deletion-variant signatures.

A text's words are its runs of non-white-space bytes after lower-casing A-Z, its
features the 4-word shingles with repeats, its fingerprint the 64 majority bits
of their XXH64 (seed 42). Fingerprints that differ in at most four bits link.

Candidates: 64 bits are cut into three segments, fewer than four bits would need
for an exact match, so that two linked fingerprints differ in at most one bit of
some segment. Every fingerprint is indexed under 64 one-wildcard variants, a
segment with one bit left out; equal variants meet in an equality join which
verifies the distance and keeps a pair at one of the variants it shares only.
Only distinct fingerprints take part, so copies add no rows to the join.

A variant has 20 or 21 bits, which is few for very many fingerprints. From PLAIN
of them on, a variant also holds one of five parts of the other bits: a pair of
distance four has one in which it is equal. That is five times the rows and some
four hundred times fewer pairs to verify, for the same links.

Links become components by contracting edges in Spark, each round cut by a
checkpoint. A node with many neighbours is a hot key of these joins: what is
looked up for keys with a large share of the rows is sent to every task.

Defined results: null, empty and blank texts have no shingle and fingerprint
zero, which links like any other; fewer than four words make one shingle of them
all; repeated rows share a fingerprint and a component; the component id is the
smallest doc_id, and null if no member has one; texts of any length are read
whole; an empty table gives no rows; other columns, whatever their names, are
passed through by deduplicate() and not looked at elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.batches import thrifty
from scholia.session import cut

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: First bit of each of the three segments, and the end.
CUTS = (0, 21, 42, 64)
#: Shingles hashed at a time, so that a very long text needs little memory.
CHUNK = 1 << 16
#: Distinct fingerprints from which variants are longer; links are the same.
PLAIN = 1 << 22
#: Lookups of at least so many rows treat keys with over one HOT_KEYS-th of them apart; there are fewer than HOT_KEYS.
HOT_ROWS, HOT_KEYS = 20_000, 500


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 text."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    text = b" ".join(words)
    ends = [end + i for i, end in enumerate(accumulate(map(len, words)))]
    starts = [0, *[end + 1 for end in ends[:-1]]]
    last = ends[size - 1 :] or ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), CHUNK):
        hashes = [xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], last[at : at + CHUNK], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(thrifty(run), schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: Bits of each segment.
MASKS = [(1 << hi) - (1 << lo) for lo, hi in zip(CUTS[:-1], CUTS[1:], strict=True)]


def rest_masks(segment: int, parts: int) -> list[int]:
    """Bits of each of `parts` parts of what lies outside a segment."""
    outside = [b for b in range(64) if not MASKS[segment] >> b & 1]
    bounds = [k * len(outside) // parts for k in range(parts + 1)]
    return [sum(1 << b for b in outside[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def _by_segment(values: list, i: str = "i") -> F.Column:
    """The value of the segment that holds bit i."""
    return F.when(F.col(i) < CUTS[1], values[0]).when(F.col(i) < CUTS[2], values[1]).otherwise(values[2])


def variants(prints: DataFrame, parts: int = 1) -> DataFrame:
    """The one-wildcard variants of each fingerprint: fp, i (the bit left out), j (part of the other bits), key."""
    spread = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    number = lambda values: _by_segment([F.lit(v).cast("long") for v in values])
    spread = spread.select("fp", "i", number([_signed(m) for m in MASKS]).alias("mask"), number(CUTS[:3]).cast("int").alias("low"))
    key = "shiftleft(shiftrightunsigned(fp & mask & ~shiftleft(1L, i), low), 6) | i"
    if parts == 1:
        return spread.select("fp", "i", F.lit(0).alias("j"), F.expr(key).alias("key"))
    masks = _by_segment([F.array(*[F.lit(_signed(m)).cast("long") for m in rest_masks(s, parts)]) for s in range(3)])
    longer = spread.select("fp", "i", F.expr(key).alias("plain"), F.posexplode(masks).alias("j", "part"))
    # A hash: what collides is verified like any other pair.
    return longer.select("fp", "i", "j", F.xxhash64("plain", "j", F.col("fp").bitwiseAND(F.col("part"))).alias("key"))


def links(prints: DataFrame, distance: int = DISTANCE, long_keys: bool = False) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in 1..distance bits, each once.

    Three segments find every pair up to distance five.
    """
    if not 0 <= distance <= 5:
        raise ValueError("three segments with one wildcard cover distances up to 5")
    parts = distance + 1 if long_keys else 1
    left = variants(prints, parts).select(F.col("fp").alias("a"), "i", "j", "key")
    right = variants(prints, parts).select(F.col("fp").alias("b"), F.col("i").alias("i_b"), F.col("j").alias("j_b"), F.col("key").alias("key_b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    counts = [F.bit_count(diff.bitwiseAND(F.lit(_signed(m)))) for m in MASKS]
    # The pair is kept in its first segment of at most one differing bit; where that segment is equal, at its first bit.
    first = F.when(counts[0] <= 1, 0).when(counts[1] <= 1, 1).otherwise(2)
    once = F.when(counts[0] <= 1, (counts[0] == 1) | (F.col("i") == CUTS[0])).when(counts[1] <= 1, (counts[1] == 1) | (F.col("i") == CUTS[1])).otherwise((counts[2] == 1) | (F.col("i") == CUTS[2]))
    on = (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.bit_count(diff) <= distance) & (first == _by_segment([F.lit(0), F.lit(1), F.lit(2)])) & once
    if parts > 1:
        # And in the first part of the other bits in which it is equal.
        def equal_part(segment: int) -> F.Column:
            same = [diff.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0 for m in rest_masks(segment, parts)]
            return F.coalesce(*[F.when(x, F.lit(k)) for k, x in enumerate(same)])

        on = on & (F.col("i") == F.col("i_b")) & (F.col("j") == F.col("j_b")) & (F.col("j") == _by_segment([equal_part(s) for s in range(3)]))
    return left.join(right, on).select("a", "b")


def lookup(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows, already cut, joined with found, which has one row for a key; hot keys are looked up where the rows are."""
    total = rows.count()
    if total < HOT_ROWS:
        return rows.join(found, key, how)
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > total // HOT_KEYS).select(key)
    hot = cut(hot.withColumn("is_hot", F.lit(True)))
    # Fewer than HOT_KEYS keys have more than that share.
    marked = rows.join(F.broadcast(hot), key, "left")
    few = cut(found.join(F.broadcast(hot.select(key)), key, "left_semi"))
    near = marked.where("is_hot").drop("is_hot").join(F.broadcast(few), key, how)
    return near.unionByName(marked.where("is_hot is null").drop("is_hot").join(found, key, how))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of undirected edges (a, b): node, root (the smallest node).

    Every round maps each node to the smallest one of its neighbours and itself,
    and on to that node's choice; edges are then drawn between the images, which
    leaves fewer of them and keeps what was connected connected. Rounds end when
    no edge is left.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("step")))
        image = cut(lookup(near, near.select(F.col("node").alias("step"), F.col("step").alias("image")), "step").select("node", "image"))
        if roots is None:
            roots = image.withColumnRenamed("image", "root")
        else:
            onward = lookup(roots, image.withColumnRenamed("node", "root"), "root", "left")
            roots = cut(onward.select("node", F.coalesce("image", "root").alias("root")))
        drawn = lookup(edges, image.select(F.col("node").alias("a"), F.col("image").alias("x")), "a")
        drawn = lookup(cut(drawn), image.select(F.col("node").alias("b"), F.col("image").alias("y")), "b").where("x <> y")
        edges = cut(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (smallest id reachable)."""
    prints = cut(fingerprints(docs, id_col, text_col).toDF("id", "fp"))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(distinct.select("fp"), distance, distinct.count() >= PLAIN))
    linked = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    alone = distinct.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("low").alias("component_id"))
    named = lookup(linked, lowest, "root").select("fp", "component_id").unionByName(alone)
    return lookup(prints, named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each component, that of the smallest id.

    Of repeated rows of that id the one with the smallest text stays (null before
    all others), of equal texts the one whose JSON is smallest; rows without an id
    stay. Ids name documents: rows of one id stay or go together.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = cut(near_duplicates(docs, id_col, text_col, distance).toDF("id", "fp", "component_id"))
    gone = found.where("id <> component_id").select("id").distinct()
    kept = packed.join(gone, "id", "left_anti")
    repeated = found.groupBy("id").count().where("count > 1 and id is not null").select("id")
    if not repeated.isEmpty():
        again = kept.join(repeated, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.struct("text", F.to_json(F.struct("row")))).alias("row"))
        kept = kept.join(repeated, "id", "left_anti").select("id", "row").unionByName(again)
    return kept.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """near_duplicates() with the fingerprint as 16 lowercase hex digits."""
    return found.select(F.col(f"`{id_col}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple], distance: int = DISTANCE) -> list[tuple]:
    """(id, fingerprint, component) by comparing all pairs; for tests."""
    prints = [(doc, fingerprint(text.encode() if text is not None else None)) for doc, text in docs]
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= distance:
                parent[root(i)] = root(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(prints):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return [(doc, f"{fp:016x}", low[root(i)]) for i, (doc, fp) in enumerate(prints)]

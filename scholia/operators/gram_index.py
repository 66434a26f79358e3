"""An inverted index of three-letter grams: boolean search without reading texts.

build() numbers the articles and keeps them in blocks of BLOCK, with three tables:

* articles: every column, number and block, files sorted by block;
* postings: for each gram and block the places in the block of the articles that
  have the gram in a searched column, by bucket of the gram;
* grams: the number of articles of each gram, by bucket.

A term of three characters or more can stand only where all its grams stand. For
each term the rarest few of its grams are taken, by their stored numbers, and
their postings are intersected block by block; AND, OR and NOT of a query are
joins of such rows by block, which intersect, unite and subtract places. What
postings cannot decide is left open: shorter terms, other columns, and NOT of
anything but a term that is one gram itself. A query that leaves everything open
is a scan. The articles that remain are read and judged by today's predicate, so
that the result is that of a search without an index.

Only buckets of a query's own grams are read, and of the articles only files and
row groups of blocks with a candidate.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.plans import predicate
from scholia.session import stored

#: Characters of a gram, articles of a block, buckets of grams, and grams of a term that are looked up.
GRAM, BLOCK, BUCKETS, RAREST = 3, 4096, 64, 3
#: Most blocks with candidates that are named to the reader of the articles; beyond it, a join alone.
NAMED_BLOCKS = 10_000
#: Most candidates whose places are sent to every task; beyond it, articles and candidates meet in a shuffle join.
SENT_PLACES = 10_000_000
#: The columns that are indexed.
COLUMNS = ("title", "abstract", "authors", "journal")


@dataclass(frozen=True)
class Open:
    """What postings cannot decide: any article may be one."""


@dataclass(frozen=True)
class Term:
    """Articles that have all grams of a term; exact if the term is one gram and all indexed columns are searched."""

    grams: tuple[str, ...]
    exact: bool


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    """Articles of the first, or any if it is open, that have not the one gram of the second."""

    left: object
    right: Term


def bucket_of(gram: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(gram.encode()) % buckets


def grams_of(text: str) -> set[str]:
    """The different grams of lower-cased text."""
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def build(articles: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Write the index of articles to path, with all their columns."""
    spark = articles.sparkSession
    named = predicate.with_search_columns(articles)
    numbered = named.withColumn("number", F.monotonically_increasing_id())
    numbered.withColumn("block", F.floor(F.col("number") / block)).write.parquet(f"{path}/articles")
    # Lower-cased by Spark, as the predicate does.
    lowered = spark.read.parquet(f"{path}/articles").select("number", *[F.lower(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(columns)])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, array] = {}
        here = None

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for low in range(0, len(names), 8192):
                some = names[low : low + 8192]
                ends = np.cumsum([0, *(len(held[g]) for g in some)], dtype=np.int32)
                places = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.frombuffer(held[g], np.int32) for g in some])))
                columns = [pa.array([bucket_of(g, buckets) for g in some], pa.int32()), pa.array(some), pa.array([here] * len(some), pa.int64()), places]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "gram", "block", "places"])
            held.clear()

        for batch in batches:
            for at in range(batch.num_rows):  # one text at a time is Python's own
                number, *texts = (batch.column(i)[at].as_py() for i in range(batch.num_columns))
                if number // block != here:
                    if here is not None:
                        yield from flush()
                    here = number // block
                place = number % block
                for gram in set().union(*(grams_of(t) for t in texts if t)):
                    if gram in held:
                        held[gram].append(place)
                    else:
                        held[gram] = array("i", (place,))
        if here is not None:
            yield from flush()

    # Stored, as ranges are found by a pass of their own.
    postings = stored(lowered.mapInArrow(post, "bucket int, gram string, block long, places array<int>"))
    # A block that two tasks read has a row of each. Ranges, so that a frequent gram is written by as many tasks as it needs.
    postings.repartitionByRange("bucket", "gram", "block").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.sum(F.size("places")).alias("articles"))
    counted.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")


def plan_of(query: str, search_field: str = "title/abstract", columns: tuple[str, ...] = COLUMNS):
    """What postings can say of a query: a tree of Term, Both, Either, Without, and Open."""

    def leaf(text: str, tag: str | None, phrase: bool, searched: list[str]):
        searched = predicate.searched_columns(tag, searched)
        if searched is None or not set(searched) <= set(columns):
            return Open()
        found: object = Open()
        for term in [" ".join(text.split())] if phrase else text.split():
            if len(lowered := term.lower()) >= GRAM:
                found = both(found, Term(tuple(sorted(grams_of(lowered))), len(lowered) == GRAM and set(searched) == set(columns)))
        return found

    def both(left, right):
        if isinstance(left, Open):
            return right
        return left if isinstance(right, Open) else Both(left, right)

    def either(left, right):
        return Open() if isinstance(left, Open) or isinstance(right, Open) else Either(left, right)

    def negated(inner):
        return Without(Open(), inner) if isinstance(inner, Term) and inner.exact else Open()

    return predicate.read(query, search_field, leaf, lambda first, last: Open(), both, either, negated)


def terms_in(plan) -> list[Term]:
    if isinstance(plan, Term):
        return [plan]
    if isinstance(plan, (Both, Either, Without)):
        return terms_in(plan.left) + terms_in(plan.right)
    return []


def counts_of(spark: SparkSession, path: str, grams: set[str], buckets: int = BUCKETS) -> dict[str, int]:
    """How many articles have each of a query's grams, from their buckets alone; those of none are left out."""
    if not grams:
        return {}
    found = spark.read.parquet(f"{path}/grams").where(F.col("bucket").isin(sorted({bucket_of(g, buckets) for g in grams})) & F.col("gram").isin(sorted(grams)))
    return {r["gram"]: r["articles"] for r in found.collect()}  # a query's grams


def candidates(spark: SparkSession, path: str, plan, counts: dict[str, int], buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame | None:
    """block, places of the articles that a plan leaves; None for all."""

    def postings(term: Term) -> DataFrame:
        chosen = sorted(term.grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
        rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted({bucket_of(g, buckets) for g in chosen})) & F.col("gram").isin(chosen))
        # A row for each gram and block, of two tasks at most two.
        each = rows.groupBy("block", "gram").agg(F.flatten(F.collect_list("places")).alias("places")).groupBy("block").agg(F.collect_list("places").alias("all"))
        first, rest = F.get("all", F.lit(0)), F.slice("all", 2, RAREST)
        return each.where(F.size("all") == len(chosen)).select("block", F.aggregate(rest, first, lambda found, more: F.array_intersect(found, more)).alias("places"))

    def found(node) -> DataFrame | None:
        if isinstance(node, Open):
            return None
        if isinstance(node, Term):
            return postings(node)
        left, right = found(node.left), found(node.right) if not isinstance(node, Without) else postings(node.right)
        if isinstance(node, Without):
            if left is None:
                left = spark.read.parquet(f"{path}/articles").groupBy("block").agg(F.collect_list((F.col("number") % block).cast("int")).alias("places"))  # of a block
            joined = left.join(right.withColumnRenamed("places", "gone"), "block", "left")
            return joined.select("block", F.array_except("places", F.coalesce("gone", F.array().cast("array<int>"))).alias("places")).where(F.size("places") > 0)
        right = right.withColumnRenamed("places", "more")
        if isinstance(node, Both):
            return left.join(right, "block").select("block", F.array_intersect("places", "more").alias("places")).where(F.size("places") > 0)
        none = F.array().cast("array<int>")
        return left.join(right, "block", "full").select("block", F.array_union(F.coalesce("places", none), F.coalesce("more", none)).alias("places"))

    return found(plan)


def search(spark: SparkSession, path: str, query: str, search_field: str = "title/abstract", columns: tuple[str, ...] = COLUMNS, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """The articles of an index that a boolean query finds, as predicate.search() finds them."""
    plan = plan_of(query, search_field, columns)
    held = spark.read.parquet(f"{path}/articles")
    counts = counts_of(spark, path, {g for t in terms_in(plan) for g in t.grams}, buckets)
    rows = candidates(spark, path, plan, counts, buckets, block)
    if rows is not None:
        rows = stored(rows.where(F.size("places") > 0))
        few = rows.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()  # NAMED_BLOCKS at most are used
        if len(few) <= NAMED_BLOCKS:
            held = held.where(F.col("block").isin([r["block"] for r in few]))
        if rows.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= SENT_PLACES:
            # A row for each block, so that articles stay where they are.
            own = F.array_contains("places", (F.col("number") % block).cast("int"))
            held = held.join(F.broadcast(rows), "block").where(own).drop("places")
        else:
            wanted = rows.select("block", F.explode("places").alias("place")).select((F.col("block") * block + F.col("place")).alias("number"))
            held = held.join(wanted, "number", "left_semi")
    return held.where(predicate.compile_query(query, search_field)).drop("number", "block")

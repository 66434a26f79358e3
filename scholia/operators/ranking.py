"""Relevance by BM25 with stored statistics, pages without a sort, and totals without a pass.

statistics() reads a table once and keeps its number of articles, their mean
length, and for each word the number of articles that have it, by bucket. A search
takes a query's words from their buckets and scores what it finds: rarer words
count more, repeats saturate, and long articles need more of them. The k best of a
task go on to the exchange, ties to the smaller key.

write_ranges() keeps articles in ranges of their key with the number in each, so
that a page is found by sums of these numbers and read from the ranges that it
lies in.

Sketches of distinct articles by topic and day are merged for any span of either,
beside exact counts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.plans import predicate

#: How soon repeats saturate, how much length counts, and buckets of words.
K1, B, BUCKETS = 1.2, 0.75, 32
#: Articles in a range.
RANGE_ROWS = 100_000
#: Bits of a sketch: its relative error is about 1.04 / sqrt(2 ** LG).
LG = 12
# A word is a run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words_of(columns: tuple[str, ...]) -> Column:
    """All words of an article's columns, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.concat_ws("\n", *[F.col(c) for c in columns])), F.lit(WORD), F.lit(0))


def statistics(articles: DataFrame, path: str, columns: tuple[str, ...] = ("title", "abstract"), buckets: int = BUCKETS) -> None:
    """Write what BM25 needs to know of a table: totals/ and words/."""
    split = articles.select(words_of(columns).alias("words"))
    split.agg(F.count("*").alias("articles"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).write.parquet(f"{path}/totals")
    counted = split.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("articles"))
    # Frequent words are added up where they are read. Ranges, as a bucket may have more words than a task should write.
    kept = counted.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    kept.repartitionByRange("bucket", "word").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{path}/words")


def known_words(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> tuple[int, float, dict[str, int]]:
    """Number of articles, their mean length, and the number of those that have each word, from the words' buckets alone."""
    total = spark.read.parquet(f"{path}/totals").first()
    asked = spark.createDataFrame([(w,) for w in words], "word string").select("word", F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket")).collect()
    stored = spark.read.parquet(f"{path}/words").where(F.col("bucket").isin(sorted({r["bucket"] for r in asked})) & F.col("word").isin(words))
    return total["articles"], total["words"] / max(1, total["articles"]), {r["word"]: r["articles"] for r in stored.collect()}  # a query's words


def bm25(words: Column, asked: list[str], articles: int, mean: float, frequencies: dict[str, int], k1: float = K1, b: float = B) -> Column:
    """The score of an article with these words for those that are asked for."""
    length, total = F.size(words), F.lit(0.0)
    for word in asked:
        df = frequencies.get(word, 0)
        weight = math.log(1 + (articles - df + 0.5) / (df + 0.5))
        tf = length - F.size(F.array_remove(words, word))
        total = total + F.lit(weight) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(max(mean, 1e-9))))
    return total


def asked_words(query: str) -> list[str]:
    """The different words that a boolean query looks for in texts, those of phrases too."""
    found = [w for term in predicate.query_words(query) for w in re.findall(r"[^\W_]+", term.lower())]
    return list(dict.fromkeys(found))


def score(spark: SparkSession, path: str, query: str, columns: tuple[str, ...] = ("title", "abstract")) -> Column:
    """The score of articles for the words of a boolean query, to six places."""
    asked = asked_words(query)
    return F.round(bm25(words_of(columns), asked, *known_words(spark, path, asked)), 6)


def best(articles: DataFrame, query: str, path: str, k: int, search_field: str = "title/abstract", columns: tuple[str, ...] = ("title", "abstract"), key: str = "doc_id") -> DataFrame:
    """The k most relevant articles that a boolean query finds, with their score."""
    found = predicate.search(articles, query, search_field)
    return found.withColumn("score", score(articles.sparkSession, path, query, columns)).orderBy(F.desc("score"), F.asc(key)).limit(k)


def write_ranges(articles: DataFrame, path: str, key: str, rows: int = RANGE_ROWS) -> None:
    """Write articles in ranges of a key, about `rows` in each, and the number in each range."""
    count = max(1, -(-articles.count() // rows))
    ranged = articles.repartitionByRange(count, key).sortWithinPartitions(key).withColumn("range", F.spark_partition_id())
    ranged.write.partitionBy("range").parquet(f"{path}/rows")
    held = articles.sparkSession.read.parquet(f"{path}/rows")
    held.groupBy(F.col("range").cast("int").alias("range")).agg(F.count("*").alias("n"), F.min(key).alias("first")).coalesce(1).write.parquet(f"{path}/counts")


def page(spark: SparkSession, path: str, key: str, limit: int, offset: int) -> DataFrame:
    """A page in the order of the key, read from the ranges that it lies in alone."""
    counts = spark.read.parquet(f"{path}/counts")  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before).where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    met = [(r["range"], r["before"]) for r in placed.select("range", "before").collect()]  # of one page
    held = spark.read.parquet(f"{path}/rows")
    skip = offset - min((b for _, b in met), default=offset)
    return held.where(F.col("range").isin([r for r, _ in met])).drop("range").orderBy(key).offset(skip).limit(limit)


def sketches(rows: DataFrame, article_col: str = "pmid", topic_col: str = "topic_id", day_col: str = "day") -> DataFrame:
    """topic, day, sketch of the different articles of each; they may be merged with union_of()."""
    return rows.groupBy(topic_col, day_col).agg(F.hll_sketch_agg(F.col(article_col).cast("string"), F.lit(LG)).alias("sketch"))


def union_of(sketched: DataFrame, *keys: str) -> DataFrame:
    """keys and about how many different articles there are in all of their sketches."""
    return sketched.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))

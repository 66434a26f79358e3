"""Life of topics: one status log, lookups, paging, retention, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROCESSING, COMPLETED, FAILED, TIMEOUT, CLEANED, NOT_FOUND = "processing", "completed", "failed", "timeout", "cleaned", "not_found"
TTL_SECONDS, RETENTION_DAYS = 3600, 7


def latest(log: DataFrame, key: str = "topic_id", at: str = "ts", tie: str = "event_id", *columns: str) -> DataFrame:
    """The last entry of each key in an append-only log; partial maxima before the shuffle."""
    rest = list(columns) or [c for c in log.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(at, tie))
    return log.groupBy(key).agg(last.alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def outcomes(events: DataFrame, as_of: Column, key: str = "topic_id") -> DataFrame:
    """key, status, ts of every started job at a time: its first end if that came in time, else timeout, else processing.

    events: key, event (start, done, error), max_results, ts, event_id. A job has
    60 + 2 * max_results seconds from its first start.
    """
    order = F.struct("ts", "event_id")
    starts = events.where("event = 'start'").groupBy(key).agg(F.min(F.struct("ts", "event_id", "max_results")).alias("start"))
    due = F.col("start.ts") + F.make_dt_interval(secs=60 + 2 * F.col("start.max_results"))
    later = events.where(F.col("event").isin("done", "error")).join(starts, key).where(order > F.struct("start.ts", "start.event_id"))
    ends = later.groupBy(key).agg(F.min(F.struct("ts", "event_id", "event")).alias("end"))
    ended = F.col("end.ts") <= F.col("due")
    found = starts.withColumn("due", due).join(ends, key, "left")
    status = F.when(ended, F.when(F.col("end.event") == "done", COMPLETED).otherwise(FAILED)).when(F.col("due") < as_of, TIMEOUT).otherwise(PROCESSING)
    at = F.when(ended, F.col("end.ts")).when(F.col("due") < as_of, F.col("due")).otherwise(F.col("start.ts"))
    return found.select(key, status.alias("status"), at.alias("ts"))


def status_of(asked: DataFrame, tasks: DataFrame, topics: DataFrame, key: str = "topic_id") -> DataFrame:
    """asked with status: that of a running task, else of the topic table, else not_found."""
    joined = asked.join(tasks.select(key, F.col("status").alias("_task")), key, "left").join(topics.select(key, F.col("status").alias("_topic")), key, "left")
    return joined.withColumn("status", F.coalesce("_task", "_topic", F.lit(NOT_FOUND))).drop("_task", "_topic")


def http_code(status: Column) -> Column:
    """The answer code of a question about a topic in that status."""
    return F.when(status == COMPLETED, 200).when(status == NOT_FOUND, 404).otherwise(422)


def alive(entries: DataFrame, as_of: Column, finished: str = "finished_at", seconds: int = TTL_SECONDS) -> DataFrame:
    """Task entries that are unfinished or were finished less than the time to live ago."""
    return entries.where(F.col(finished).isNull() | (F.col(finished) > as_of - F.make_dt_interval(secs=F.lit(seconds))))


def expired(topics: DataFrame, as_of: Column, days: int = RETENTION_DAYS, created: str = "created_at") -> DataFrame:
    """Topics created strictly before the retention time and not cleaned yet."""
    if days < 1:
        raise ValueError("retention is one day or more")
    return topics.where((F.col(created) < as_of - F.make_dt_interval(days=F.lit(days))) & (F.col("status") != CLEANED))


def cleanup_counts(outcomes: DataFrame, ok: Column) -> DataFrame:
    """total, cleaned and failed of a cleanup's outcomes."""
    return outcomes.agg(F.count("*").alias("total"), F.count_if(ok).alias("cleaned"), F.count_if(~ok).alias("failed"))


def page(articles: DataFrame, topic: Column, limit: int = 100, offset: int = 0, order: str = "pmid") -> DataFrame:
    """A page of a topic's articles in the order of a key, so that pages part the whole."""
    return articles.where(topic).orderBy(order).offset(offset).limit(limit)


def page_info(articles: DataFrame, topic: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    """total, limit, offset, has_more."""
    return articles.where(topic).agg(F.count("*").alias("total")).select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def article_counts(articles: DataFrame, key: str = "topic_id") -> DataFrame:
    return articles.groupBy(key).agg(F.count("*").alias("articles"))


def ranked(found: DataFrame, sort: str, score: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Search results in a sort order: relevance (score, best first) or a column; ties by key."""
    columns = {"title": F.asc("title"), "journal": F.asc("journal"), "publication_date": F.desc("publication_date"), "first_author": F.asc(F.substring_index("authors", "; ", 1)), "last_author": F.asc(F.substring_index("authors", "; ", -1))}
    first = F.desc(score) if sort == "relevance" and score is not None else columns.get(sort, F.asc(key))
    return found.orderBy(first, F.asc(key))


def term_score(text: Column, words: list[str]) -> Column:
    """Relevance: how often the words, taken literally, occur in the lower-cased text."""
    lowered, total = F.lower(F.coalesce(text, F.lit(""))), F.lit(0)
    for word in words:
        total = total + ((F.length(lowered) - F.length(F.replace(lowered, F.lit(word), F.lit("")))) / len(word)).cast("int")
    return total

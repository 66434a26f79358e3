"""Ingest jobs as streams: requests in, a status log out, timeouts and expiry by timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholia.operators.topics import COMPLETED, FAILED, PROCESSING, TIMEOUT, TTL_SECONDS
from scholia.plans import engine
from scholia.plans.request import InvalidRequest, TopicRequest
from scholia.session import Settings, stored

REQUESTS = "topic_id string, query string, max_results int, ts timestamp"
EVENTS = "topic_id string, event string, max_results int, ts timestamp"
STATUS = "topic_id string, status string, ts timestamp"
#: Events that end a job, with the status that they give.
ENDS = {"done": COMPLETED, "error": FAILED}


def status_machine(events: DataFrame, delay: str = "1 minute", ttl: int = TTL_SECONDS) -> DataFrame:
    """topic_id, status, ts from events start, done and error, by event time.

    A job that has not ended 60 + 2 * max_results seconds after its start times
    out: when the watermark passes, or when an end arrives that is later than
    that. What comes after an end changes nothing until ttl seconds later, when
    the state is removed and the topic may start again. Use as a stream, appended.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        status, due = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            if status == PROCESSING:
                rows.append((key[0], TIMEOUT, pd.Timestamp(due, unit="ms")))
                status, due = TIMEOUT, due + 1000 * ttl
            else:
                status = None
        else:
            found = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for row in found.itertuples(index=False):
                now = int(row.ts.timestamp() * 1000)
                if row.event == "start" and status is None:
                    status, due = PROCESSING, now + 1000 * (60 + 2 * int(row.max_results))
                    rows.append((key[0], PROCESSING, row.ts))
                elif row.event in ENDS and status == PROCESSING:
                    status, at = (ENDS[row.event], row.ts) if now <= due else (TIMEOUT, pd.Timestamp(due, unit="ms"))
                    rows.append((key[0], status, at))
                    # From here on, due is the time at which the state goes.
                    due = min(now, due) + 1000 * ttl
        if status is not None:
            state.update((status, due))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["topic_id", "status", "ts"])

    watched = events.withWatermark("ts", delay)
    return watched.groupBy("topic_id").applyInPandasWithState(step, STATUS, "status string, due long", "append", GroupStateTimeout.EventTimeTimeout)


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Events as they arrive as JSON files in a folder."""
    return spark.readStream.schema(schema).json(path)


def run_ingest(requests: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every batch of requests through ingest(batch, id), once each, with what is there now."""
    return requests.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_requests(source: DataFrame, requests: DataFrame, path: str, checkpoint: str, as_of: date) -> StreamingQuery:
    """A stream of requests (REQUESTS) as ingest jobs into a store, with the store's log of statuses.

    Each request of a batch is a generation named by both, so that a batch that is
    tried again leaves out what it completed before and replaces what it began; a
    topic asked for again in a later batch is fetched again. A request that cannot
    be searched for is a failed topic and stops nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = F.sha2(F.concat_ws("|", F.lit(str(number)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("topic_id", "query", "max_results", "ts")]), 256)
        named = stored(batch.withColumn("generation", name).dropDuplicates(["generation"]))
        done = engine.read_log(spark, path).where(F.col("status") == COMPLETED).select("generation")
        for row in named.join(done, "generation", "left_anti").orderBy("ts", "generation").toLocalIterator():
            try:
                request = TopicRequest(advanced_query=row["query"], max_results=row["max_results"])
            except InvalidRequest as error:
                engine.append_status(spark, path, row["topic_id"], FAILED, error=str(error))
                continue
            engine.ingest(source, spark, request, row["topic_id"], path, as_of, generation=row["generation"])

    return run_ingest(requests, each, checkpoint)


def run_retention(spark: SparkSession, path: str, checkpoint: str, settings: Settings | None = None, seconds: int | None = None) -> StreamingQuery:
    """Clean up expired topics again and again, every cleanup_interval_hours of the settings (or so many seconds)."""
    settings = settings or Settings.from_env()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    every = f"{seconds} seconds" if seconds else f"{settings.cleanup_interval_hours} hours"

    def clean(_: DataFrame, __: int) -> None:
        engine.cleanup_old(spark, path, datetime.now(UTC), settings.retention_days)

    return ticks.writeStream.foreachBatch(clean).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

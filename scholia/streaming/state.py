"""Stateful processors: the status machine of jobs by event time, and the memory of conversations.

Both run on transformWithState with RocksDB state. What they hold can be read from
outside while the streams run, from their checkpoints, with Spark's state reader.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scholia.operators import answers
from scholia.operators.topics import COMPLETED, FAILED, PROCESSING, TIMEOUT, TTL_SECONDS

EVENTS = "topic_id string, event string, max_results int, ts timestamp, event_id long"
TURNS = "conversation_id string, turn long, role string, text string, at timestamp"
#: Events that end a job, with the status that they give.
ENDS = {"done": COMPLETED, "error": FAILED}
#: Turns of a conversation that are remembered.
KEPT_TURNS = 100
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class StatusMachine(StatefulProcessor):
    """The statuses of a topic's job, in the order of event time whatever the order of arrival.

    Events wait in a list until the watermark has passed them, so that what comes
    out is what topics.outcomes() says of the same events: the first start counts,
    its first end if that is in time, else a timeout. A job that has ended holds its
    status for `ttl` seconds, in which other events change nothing; from then on the
    topic may start again, and its state goes when the watermark has passed.
    """

    def __init__(self, ttl: int = TTL_SECONDS):
        self.ttl = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at long, due long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, event string, max_results int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        new = [(r["ms"], r["event_id"], r["event"], r["max_results"]) for r in rows]
        if self.job.exists() and self.job.get()[0] != PROCESSING:
            again = self.job.get()[1] + self.ttl
            new = [x for x in new if x[0] >= again]
            if not new:
                return iter(())
            self._forget()
        self.waiting.appendList(new)
        return self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.job.exists() and self.job.get()[0] != PROCESSING:
            _, at, _ = self.job.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= at + self.ttl:
                self._forget()
            return iter(())
        return self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, now: int) -> Iterator[Row]:
        """Say what is sure at a watermark, and wait for what comes next."""
        waiting = sorted(tuple(x) for x in self.waiting.get())
        out, status, due = [], None, None
        if self.job.exists():
            status, start, due = self.job.get()
        else:
            first = next((x for x in waiting if x[2] == "start"), None)
            start = first[0] if first else None
            if first is not None and start <= now:
                status, due = PROCESSING, start + 1000 * (60 + 2 * first[3])
                self.job.update((status, start, due))
                out.append(Row(topic_id=key[0], status=status, ms=start))
                # What came before the start is of no job.
                waiting = waiting[waiting.index(first) + 1 :]
                self.waiting.put(waiting) if waiting else self.waiting.clear()
        if status == PROCESSING:
            end = next((x for x in waiting if x[2] in ENDS), None)
            if end is not None and end[0] <= min(now, due):
                self._close(ENDS[end[2]], end[0], now)
                out.append(Row(topic_id=key[0], status=ENDS[end[2]], ms=end[0]))
            elif due < now:
                self._close(TIMEOUT, due, now)
                out.append(Row(topic_id=key[0], status=TIMEOUT, ms=due))
            else:
                self.handle.registerTimer(due + 1)
                if end is not None and end[0] <= due:
                    self.handle.registerTimer(max(end[0], now + 1))
        elif start is not None:
            self.handle.registerTimer(max(start, now + 1))
        elif waiting:
            # Ends without a start: kept for as long as a job may take to be told of, then dropped.
            if waiting[-1][0] + self.ttl <= now:
                self.waiting.clear()
            else:
                self.handle.registerTimer(waiting[-1][0] + self.ttl)
        return iter(out)

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.waiting.clear()
        self.job.clear()

    def _close(self, status: str, at: int, now: int) -> None:
        """Hold an ended job, unless the topic's next one is waiting already."""
        later = sorted(x for x in map(tuple, self.waiting.get()) if x[0] >= at + self.ttl)
        self._forget()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(max(later[0][0], now + 1))
        else:
            self.job.update((status, at, at))
            self.handle.registerTimer(at + self.ttl)

    def close(self) -> None:
        pass


def statuses(events: DataFrame, delay: str = "1 minute", ttl: int = TTL_SECONDS) -> DataFrame:
    """topic_id, status, ts from a stream of events (EVENTS), appended as they become sure."""
    use_rocksdb(events.sparkSession)
    # Times go through Python as milliseconds, which have no time zone.
    watched = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    found = watched.groupBy("topic_id").transformWithState(StatusMachine(ttl), "topic_id string, status string, ms long", "Append", "EventTime")
    return found.select("topic_id", "status", F.timestamp_millis("ms").alias("ts"))


class Memory(StatefulProcessor):
    """The newest turns of a conversation, and when it was first seen; forgotten when it is idle for `idle` seconds."""

    def __init__(self, keep: int = KEPT_TURNS, idle: int = 7 * 24 * 3600):
        self.keep, self.idle = keep, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first_seen long", self.idle)
        self.turns = handle.getListState("turns", "turn long, role string, text string, at long", self.idle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["turn"], r["role"], r["text"], r["ms"]) for r in rows]
        held = sorted({tuple(x) for x in self.turns.get()} | set(new), key=lambda t: (t[0], t[3]))
        self.turns.put(held[-self.keep :])
        first = min(t[3] for t in new)
        self.seen.update((min(first, self.seen.get()[0]) if self.seen.exists() else first,))
        yield Row(conversation_id=key[0], turns=min(len(held), self.keep))

    def close(self) -> None:
        pass


def remembered(turns: DataFrame, keep: int = KEPT_TURNS, idle: int = 7 * 24 * 3600) -> DataFrame:
    """conversation_id and number of turns held, for every conversation that a batch of turns (TURNS) goes on with."""
    use_rocksdb(turns.sparkSession)
    return turns.withColumn("ms", F.unix_millis("at")).groupBy("conversation_id").transformWithState(Memory(keep, idle), "conversation_id string, turns int", "Update", "ProcessingTime")


def _state(spark: SparkSession, checkpoint: str, name: str, **options) -> DataFrame:
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    for option, value in options.items():
        reader = reader.option(option, value)
    return reader.load()


def running(spark: SparkSession, checkpoint: str) -> DataFrame:
    """topic_id, status, at, due of every job that the status stream holds now."""
    held = _state(spark, checkpoint, "job")
    return held.select("key.topic_id", "value.status", F.timestamp_millis("value.at").alias("at"), F.timestamp_millis("value.due").alias("due"))


def memory(spark: SparkSession, checkpoint: str, keep: int = answers.KEPT_CONVERSATIONS) -> DataFrame:
    """conversation_id, turn, role, text, at of the `keep` conversations that began last, from the state of remembered()."""
    began = _state(spark, checkpoint, "seen").select("key.conversation_id", F.col("value.value.first_seen").alias("first_seen"))
    newest = began.orderBy(F.desc("first_seen"), F.desc("conversation_id")).limit(keep)
    turns = _state(spark, checkpoint, "turns", flattenCollectionTypes="true").select("key.conversation_id", F.col("list_element.value.*"))
    held = turns.join(F.broadcast(newest.select("conversation_id")), "conversation_id", "left_semi")  # `keep` rows
    return held.withColumn("at", F.timestamp_millis("at"))

"""Stateful streams against the batch forms of the same."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scholia.operators import topics
from scholia.streaming import state

ZERO = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """A state store for each partition and batch takes a while to start."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(seconds: float) -> str:
    return (ZERO + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S")


def put(folder, n: int, rows: list[dict]) -> None:
    """A file of the stream; files are read in the order of their times."""
    place = folder / f"{n}.json"
    place.write_text("\n".join(map(json.dumps, rows)))
    os.utime(place, (1_700_000_000 + n, 1_700_000_000 + n))


def run(spark, stream, tmp_path, mode):
    sink = f"s{random.randrange(10**9)}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(sink)


def test_statuses_are_those_of_the_batch_form(spark, tmp_path):
    """Shuffled events over many batches: whatever the order of arrival, what comes out is what the whole log says."""
    rnd = random.Random(6)
    events, number = [], 0
    for topic in range(25):
        start, allowed = rnd.randint(0, 40), rnd.randint(1, 10)
        kinds = [("start", start)] * rnd.choice([0, 1, 1, 1, 2]) + [(rnd.choice(["done", "error"]), start + rnd.choice([-5, 0, 10, 50, 61, 75, 100])) for _ in range(rnd.randint(0, 3))]
        for kind, second in kinds:
            number += 1
            events.append((f"t{topic}", kind, allowed, at(second), number))
    rnd.shuffle(events)
    folder = tmp_path / "events"
    folder.mkdir()
    fields = ["topic_id", "event", "max_results", "ts", "event_id"]
    # The last file moves the watermark past all others.
    parts = [events[i::4] for i in range(4)] + [[("end", "done", 1, at(5000), 10**6)]]
    for n, part in enumerate(parts):
        put(folder, n, [dict(zip(fields, e, strict=True)) for e in part])
    stream = spark.readStream.schema(state.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
    found = run(spark, state.statuses(stream, "10 minutes", ttl=100_000), tmp_path, "append")
    log = spark.createDataFrame(events, "topic_id string, event string, max_results int, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    want = {r["topic_id"]: (r["status"], r["ts"]) for r in topics.outcomes(log, F.lit(at(4000)).cast("timestamp")).collect()}
    rows = found.collect()
    got = {r["topic_id"]: (r["status"], r["ts"]) for r in sorted(rows, key=lambda r: (r["ts"], r["status"] != "processing"))}
    assert got == want and len({s for s, _ in want.values()}) == 3
    assert sorted(r["topic_id"] for r in rows if r["status"] == "processing") == sorted(want)
    held = {r["topic_id"]: r["status"] for r in state.running(spark, str(tmp_path / "cp")).collect()}
    assert held == {t: s for t, (s, _) in want.items()}


def test_state_of_ended_jobs_goes_and_topics_start_again(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    parts = [[("a", "start", 1, 0, 1), ("a", "done", 1, 5, 2)], [("x", "done", 1, 900, 4)], [("a", "start", 1, 1000, 5), ("a", "error", 1, 1010, 6)], [("x", "done", 1, 9000, 8)], [("x", "done", 1, 9500, 9)]]
    for n, part in enumerate(parts):
        put(folder, n, [{"topic_id": t, "event": e, "max_results": m, "ts": at(s), "event_id": i} for t, e, m, s, i in part])
    stream = spark.readStream.schema(state.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
    found = run(spark, state.statuses(stream, "1 second", ttl=60), tmp_path, "append")
    assert [(r["status"], (r["ts"] - ZERO).total_seconds()) for r in found.where("topic_id = 'a'").orderBy("ts").collect()] == [("processing", 0), ("completed", 5), ("processing", 1000), ("failed", 1010)]
    assert state.running(spark, str(tmp_path / "cp")).count() == 0


def test_memory_keeps_the_newest_turns_and_conversations(spark, tmp_path):
    folder = tmp_path / "turns"
    folder.mkdir()
    rows = [(f"c{c}", n, "user" if n % 2 == 0 else "assistant", f"said {c} {n}", at(c * 1000 + n)) for c in range(5) for n in range(120 if c == 3 else 4)]
    random.Random(1).shuffle(rows)
    fields = ["conversation_id", "turn", "role", "text", "at"]
    for n in range(2):
        put(folder, n, [dict(zip(fields, r, strict=True)) for r in rows[n::2]])
    stream = spark.readStream.schema(state.TURNS).option("maxFilesPerTrigger", 1).json(str(folder))
    told = run(spark, state.remembered(stream), tmp_path, "update")
    assert told.groupBy("conversation_id").agg(F.max("turns").alias("n")).where("conversation_id = 'c3'").first()["n"] == 100
    held = state.memory(spark, str(tmp_path / "cp"), keep=2).orderBy("conversation_id", "turn").collect()
    assert [(r["conversation_id"], r["turn"]) for r in held] == [("c3", n) for n in range(20, 120)] + [("c4", n) for n in range(4)]
    assert held[-1]["text"] == "said 4 3" and held[-1]["role"] == "assistant"
    assert state.memory(spark, str(tmp_path / "cp")).select("conversation_id").distinct().count() == 5

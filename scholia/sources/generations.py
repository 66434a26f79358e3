"""Tables of topics that can be written again: generations, and the log that says which one holds.

A topic's rows in a table are a generation of their own, a folder below the
topic's. What is written counts for nothing until the log has an entry
`completed` with the generation's name, which is one file: a reader who has read
the log sees the whole of a generation or nothing of it, in all tables alike. A
generation that is written again, by a job that is tried again, replaces itself
(dynamic partition overwrite), and one that fails is dropped while the one before
stays. Of the generations that were replaced the last one stays for readers who
have begun with it.

The log has a folder for each day. compact() makes one file of each past day.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.operators.topics import CLEANED, COMPLETED
from scholia.session import stored

LOG = "topic_id string, status string, ts timestamp, event_id long, detail string, generation string"


def write(rows: DataFrame, path: str, generation: str, topic_col: str = "topic_id", form: str = "parquet") -> None:
    """Write rows as a generation of their topics; written again, it replaces itself and nothing else."""
    named = rows.withColumn("generation", F.lit(generation))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(topic_col, "generation").format(form).save(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log below path, empty where there is none yet."""
    try:
        return spark.read.schema(f"{LOG}, day string").parquet(f"{path}/log").drop("day")
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def append(entries: DataFrame, path: str) -> None:
    """Add entries to the log, in a file for each day of theirs and task that has any."""
    dated = entries.select(*[F.col(c) for c in entries.columns], F.date_format("ts", "yyyy-MM-dd").alias("day"))
    dated.write.mode("append").partitionBy("day").parquet(f"{path}/log")


def compact(spark: SparkSession, path: str, before: date) -> None:
    """One file for each day of the log before a date; entries stay as they are. Days that are over have no writers."""
    log = spark.read.schema(f"{LOG}, day string").parquet(f"{path}/log").where(F.col("day") < before.isoformat())
    held = stored(log)
    held.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/log")


def ended(log: DataFrame) -> Column:
    """Which entries begin or end what a topic holds."""
    return ((F.col("status") == COMPLETED) & F.col("generation").isNotNull()) | (F.col("status") == CLEANED)


def valid(log: DataFrame) -> DataFrame:
    """topic_id, generation: of every topic the generation that was completed last, if it was not cleaned since."""
    last = log.where(ended(log)).groupBy("topic_id").agg(F.max_by(F.struct("status", "generation"), F.struct("ts", "event_id")).alias("last"))
    return last.where(F.col("last.status") == COMPLETED).select("topic_id", F.col("last.generation").alias("generation"))


def replaced(log: DataFrame, keep: int = 1) -> DataFrame:
    """topic_id, generation of those completed that later ones replaced, but for the last `keep` of each topic."""
    done = log.where(ended(log) & (F.col("status") == COMPLETED)).groupBy("topic_id", "generation").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("at")))
    return done.withColumn("place", place).where(F.col("place") > keep + 1).select("topic_id", "generation")


def of_topic(table: DataFrame, generation: str | None, topic_id: str, topic_col: str = "topic_id") -> DataFrame:
    """The rows of a topic in a generation, read from its folder alone; none without a generation."""
    held = (F.col(topic_col) == topic_id) & (F.col("generation") == generation) if generation is not None else F.lit(False)
    return table.where(held).drop("generation")


def whole(table: DataFrame, log: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """The rows of all topics that hold."""
    held = valid(log).withColumnRenamed("topic_id", topic_col)
    return table.join(held, [topic_col, "generation"], "left_semi").drop("generation")

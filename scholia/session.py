"""Session defaults and checkpoint folder handling shared by every job."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """What a service can be set to; from_env() reads SCHOLIA_<NAME> and refuses what is no number of that kind."""

    retention_days: int = 7
    cleanup_interval_hours: int = 24
    status_ttl_seconds: int = 3600
    max_conversations: int = 100
    max_answer_sentences: int = 3
    embedding_dims: int = 256

    def __post_init__(self) -> None:
        for field in fields(self):
            if not isinstance(getattr(self, field.name), int) or getattr(self, field.name) < 1:
                raise ValueError(f"{field.name} is a whole number from 1 on")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {field.name: env[key] for field in fields(cls) if (key := f"SCHOLIA_{field.name.upper()}") in env}
        try:
            return cls(**{name: int(value) for name, value in given.items()})
        except ValueError as error:
            raise ValueError(f"settings from the environment: {error}") from error


def get_session(app: str = "scholia", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on: UTC, AQE, Arrow.

    On a cluster, master and partitions stay unset and the submit settings hold.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Ids in folder names stay texts: topic 007 is not topic 7.
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`; read by Spark alone, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over as many partitions as the session has cores, where its files give fewer; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if not found:
        found = context.getConf().get("spark.checkpoint.dir")
        if not found:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = os.path.join(tempfile.gettempdir(), "scholia-checkpoints")
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder; smaller than a checkpoint, read by column."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

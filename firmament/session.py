"""Session helpers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("firmament")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Test tables are tiny: keep the few tasks they yield apart.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`); one of our own only in local mode, as in tests."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="firmament-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by key into as many partitions as shuffles have, ahead of a step that makes far more of a row than its bytes tell.

    A small file is one split and a small shuffle is merged to a few partitions: without this one task would do all of the step.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def literal_map(mapping: dict):
    """A string->string map literal, folded into the plan: no join, no shuffle."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def pin(df: DataFrame, **columns) -> DataFrame:
    """Add columns computed exactly once.

    A later filter on an ordinary computed column is pushed below it as a copy of its whole
    expression, once per mention. Emitting the values through a one-row generator keeps
    trigonometry and higher-order expressions from being repeated that way.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(row)))

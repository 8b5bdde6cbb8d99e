"""A session with the settings the library relies on: UTC, adaptive execution, ANSI casts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where that is unset and all runs in one process
    (local mode, as in tests) one is set here; a cluster without it is refused, since each executor has its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Local mode gets as many shuffle partitions as cores; a cluster keeps its own settings."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName("tidemark")
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or os.environ.get("BENCH_CPUS", "8")), "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()

"""Session settings the jobs rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: str | int = "*", app: str = "titleloom", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **SETTINGS,
        # single small files have one split; only local sessions deal them out to all cores
        "titleloom.input.partitions": str(cores),
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "16g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

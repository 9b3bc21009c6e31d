"""What runs here."""

from __future__ import annotations

from pyspark.sql import SparkSession

VERSION = "0.1.0"


def engine_info(spark: SparkSession) -> dict[str, str | int | bool]:
    """Version and the session's settings that plans depend on."""
    get = spark.conf.get
    return {
        "version": VERSION,
        "spark": spark.version,
        "master": spark.sparkContext.master,
        "parallelism": spark.sparkContext.defaultParallelism,
        "shuffle_partitions": int(get("spark.sql.shuffle.partitions")),
        "adaptive": get("spark.sql.adaptive.enabled") == "true",
        "time_zone": get("spark.sql.session.timeZone"),
    }

"""Sessions with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results: time zone, and page checksums that are checked.  Speed: adaptive plans, split skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.hadoop.parquet.page.verify-checksum.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "quernel", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

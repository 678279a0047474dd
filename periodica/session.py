"""Session settings that the queries are written for.

Queries of one season total line items per order before they join the season's orders. A Bloom
filter of the season's order keys, put by Spark below that total, keeps other seasons' line items
from being totalled and shuffled. By default Spark makes none where the scan is under 10 GB or the
keys' side over 10 MB; ``SEASON_FILTER`` lifts both. Its size is Spark's own limit (8 MB, up to
4 million keys at a few per cent of false positives): with more orders in a season it lets more and
more other line items pass, and from about 50 million on the plan is that without a filter. Sessions
without these settings have that plan from the start; the answers are the same.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


SEASON_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
}


def local_session(
    app: str, cores: int | str = "*", partitions: int = 8, **settings: str
) -> SparkSession:
    """A session on this machine, for tests and the benchmark; ``settings`` use _ for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for name, value in SEASON_FILTER.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()

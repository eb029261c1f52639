"""Sessions with the settings that the library's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Case-sensitive names; timestamps without a zone; runtime re-planning with skew handling.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "millrace", master: str | None = None, **settings: str) -> SparkSession:
    """A session; on a cluster leave master unset. Settings are Spark's, with _ for the dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session that exists already."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark

"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "helixframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; ANSI stays on, so casts of foreign text use try_cast."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()

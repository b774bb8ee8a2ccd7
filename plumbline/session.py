"""Session settings the audit relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app_name: str = "plumbline", **conf: str) -> SparkSession:
    """Create or reuse a session; keyword settings replace the defaults below."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Call-site capture costs more than planning for rules this wide.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

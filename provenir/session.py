"""A session as the engine expects it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "provenir", **conf: str) -> SparkSession:
    """AQE on, UTC, ANSI left on; conf overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both read and write: spark.checkpoint.dir, or a temporary folder where they are one process."""
    if base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    base = "file://" + tempfile.mkdtemp(prefix="provenir-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def checkpointed(df):
    """df, computed once and kept in the session's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

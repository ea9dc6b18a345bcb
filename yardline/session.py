"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Months and hours are computed on dates and zone-less timestamps; UTC keeps CSV texts stable.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesced partitions, broadcast by measured size, split skewed partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Long CASE expressions may pass HotSpot's size limit for compiled methods.
JAVA_OPTIONS = "-XX:-DontCompileHugeMethods"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings to a session builder."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for role in ("driver", "executor"):
        builder = builder.config(f"spark.{role}.extraJavaOptions", JAVA_OPTIONS)
    return builder


def local_session(cores: int = 8, name: str = "yardline", driver_memory: str = "8g") -> SparkSession:
    """A quiet local session, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

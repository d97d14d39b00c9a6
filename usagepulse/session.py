"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC fixes what "the day of a timestamp" means; adaptive execution sizes shuffle
# partitions, splits skewed join partitions and switches joins by measured size.
SETTINGS = {
    # HotSpot leaves a method of more bytecode uncompiled; rows then run through smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(app: str, cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        # Skips recording the Python call site of every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

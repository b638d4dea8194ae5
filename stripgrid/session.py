"""A Spark session with the settings these jobs rely on. Any existing session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small shuffles shrink to few tasks, for persisted frames too.
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.session.timeZone": "UTC",
    # Dense kernels run once per task slot; one BLAS thread each avoids oversubscription.
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    # Bounds the bytes a Python worker receives at once when rows are wide.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 2**20),
    # Drops checkpoint files once the frame that wrote them is gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app_name: str = "stripgrid", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()

"""Request counts and cumulative latency buckets, the same job on tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from remitlens.constants import LATENCY_BUCKETS


def request_metrics(
    events: DataFrame, every: str = "1 day", endpoint: str = "event_type", status: str | None = None, latency: str = "value",
    ts: str = "ts", bounds: Sequence[float] = LATENCY_BUCKETS, late_by: str | None = None,
) -> DataFrame:
    """Per window and endpoint (and status): count, latency sum and cumulative buckets.

    On a stream pass ``late_by``, the watermark delay; a window is emitted once
    the watermark has passed it.
    """
    source = events.withWatermark(ts, late_by) if late_by else events
    keys = [F.col(endpoint).alias("endpoint")] + ([F.col(status).alias("status")] if status else [])
    counted = source.groupBy(F.window(ts, every).alias("w"), *keys).agg(
        F.count("*").alias("requests"),
        F.sum(latency).alias("latency_sum"),
        *[F.sum((F.col(latency) <= F.lit(float(b))).cast("long")).alias(f"le_{i}") for i, b in enumerate(bounds)],
    )
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)])
    return counted.select(
        F.col("w.start").alias("window_start"), "endpoint", *(["status"] if status else []), "requests", "latency_sum", buckets.alias("buckets")
    )


def write_latest(metrics: DataFrame, path: str, state: str) -> StreamingQuery:
    """Write what each batch changed, open windows included, to a folder of its own.

    A batch that runs again replaces its folder; ``latest`` reads the newest row of every window.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return metrics.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Newest row per window and endpoint (and status) of the folders that ``write_latest`` made."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    keys = [c for c in ("window_start", "endpoint", "status") if c in rows.columns]
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *[c for c in others if c != "batch"])).alias("last"))
    return newest.select(*keys, *[F.col(f"last.{c}") for c in others if c != "batch"])


def bucket_rows(metrics: DataFrame) -> DataFrame:
    """Long form of the buckets, with the unbounded one last."""
    keys = [c for c in ("window_start", "endpoint", "status") if c in metrics.columns]
    both = F.concat("buckets", F.array(F.struct(F.lit(float("inf")).alias("le"), F.col("requests").alias("n"))))
    return metrics.select(*keys, F.inline(both))

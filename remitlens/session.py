"""Session helpers: the shared staging folder and size-checked small tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}
_scope = threading.local()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "remitlens") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without the setting; it then gets a scratch
    folder of its own. A cluster without it is an error, since a machine-local
    folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/remitlens-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="remitlens-")
    return _local_roots[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    Cuts the lineage at a committed table: later passes scan columns instead of
    repeating the joins behind ``df``, and survive lost executors. Zstandard makes the
    files about a third smaller than the default codec.
    """
    spark = df.sparkSession
    path = f"{getattr(_scope, 'path', None) or staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go to a folder of their own, which is removed at the end.

    For jobs whose result has left by then, such as a micro-batch that was written out.
    """
    outer = getattr(_scope, "path", None)
    _scope.path = f"{staging_root(spark)}/scope-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scope.path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        _scope.path = outer


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most ``limit`` rows; more is an error, not a truncation."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, refusing to collect")
    return rows


def shuffle_width(spark: SparkSession, cap: int = 20_000) -> int:
    return max(1, min(cap, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a scan of very few file splits before CPU-heavy work.

    Only for plain scans (their partition count is known without running
    anything). A table of many files already has more splits than cores and
    passes through unchanged, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Groups of more than 1/HOT_SHARE of all members count as hot: at most HOT_SHARE of them can exist.
HOT_SHARE = 1000


def attach(members: DataFrame, groups: DataFrame, key: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join ``members`` to the one row of ``groups`` for their ``key`` (never null).

    ``size`` is the column of ``groups`` with the number of members of the key. Groups above
    1/1000 of all members number at most 1000, so those rows are broadcast, and a key held by a third of all rows
    never meets one task; the rest is a shuffled join of small groups.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot, cold = groups.where(F.col(size) * HOT_SHARE > total), groups.where(F.col(size) * HOT_SHARE <= total)
    columns = [c for c in groups.columns if c not in key]
    if not hot.take(1):
        return members.join(cold, key, how)
    flagged = members.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    done = flagged.where(F.col("_hot")).drop("_hot")
    rest = flagged.where(F.col("_hot").isNull()).drop("_hot", *columns)
    return done.select(*members.columns, *columns).unionByName(rest.join(cold, key, how).select(*members.columns, *columns))

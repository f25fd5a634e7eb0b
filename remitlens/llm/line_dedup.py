"""Line deduplication against levelled runs of line hashes.

Documents arrive in batches of ascending id. What earlier batches held is kept as
runs: sorted tables of distinct 128-bit line hashes. A batch takes its own first
holders, anti-joins them with every run by merge, and writes the hashes that are
new as a run of level 0. When a level has ``fanout`` runs they are merged to one run of
the next level, so a hash is rewritten once per level and a batch meets at most
fanout - 1 runs a level. Everything is DataFrame work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm.common import WHITE, lower_ascii, stage, staging_root, text_of

MIN_KEY = 10


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


class LineRuns:
    """Levelled runs of line hashes in the session's shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.folder = f"{staging_root(spark)}/line-runs-{uuid.uuid4().hex}"

    def _write(self, hashes: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.folder}/level{level}-{uuid.uuid4().hex}"
        hashes.sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.spark.read.parquet(*self.levels[level]), []
            self._write(merged.repartition("h1", "h2"), level + 1)

    def read(self) -> DataFrame | None:
        """All hashes of all runs (each hash is in one run only)."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, first: DataFrame) -> DataFrame:
        """Take a batch's distinct hashes (h1, h2, ...); returns those that no run held, and adds them."""
        known = self.read()
        new = first if known is None else first.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        new = stage(new, "line-new")
        self._write(new.select("h1", "h2"), 0)
        return new


def _edges(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ids that cut the table into batches of about equal row counts."""
    if batches < 2:
        return []
    cuts = docs.select(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], F.lit(10_000))).first()[0] or []
    return sorted(set(cuts))


LAST = (1 << 63) - 1


def deduplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, batches: int = 6, fanout: int = 3
) -> DataFrame:
    """Every row of ``docs`` without the lines that a document of smaller id holds too.

    Adds kept_text, n_lines and n_dropped to the columns of ``docs`` (a column of
    those names is replaced). Lines end at \\n; a null or empty text is one empty
    line. Lines whose key has fewer than ``min_key`` code points always stay, and a
    line that repeats inside its first document stays there each time. Rows with one
    id are one document. A null id counts as the largest. An empty table gives no
    rows. ``batches`` and ``fanout`` shape the work, never the result.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    body = F.xxhash64(text_of(text_col))
    edges = _edges(docs, id_col, batches)
    batch = sum((F.when(order > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    lines = docs.select(batch.alias("batch"), order.alias("at"), body.alias("body"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_key)
    keyed = keyed.select("batch", "at", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    folder = f"{staging_root(spark)}/lines-{uuid.uuid4().hex}"
    keyed.write.partitionBy("batch").parquet(f"{folder}/keyed")
    keyed = spark.read.schema(keyed.schema).parquet(f"{folder}/keyed")
    runs = LineRuns(spark, fanout)
    gone = None
    for number in range(len(edges) + 1):
        part = keyed.filter(F.col("batch") == number)
        first = runs.add(part.groupBy("h1", "h2").agg(F.min("at").alias("at")))
        # Joined on hash and id: a line held by very many documents spreads over their ids.
        lost = stage(part.join(first, ["h1", "h2", "at"], "left_anti").select("at", "body", "pos"), "lines-lost")
        gone = lost if gone is None else gone.unionByName(lost)
    cuts = gone.groupBy("at", "body").agg(F.sort_array(F.collect_set("pos")).alias("cuts"))
    cuts = cuts.toDF("_at", "_body", "_cuts")
    rows = docs.drop("kept_text", "n_lines", "n_dropped").withColumns({"_at": order, "_body": body})
    return _without(rows.join(cuts, ["_at", "_body"], "left"), text_col).drop("_at", "_body", "_cuts")


def _without(rows: DataFrame, text_col: str) -> DataFrame:
    """kept_text, n_lines and n_dropped from the sorted positions in ``cuts``.

    The lines between two cuts are taken as one slice, so the work is linear in the
    number of lines.
    """
    lines = F.split(text_of(text_col), "\n", -1)
    bounds = F.concat(F.array(F.lit(-1)), F.col("_cuts"), F.array(F.size("_lines")))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("_cuts")),
            lambda i: F.slice("_lines", F.get("_bounds", i) + 2, F.get("_bounds", i + 1) - F.get("_bounds", i) - 1),
        )
    )
    rows = rows.withColumn("_lines", lines).withColumn("_bounds", F.when(F.col("_cuts").isNotNull(), bounds))
    return rows.withColumns(
        {
            "kept_text": F.when(F.col("_cuts").isNull(), text_of(text_col)).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")).cast("long"),
        }
    ).drop("_lines", "_bounds")

"""Global ranks, running totals and exact quantiles without a one-task window.

Rows are cut into value ranges of about equal size, each range is ordered on its
own, and the ranges' totals supply the offsets. Equal values always
fall into the same range, so results do not depend on physical partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions.hashing import KEY_SPAN, hash_key
from remitlens.session import shuffle_width, small_rows, stage

#: Equal pieces of one quantile range at most.
MAX_SLOTS = 500
MAX_QUANTILES = 1000
ROWS_PER_RANGE = 1_000_000


def value_bounds(df: DataFrame, value: str, parts: int) -> list[float]:
    """Edges of about ``parts`` equally filled ranges of a double column, its extremes included."""
    if parts <= 1:
        return []
    probs = [i / parts for i in range(parts + 1)]
    return sorted(set(df.approxQuantile(value, probs, 1.0 / (4 * parts))))


def with_range(df: DataFrame, value: str, bounds: Sequence[float], slots: int = 1, out: str = "_range") -> DataFrame:
    """Add the number of a value's range: ordered like the values, equal for equal values.

    ``slots`` cuts every range into that many equal pieces, for tables that need
    far more ranges than quantiles can be had cheaply.
    """
    if not bounds:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)
    number = F.col(out).cast("int")
    if slots > 1:
        edges = F.array(*[F.lit(b) for b in bounds])
        low, high = F.get(edges, number - 1), F.get(edges, number)
        piece = F.least(F.floor((F.col(value) - low) / (high - low) * slots), F.lit(slots - 1)).cast("int")
        number = number * slots + F.coalesce(piece, F.lit(0))
    return ranged.withColumn(out, number)


def range_plan(rows: int, per_range: int, at_least: int = 1) -> tuple[int, int]:
    """(quantile ranges, slots per range) that put about ``per_range`` rows into a range."""
    wanted = max(at_least, -(-rows // per_range))
    parts = min(wanted, MAX_QUANTILES)
    return parts, min(-(-wanted // parts), MAX_SLOTS)


def _offsets(ranged: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Total of each ``sums`` column over all earlier ranges, per group.

    One row per group and range, ordered inside its group: a group has at most as
    many ranges as the plan gave, however many groups there are.
    """
    totals = ranged.groupBy(*group, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_range", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_off_{s}") for s in sums])


def _add_offsets(ranged: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = [*group, "_range"]
    other = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return ranged.join(other, cond).drop(*[f"_k_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    group: Sequence[str] = (),
    parts: int | None = None,
    staged: bool = False,
) -> DataFrame:
    """Add ``before_<s>``: the total of ``s`` over rows of the group with a smaller value.

    ``df`` holds one row per (group, value); reduce ties with a ``groupBy`` first.
    ``value`` is a non-null double.
    """
    df = df if staged else stage(df, "running")
    # Counting a staged table reads file footers only.
    parts, slots = range_plan(df.count(), ROWS_PER_RANGE, parts or shuffle_width(df.sparkSession))
    ranged = with_range(df, value, value_bounds(df, value, parts), slots)
    offsets = _offsets(ranged, group, sums)
    w = (
        Window.partitionBy(*group, "_range")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.select("*", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_in_{s}") for s in sums])
    return _add_offsets(local, offsets, group).select(
        *df.columns, *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"before_{s}") for s in sums]
    )


def rank_by_hash(
    df: DataFrame,
    id_col: str,
    tag,
    group: Sequence[str] = (),
    parts: int | None = None,
    out: str = "rank",
) -> DataFrame:
    """1-based rank of each row in a reproducible random order, within its group.

    Digest keys are uniform, so equal-width ranges are already balanced, however
    large one group is.
    """
    parts = parts or shuffle_width(df.sparkSession)
    keyed = df.withColumn("_key", hash_key(id_col, tag))
    ranged = keyed.withColumn("_range", F.floor(F.col("_key") / F.lit(KEY_SPAN / parts)).cast("int"))
    counted = ranged.select(*group, "_range").withColumn("n", F.lit(1))
    offsets = _offsets(counted, group, ["n"])
    w = Window.partitionBy(*group, "_range").orderBy("_key", id_col)
    local = ranged.withColumn("_local", F.row_number().over(w))
    return _add_offsets(local, offsets, group).select(
        *df.columns, (F.col("_local") + F.col("_off_n")).cast("long").alias(out)
    )


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """One row per distinct value with its tie-averaged rank."""
    counts = df.groupBy(F.col(value).cast("double").alias(value)).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, value, ["n"])
    return ranked.select(value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(out))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], accuracy: float = 1e-3) -> list[float]:
    """Exact linear-interpolation quantiles of a column.

    Approximate quantiles bracket every wanted order statistic; only the values
    inside the brackets are counted and ordered.
    """
    x = F.col(value).cast("double")
    data = df.select(x.alias("x")).where(F.col("x").isNotNull())
    wanted = []
    for p in probs:
        wanted += [max(0.0, p - 2 * accuracy), min(1.0, p + 2 * accuracy)]
    edges = data.approxQuantile("x", wanted, accuracy)
    if not edges:
        return []
    spans: list[list[float]] = []
    for low, high in sorted(
        (float("-inf") if p <= 2 * accuracy else edges[2 * i], float("inf") if p >= 1 - 2 * accuracy else edges[2 * i + 1])
        for i, p in enumerate(probs)
    ):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    n, *below = data.agg(
        F.count("*"), *[F.sum((F.col("x") < F.lit(low)).cast("long")) for low, _ in spans]
    ).first()
    span = F.lit(None).cast("int")
    for i, (low, high) in enumerate(spans):
        span = F.when((F.col("x") >= F.lit(low)) & (F.col("x") <= F.lit(high)), i).otherwise(span)
    counts = (
        data.withColumn("span", span).where(F.col("span").isNotNull()).groupBy("span", "x").agg(F.count("*").alias("n"))
    )
    ranked = running_totals(counts, "x", ["n"], group=["span"])
    base = F.element_at(F.array(*[F.lit(int(b)) for b in below]), F.col("span") + 1)
    placed = ranked.select("x", (base + F.col("before_n")).alias("first"), (base + F.col("before_n") + F.col("n")).alias("end"))
    ranks = set()
    for p in probs:
        h = (n - 1) * p
        ranks |= {int(h), min(int(h) + 1, n - 1)}
    hit = None
    for r in sorted(ranks):
        c = (F.col("first") <= r) & (F.col("end") > r)
        hit = c if hit is None else hit | c
    found = small_rows(placed.where(hit), 2 * len(probs) + 2, "order statistics")

    def at(r: int) -> float:
        return next(row["x"] for row in found if row["first"] <= r < row["end"])

    out = []
    for p in probs:
        h = (n - 1) * p
        low, high = at(int(h)), at(min(int(h) + 1, n - 1))
        out.append(low + (high - low) * (h - int(h)))
    return out


def range_index(value: Column, edges: Sequence[float], closed_right: bool = False) -> Column:
    """How many sorted inner edges lie at or below the value (strictly below if ``closed_right``)."""
    out = F.lit(0)
    for e in edges:
        out = out + (value > F.lit(e) if closed_right else value >= F.lit(e)).cast("int")
    return out

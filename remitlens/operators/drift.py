"""Population drift between two claim populations: PSI and Kolmogorov-Smirnov."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions.scalar import drift_flag
from remitlens.operators.ranking import exact_quantiles, range_index, running_totals
from remitlens.operators.placements import path_p_value
from remitlens.session import stage

FLOOR = 1e-6
NUMERIC_BINS = 10


def _psi(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """PSI from (by.., n_ref, n_cmp) rows, one per bin or value; shares floored, not renormalised."""
    totals = counts.groupBy(*by).agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cmp").alias("t_cmp"))
    e = F.greatest(F.col("n_ref") / F.col("t_ref"), F.lit(FLOOR))
    a = F.greatest(F.col("n_cmp") / F.col("t_cmp"), F.lit(FLOOR))
    return counts.join(totals, list(by)).groupBy(*by).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def _sides(ref: DataFrame, cmp: DataFrame, cols: dict) -> DataFrame:
    return ref.select(*[e.alias(n) for n, e in cols.items()], F.lit(0).alias("_side")).unionByName(
        cmp.select(*[e.alias(n) for n, e in cols.items()], F.lit(1).alias("_side"))
    )


def _side_counts():
    return (
        F.sum((F.col("_side") == 0).cast("long")).alias("n_ref"),
        F.sum((F.col("_side") == 1).cast("long")).alias("n_cmp"),
    )


def psi_numeric(ref: DataFrame, cmp: DataFrame, column: str, bins: int = NUMERIC_BINS) -> DataFrame:
    """PSI over quantile bins of the reference population, outer bins open."""
    edges = exact_quantiles(ref, column, [i / bins for i in range(1, bins)])
    both = _sides(ref, cmp, {"x": F.col(column).cast("double")})
    counts = both.groupBy(range_index(F.col("x"), edges).alias("bin")).agg(*_side_counts())
    # At most ``bins`` rows by now: small enough for one array.
    folded = counts.agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cmp").alias("t_cmp"), F.collect_list(F.struct("n_ref", "n_cmp")).alias("h"))

    def term(s):
        e = F.greatest(s["n_ref"] / F.col("t_ref"), F.lit(FLOOR))
        a = F.greatest(s["n_cmp"] / F.col("t_cmp"), F.lit(FLOOR))
        return (a - e) * F.log(a / e)

    return folded.select(F.lit(column).alias("feature"), F.aggregate("h", F.lit(0.0), lambda acc, s: acc + term(s)).alias("psi"))


def psi_categorical(ref: DataFrame, cmp: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PSI per categorical column over the union of values, all columns in one pass.

    Grouping both sides together is the full outer join of their value counts.
    """
    both = _sides(ref, cmp, {c: F.col(c).cast("string") for c in columns})
    long = both.select(
        "_side", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]))
    )
    return _psi(long.groupBy("feature", "value").agg(*_side_counts()), ["feature"])


#: Samples up to this size have exact p-values.
EXACT_ROWS = 10_000


def ks_two_sample(ref: DataFrame, cmp: DataFrame, column: str, method: str = "auto") -> DataFrame:
    """Largest gap of the two empirical CDFs and its p-value.

    ``method``: "exact" counts lattice paths, "asymp" sums the limit's series, "auto" is exact
    if neither sample has more than EXACT_ROWS values. An empty sample gives a null statistic.
    """
    both = _sides(ref, cmp, {"x": F.col(column).cast("double")})
    counts = both.where(F.col("x").isNotNull()).groupBy("x").agg(*_side_counts())
    ranked = running_totals(counts, "x", ["n_ref", "n_cmp"])
    ends = ranked.select("n_ref", "n_cmp", (F.col("before_n_ref") + F.col("n_ref")).alias("c_ref"), (F.col("before_n_cmp") + F.col("n_cmp")).alias("c_cmp"))
    n, m = ends.agg(F.sum("n_ref"), F.sum("n_cmp")).first()
    n, m = n or 0, m or 0
    if not n or not m:
        return ends.agg(F.max(F.lit(None).cast("double")).alias("ks_stat")).select(F.lit(column).alias("feature"), "ks_stat", F.col("ks_stat").alias("ks_pvalue"))
    d = F.max(F.abs(F.col("c_ref") / F.lit(n) - F.col("c_cmp") / F.lit(m)))
    if method == "exact" or method == "auto" and max(n, m) <= EXACT_ROWS:
        gap = F.max(F.abs(F.col("c_ref") * F.lit(m) - F.col("c_cmp") * F.lit(n)))
        row = ends.agg(d.alias("d"), gap.alias("gap")).first()
        return ref.sparkSession.createDataFrame([(column, row["d"], path_p_value(n, m, int(row["gap"])))], "feature string, ks_stat double, ks_pvalue double")
    lam = F.col("ks_stat") * F.lit(math.sqrt(n * m / (n + m)))
    series = F.lit(2.0) * F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam)
    )
    return ends.agg(d.alias("ks_stat")).select(
        F.lit(column).alias("feature"),
        "ks_stat",
        F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))).alias("ks_pvalue"),
    )


def population_shift_report(
    ref: DataFrame,
    cmp: DataFrame,
    numeric: Sequence[str] = ("billed_amount", "filing_days"),
    categorical: Sequence[str] = ("insurance_type", "cpt_code", "dx_category"),
    label: str | None = "denied",
    ks_method: str = "auto",
) -> DataFrame:
    """Drift row per feature, and a prevalence row when both sides are labelled.

    The needed columns of both sides are staged once; every metric scans only its own.
    """
    labelled = bool(label) and label in ref.columns and label in cmp.columns
    needed = [*numeric, *categorical, *([label] if labelled else [])]
    ref, cmp = stage(ref.select(*needed), "reference"), stage(cmp.select(*needed), "compared")
    nothing = F.lit(None).cast("double")
    numeric_rows = None
    for c in numeric:
        row = psi_numeric(ref, cmp, c).unionByName(ks_two_sample(ref, cmp, c, ks_method), allowMissingColumns=True)
        numeric_rows = row if numeric_rows is None else numeric_rows.unionByName(row)
    numeric_rows = numeric_rows.groupBy("feature").agg(*[F.max(c).alias(c) for c in ("psi", "ks_stat", "ks_pvalue")])
    report = numeric_rows.select("feature", F.lit("numeric").alias("type"), "psi", "ks_stat", "ks_pvalue").unionByName(
        psi_categorical(ref, cmp, categorical).select(
            "feature", F.lit("categorical").alias("type"), "psi", nothing.alias("ks_stat"), nothing.alias("ks_pvalue")
        )
    )
    report = report.withColumn("drift", drift_flag("psi"))
    if labelled:
        rates = _sides(ref, cmp, {"y": F.col(label).cast("double")}).agg(
            F.avg(F.when(F.col("_side") == 0, F.col("y"))).alias("a"), F.avg(F.when(F.col("_side") == 1, F.col("y"))).alias("b")
        )
        report = report.unionByName(
            rates.select(
                F.lit("denial_prevalence").alias("feature"), F.lit("label").alias("type"), nothing.alias("psi"),
                nothing.alias("ks_stat"), nothing.alias("ks_pvalue"), F.format_string("%.3f -> %.3f", "a", "b").alias("drift"),
            )
        )
    return report

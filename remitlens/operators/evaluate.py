"""Ranking, threshold, calibration and cost metrics, exact at any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.constants import COST_FN, COST_FP
from remitlens.functions.hashing import PRIME, residue_key
from remitlens.functions.scalar import predict_at
from remitlens.operators.ranking import average_ranks, exact_quantiles, range_index, range_plan, running_totals, with_range
from remitlens.operators.sampling import POISSON_CDF, replicate_multipliers
from remitlens.session import shuffle_width, small_rows, stage

METRICS = ["auroc", "f1", "precision", "recall", "n_samples"]


def auroc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank-statistic AUROC with ties averaged, one row per group; null if a class is missing."""
    counts = (
        df.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).alias("_y"))
        .groupBy(*by, "_s")
        .agg(
            F.sum((F.col("_y") == 1).cast("long")).alias("pos"),
            F.sum((F.col("_y") == 0).cast("long")).alias("neg"),
        )
    )
    ranked = running_totals(counts, "_s", ["neg"], group=by)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(num / den)


def confusion(df: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    y, p = F.col(label), predict_at(score, threshold)

    def total(a: int, b: int) -> Column:
        return F.sum(((y == a) & (p == b)).cast("long"))

    return df.groupBy(*by).agg(
        total(1, 1).alias("tp"), total(0, 1).alias("fp"), total(1, 0).alias("fn"), total(0, 0).alias("tn"),
        F.count("*").alias("n_samples"),
    )


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to confusion counts; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def evaluate(df: DataFrame, label: str, score: str, by: Sequence[str] = ("phase", "model"), threshold: float = 0.5) -> DataFrame:
    """One metric record per group: AUROC, F1, precision, recall, n. Many models in one job."""
    narrow = stage(df.select(*by, label, score), "scores")
    at = threshold_metrics(confusion(narrow, label, score, by, threshold)).select(*by, "f1", "precision", "recall", "n_samples")
    area = auroc(narrow, label, score, by)
    if not by:
        return area.withColumn("_one", F.lit(1)).join(at.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return area.join(at, list(by)).select(*by, *METRICS)


def brier(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate per quantile bin; empty bins are absent."""
    edges = exact_quantiles(df, score, [i / bins for i in range(1, bins)])
    return (
        df.groupBy(range_index(F.col(score), edges, closed_right=True).alias("bin"))
        .agg(F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed"), F.count("*").alias("n"))
    )


def _percent_floor(score: Column) -> Column:
    """How many of the thresholds 0.01 .. 1.00 the score reaches, exact at the edges."""
    c = F.floor(score * 100).cast("int")
    return F.when(score >= (c + 1) / F.lit(100.0), c + 1).when(score < c / F.lit(100.0), c - 1).otherwise(c)


def cost_curve(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), cost_fn: float = COST_FN, cost_fp: float = COST_FP
) -> DataFrame:
    """Cost at every threshold 0.02 .. 0.98 from one histogram of the scores.

    Scores outside [0, 1] reach all or none of the thresholds: the histogram has 101 slots at most.
    """
    reached = _percent_floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double"))))
    slots = df.groupBy(*by, reached.alias("slot")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )
    folded = slots.groupBy(*by).agg(
        F.collect_list(F.struct("slot", "pos", "neg")).alias("h"),
        F.sum("pos").alias("n_pos"),
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
    )
    grid = folded.select("*", F.explode(F.sequence(F.lit(2), F.lit(98))).alias("pct"))

    def total(field: str, reached: bool) -> Column:
        kept = F.filter("h", lambda s: (s["slot"] >= F.col("pct")) if reached else (s["slot"] < F.col("pct")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, s: acc + s[field])

    counted = grid.select(
        *by, "pct", "n", "n_pos", total("pos", False).alias("fn"), total("neg", True).alias("fp"), total("pos", True).alias("tp")
    )
    return counted.select(
        *by,
        "pct",
        (F.col("pct") / F.lit(100.0)).alias("threshold"),
        "fn",
        "fp",
        "tp",
        (F.col("fn") * cost_fn + F.col("fp") * cost_fp).alias("expected_cost"),
        ((F.col("fn") * cost_fn + F.col("fp") * cost_fp) / F.col("n")).alias("cost_per_claim"),
        (F.col("n_pos") * cost_fn).alias("do_nothing_cost"),
    )


def cost_optimal_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = (), **costs) -> DataFrame:
    """Cheapest threshold per group; the lowest one on ties."""
    curve = cost_curve(df, label, score, by, **costs)
    best = curve.groupBy(*by).agg(F.min_by(F.struct(*[c for c in curve.columns if c not in by]), F.struct("expected_cost", "pct")).alias("b"))
    return best.select(*by, "b.*").withColumn("savings_vs_do_nothing", F.col("do_nothing_cost") - F.col("expected_cost")).drop("pct")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks."""
    pairs = stage(df.select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)), "pairs")
    ranked = pairs.join(average_ranks(pairs, a, "_ra"), a).join(average_ranks(pairs, b, "_rb"), b)
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def score_histogram(df: DataFrame, score: str, group: str, bins: int = 25) -> DataFrame:
    """Counts over equal bins of [0, 1] by group (last bin closed) with the group mean."""
    s = F.col(score)
    slot = F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int")
    counts = df.where((s >= 0) & (s <= 1)).groupBy(group, slot.alias("bin")).agg(F.count("*").alias("n"))
    means = df.groupBy(group).agg(F.avg(score).alias("group_mean"))
    return counts.join(means, group).select(group, "bin", "n", "group_mean")


def fold_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of fold metrics."""
    return df.groupBy(*by).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics]
    )


def health_flags(metrics: DataFrame) -> DataFrame:
    """Verdict on one-row metrics: text_lift, fused, ceiling, blank_lift, lift_ci_low."""
    flags = F.array_compact(
        F.array(
            F.when(F.col("text_lift") <= 0.005, "SIREN: no text lift — note signal not landing"),
            F.when(F.col("fused") > F.col("ceiling") + 0.01, "SIREN: fused above oracle ceiling — leak"),
            F.when(F.abs("blank_lift") > 0.01, "SIREN: empty-note lift non-zero — signal leaking via structured cols"),
            F.when(F.col("lift_ci_low") <= 0, "WARN: lift 95% CI includes 0 — not statistically clear"),
        )
    )
    healthy = "healthy — text lift bounded, statistically clear, guardrail clean"
    return metrics.withColumn("flags", flags).withColumn(
        "verdict", F.when(F.size("flags") == 0, healthy).otherwise(F.array_join("flags", "  "))
    )


def status_confusion(df: DataFrame, gold: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Gold x predicted counts, one row per gold class that occurs."""
    return df.groupBy(gold).pivot(predicted, list(classes)).agg(F.count(F.lit(1))).na.fill(0)


# --- paired bootstrap -----------------------------------------------------------


def _thresholds() -> np.ndarray:
    """The least residues whose share of PRIME reaches each edge of the Poisson distribution."""
    found = []
    for edge in POISSON_CDF:
        t = int(edge * PRIME) - 2
        while t / float(PRIME) < edge:
            t += 1
        found.append(t)
    return np.array(found, np.int64)


_EDGES = _thresholds()
#: Weight by the upper 16 of a residue's 31 bits; 255 where an edge lies among the lower ones.
_FIRST = np.searchsorted(_EDGES, np.arange(1 << 16, dtype=np.int64) << 15, side="right").astype(np.uint8)
_BY_HEAD = np.where(_FIRST == np.searchsorted(_EDGES, (np.arange(1 << 16, dtype=np.int64) << 15) + 32767, side="right"), _FIRST, 255).astype(np.uint8)


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME (2 ** 31 - 1) for 0 <= x < 2 ** 62, in place: the upper bits count as much as the lower ones."""
    for _ in range(2):
        high = x >> 31
        x &= PRIME
        x += high
    x[x == PRIME] = 0
    return x


def _drawn(keys: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (bytes), replicates x rows; the same hash as ``sampling.poisson_weight``."""
    pairs = np.array([replicate_multipliers(b, seed) for b in range(first, last)], dtype=np.int64)
    h = _residue(keys[None, :] * pairs[:, :1] + pairs[:, 1:])
    h2 = _residue(h * h)
    h2 *= h2
    h5 = _residue(h2)
    h5 *= h
    h5 = _residue(h5)
    weights = _BY_HEAD.take(h5 >> 15)
    unsure = np.flatnonzero(weights.ravel() == 255)
    weights.ravel()[unsure] = np.searchsorted(_EDGES, h5.ravel()[unsure], side="right")
    return weights


def _replicate_weights(keys: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """The drawn weights, rows x replicates."""
    return _drawn(keys, first, last, seed).T.astype(np.int64)


def _partial_areas(df: DataFrame, score: str, replicates: int, seed: int, group_rows: int, cells: int = 1 << 17) -> DataFrame:
    """Weighted AUROC of every replicate, exact: (replicate, auroc).

    Rows are cut into score ranges; a task orders one range and emits, per
    replicate, its class weights and the wins inside the range. A range that
    holds a single repeated score has no inner order, so it is salted.
    """
    parts, slots = range_plan(df.count(), group_rows)
    raw = df.approxQuantile(score, [i / parts for i in range(parts + 1)], 1.0 / (4 * parts)) if parts > 1 else []
    hot = {v for v in raw if raw.count(v) > 1}
    # A repeated quantile is a hot score: close a range right above it.
    bounds = sorted(set(raw) | {float(np.nextafter(v, np.inf)) for v in hot})
    ranged = with_range(df.select("_k", "_y", F.col(score).alias("_s")), "_s", bounds, slots)
    salts = F.when(F.col("_s").isin(sorted(hot)), F.pmod(F.col("_k"), F.lit(parts * slots))).otherwise(F.lit(0)) if hot else F.lit(0)
    keyed = ranged.withColumn("_salt", salts.cast("long"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s", kind="stable")
        keys, y, s = pdf["_k"].to_numpy(), pdf["_y"].to_numpy() == 1, pdf["_s"].to_numpy()
        order = np.cumsum(np.r_[False, s[1:] != s[:-1]])
        above, below = keys[y], keys[~y]
        # Zeros that a one's score exceeds, and those it reaches: the wins are the mean of both weights.
        lower, upper = (np.searchsorted(order[~y], order[y], side=side) for side in ("left", "right"))
        out = []
        chunk = max(1, cells // len(pdf))  # bounds the weight matrix whatever the range holds
        for a in range(0, replicates, chunk):
            b = min(a + chunk, replicates)
            pos = _drawn(above, a, b, seed)
            sums = np.zeros((b - a, len(below) + 1), np.int64)
            np.cumsum(_drawn(below, a, b, seed), axis=1, out=sums[:, 1:])
            wins = ((sums.take(lower, axis=1) + sums.take(upper, axis=1)) * pos).sum(axis=1) / 2.0
            out.append(
                pd.DataFrame(
                    {
                        "_range": int(pdf["_range"].iloc[0]), "replicate": np.arange(a, b, dtype=np.int32),
                        "pos": pos.sum(axis=1, dtype=np.int64), "neg": sums[:, -1], "wins": wins, "tied": order[-1] == 0,
                    }
                )
            )
        return pd.concat(out)

    # A range is few bytes but much work: a fixed number of partitions is not merged by size.
    dealt = keyed.repartition(max(shuffle_width(df.sparkSession), 2 * parts), "_range", "_salt")
    partial = dealt.groupBy("_range", "_salt").applyInPandas(
        fold, "_range int, replicate int, pos long, neg long, wins double, tied boolean"
    )
    ranges = partial.groupBy("replicate", "_range").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins"),
        (F.count("*") > 1).alias("salted"),
    )
    # Salted pieces share one score: every pair of the range is a tie.
    wins = F.when(F.col("salted"), F.col("pos") * F.col("neg") / 2.0).otherwise(F.col("wins"))
    w = Window.partitionBy("replicate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select("replicate", "pos", "neg", wins.alias("wins"), F.coalesce(F.sum("neg").over(w), F.lit(0)).alias("before"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return placed.groupBy("replicate").agg(
        F.when(pairs > 0, F.sum(F.col("wins") + F.col("pos") * F.col("before")) / pairs).alias("auroc")
    )


def bootstrap_replicates(
    df: DataFrame, id_col: str, label: str, base: str, better: str, replicates: int = 2000, seed: int = 0, group_rows: int = 50_000
) -> DataFrame:
    """AUROC of both scores under the same resample, per replicate; one-class resamples are dropped."""
    rows = stage(
        df.select(
            residue_key(id_col, "boot").alias("_k"), F.col(label).cast("int").alias("_y"),
            F.col(base).cast("double").alias("_base"), F.col(better).cast("double").alias("_better"),
        ),
        "bootstrap",
    )
    a = _partial_areas(rows, "_base", replicates, seed, group_rows).withColumnRenamed("auroc", "auroc_base")
    b = _partial_areas(rows, "_better", replicates, seed, group_rows).withColumnRenamed("auroc", "auroc_better")
    return (
        a.join(b, "replicate")
        .where(F.col("auroc_base").isNotNull())
        .withColumn("lift", F.col("auroc_better") - F.col("auroc_base"))
    )


def bootstrap_auroc_lift(
    df: DataFrame, id_col: str, label: str, base: str, better: str,
    replicates: int = 2000, seed: int = 0, ci: float = 0.95, group_rows: int = 50_000,
) -> DataFrame:
    """Paired bootstrap of an AUROC lift: points, intervals and a one-sided p-value.

    Resampling with replacement is replaced by independent Poisson(1) row weights,
    its usual distributed form.
    """
    reps = bootstrap_replicates(df, id_col, label, base, better, replicates, seed, group_rows)
    ends = F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2))
    # ``percentile`` here sees one value per replicate, never one per row.
    folded = reps.agg(
        *[F.percentile(c, ends).alias(f"{c}_ci") for c in ("auroc_base", "auroc_better", "lift")],
        F.avg("lift").alias("lift_mean"),
        F.avg((F.col("lift") <= 0).cast("double")).alias("p_value_one_sided"),
        F.count("*").alias("n_boot"),
    )
    both = df.select(
        label,
        F.inline(F.array(*[F.struct(F.lit(n).alias("which"), F.col(c).cast("double").alias("score")) for n, c in (("a", base), ("b", better))])),
    )
    points = {r["which"]: r["auroc"] for r in small_rows(auroc(both, label, "score", ["which"]), 2, "scores")}
    return folded.select(
        F.lit(points["a"]).alias("auroc_base"),
        F.lit(points["b"]).alias("auroc_better"),
        (F.lit(points["b"]) - F.lit(points["a"])).alias("lift_point"),
        "lift_mean",
        *[F.col(f"{c}_ci")[i].alias(f"{c}_{e}") for c in ("auroc_base", "auroc_better", "lift") for i, e in enumerate(("low", "high"))],
        "p_value_one_sided",
        "n_boot",
    )

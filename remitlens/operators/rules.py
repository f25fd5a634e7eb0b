"""Rule-based denial risk: drivers, calibration, labels, reasons and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.constants import (
    ANOMALY_RATIO,
    DRIVER_WEIGHTS,
    DRIVERS,
    PAYER_RESIDUAL,
    REASON_TEXT,
)
from remitlens.functions.hashing import hash_uniform
from remitlens.functions.scalar import lookup, sigmoid

CONTRIB = [f"c_{d}" for d in DRIVERS]


def driver_flags() -> dict[str, Column]:
    """Whether each driver trips; the last one also has a size (see ``driver_contributions``)."""
    return {
        "untimely_filing": F.col("_filing_days") > F.col("_filing_window"),
        "missing_prior_auth": F.col("_prior_auth_required") & ~F.col("_prior_auth_obtained"),
        "medical_necessity": ~F.col("_necessity_ok"),
        "undocumented_necessity": ~F.col("_necessity_documented"),
        "out_of_network": ~F.col("_in_network"),
        "billing_anomaly": F.col("_amount_ratio") > F.lit(ANOMALY_RATIO),
    }


def driver_contributions(claims: DataFrame) -> DataFrame:
    """Add one log-odds column ``c_<driver>`` per denial driver."""
    size = {"billing_anomaly": F.greatest(F.col("_amount_ratio") - F.lit(ANOMALY_RATIO), F.lit(0.0))}
    return claims.select(
        "*",
        *[
            (F.lit(DRIVER_WEIGHTS[d]) * size.get(d, flag.cast("double"))).alias(f"c_{d}")
            for d, flag in driver_flags().items()
        ],
    )


def base_risk(contributions: DataFrame) -> DataFrame:
    """Add ``base_logodds``: drivers + payer residual + provider residual."""
    total = F.col(CONTRIB[0])
    for c in CONTRIB[1:]:
        total = total + F.col(c)
    return contributions.withColumn(
        "base_logodds",
        total + lookup("insurance_type", PAYER_RESIDUAL) + F.col("_provider_propensity"),
    )


def _subtree(low: float, high: float, depth: int) -> list[float]:
    if depth == 0:
        return []
    mid = (low + high) / 2
    return [mid, *_subtree(low, mid, depth - 1), *_subtree(mid, high, depth - 1)]


def calibrate_intercepts(
    scored: DataFrame,
    targets: Sequence[float],
    score: str = "base_logodds",
    tolerance: float = 1e-4,
    max_steps: int = 200,
    steps_per_pass: int | None = None,
) -> dict[float, float]:
    """Intercept per target rate, found by bisection on [-20, 20].

    One pass evaluates every midpoint the next ``steps_per_pass`` bisection steps
    could visit, for all targets together, so a calibration takes three or four
    column scans. ``scored`` is read once per pass: stage it when it is costly.
    """
    if steps_per_pass is None:
        steps_per_pass = max(2, (64 // len(targets)).bit_length() - 1 if len(targets) > 1 else 5)
    data = scored.select(score)
    state = {t: (-20.0, 20.0, 0) for t in targets}
    done: dict[float, float] = {}
    while len(done) < len(state):
        open_targets = [t for t in state if t not in done]
        mids = sorted({m for t in open_targets for m in _subtree(*state[t][:2], steps_per_pass)})
        means = data.agg(*[F.avg(sigmoid(F.col(score) + F.lit(m))).alias(f"m{i}") for i, m in enumerate(mids)]).first()
        if means[0] is None:
            raise ValueError("no rows to calibrate on")
        rate = dict(zip(mids, means))
        for t in open_targets:
            low, high, step = state[t]
            for _ in range(steps_per_pass):
                mid = (low + high) / 2
                if step >= max_steps or abs(rate[mid] - t) < tolerance:
                    done[t] = mid
                    break
                low, high = (mid, high) if rate[mid] < t else (low, mid)
                step += 1
            state[t] = (low, high, step)
    return done


def clean_label(prob, id_col: str = "claim_id", seed: int = 42) -> Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    return (hash_uniform(id_col, f"{seed}:label") < p).cast("int")


def noisy_label(label, noise: float, id_col: str = "claim_id", seed: int = 42) -> Column:
    """Flip a label with probability ``noise``, independently of how it was drawn."""
    y = F.col(label) if isinstance(label, str) else label
    if noise <= 0:
        return y
    return F.when(hash_uniform(id_col, f"{seed}:flip") < F.lit(noise), 1 - y).otherwise(y)


def dominant_driver() -> Column:
    """Driver with the largest contribution, earliest on ties; baseline if none is positive."""
    top = F.greatest(*[F.col(c) for c in CONTRIB])
    out = F.when(top <= 0, "baseline")
    for d in DRIVERS:
        out = out.when(F.col(f"c_{d}") == top, d)
    return out


def label_claims(
    scored: DataFrame,
    intercept: float,
    noise: float = 0.0,
    id_col: str = "claim_id",
    seed: int = 42,
) -> DataFrame:
    """Add ``true_denial_prob``, ``denied`` and ``reason_code`` to scored claims.

    The reason follows the final label: a flip to 0 loses it, a flip to 1 gains it.
    """
    return (
        scored.withColumn("true_denial_prob", sigmoid(F.col("base_logodds") + F.lit(intercept)))
        .withColumn("denied", noisy_label(clean_label("true_denial_prob", id_col, seed), noise, id_col, seed))
        .withColumn("reason_code", F.when(F.col("denied") == 1, lookup(dominant_driver(), REASON_TEXT)))
    )


def driver_trip_rates(labeled: DataFrame) -> DataFrame:
    """Long table: share of claims tripping each driver, plus the realized label rate."""
    names = [*DRIVERS, "realized_prevalence"]
    one = labeled.agg(
        *[F.avg((F.col(f"c_{d}") > 0).cast("double")).alias(d) for d in DRIVERS],
        F.avg(F.col("denied").cast("double")).alias("realized_prevalence"),
    )
    return one.unpivot([], names, "driver", "rate")


def reason_breakdown(labeled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labeled.where(F.col("denied") == 1).groupBy(*by, "reason_code").agg(F.count("*").alias("n_denied"))


def prevalence_sweep(scored: DataFrame, targets: Sequence[float], id_col: str = "claim_id", seed: int = 42) -> DataFrame:
    """Calibrate and label at every target in one pass; realized rate and its error."""
    intercepts = calibrate_intercepts(scored, targets)
    draws = scored.select(hash_uniform(id_col, f"{seed}:label").alias("u"), "base_logodds")
    one = draws.agg(
        *[
            F.avg((F.col("u") < sigmoid(F.col("base_logodds") + F.lit(b))).cast("double")).alias(f"r{i}")
            for i, b in enumerate(intercepts.values())
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("target_prevalence"), F.lit(b).alias("intercept"), F.col(f"r{i}").alias("realized_prevalence"))
            for i, (t, b) in enumerate(intercepts.items())
        ]
    )
    return one.select(F.inline(rows)).withColumn(
        "abs_error", F.abs(F.col("realized_prevalence") - F.col("target_prevalence"))
    )


def noise_levels_table(labeled: DataFrame, levels: Sequence[float], id_col: str = "claim_id", seed: int = 42) -> DataFrame:
    """Each claim once per noise level, with that level's label (``label_noise``, ``denied``).

    Both draws are made once per claim and shared by every level, so the label
    sets are nested.
    """
    base = labeled.select(
        id_col,
        "true_denial_prob",
        clean_label("true_denial_prob", id_col, seed).alias("y"),
        hash_uniform(id_col, f"{seed}:flip").alias("u"),
    )
    return base.withColumn("label_noise", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).select(
        id_col,
        "label_noise",
        "true_denial_prob",
        F.when(F.col("u") < F.col("label_noise"), 1 - F.col("y")).otherwise(F.col("y")).alias("denied"),
    )


def driver_risk_lift(scored: DataFrame, prob: str) -> DataFrame:
    """Mean predicted risk with each driver tripped and not tripped."""
    flags = driver_flags()
    one = scored.agg(
        *[F.avg(F.when(f, F.col(prob))).alias(f"{d}_on") for d, f in flags.items()],
        *[F.avg(F.when(~f, F.col(prob))).alias(f"{d}_off") for d, f in flags.items()],
    )
    rows = F.array(
        *[
            F.struct(F.lit(d).alias("driver"), F.col(f"{d}_on").alias("mean_tripped"), F.col(f"{d}_off").alias("mean_clear"))
            for d in flags
        ]
    )
    return one.select(F.inline(rows))

"""Rule scores, calibration, labels and audits (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitlens.catalog.claims import SEED, bisect_sql, claim_store, labeled_claims, scored_claims, sql_uniform, with_claims, with_labeled
from remitlens.catalog.registry import query, r6, s6
from remitlens.constants import DRIVERS, NOISE_LEVELS, PREVALENCE_TARGET, PREVALENCE_TARGETS
from remitlens.functions.scalar import sigmoid
from remitlens.operators import evaluate, rules
from remitlens.session import stage


@query("driver_contributions", "L1", with_claims("SELECT claim_id, " + ", ".join(s6(f"c_{d}", f"c_{d}") for d in DRIVERS) + " FROM drivers"))
def driver_contributions(spark, sf):
    return rules.driver_contributions(scored_claims(spark, sf).drop(*rules.CONTRIB)).select("claim_id", *[r6(c) for c in rules.CONTRIB])


@query("base_risk", "L2", with_claims(f"SELECT claim_id, {s6('base_logodds', 'base_logodds')} FROM scored"))
def base_risk(spark, sf):
    return rules.base_risk(scored_claims(spark, sf).drop("base_logodds")).select("claim_id", r6("base_logodds"))


@query("calibrated_intercept", "L3", with_labeled(
    f"SELECT {s6('b', 'intercept')}, {s6('(SELECT avg(1 / (1 + exp(-(base_logodds + b)))) FROM scored)', 'mean_prob')} FROM intercepts"))
def calibrated_intercept(spark, sf):
    scored = scored_claims(spark, sf)
    b = rules.calibrate_intercepts(scored, [PREVALENCE_TARGET])[PREVALENCE_TARGET]
    return scored.agg(r6(F.lit(b), "intercept"), r6(F.avg(sigmoid(F.col("base_logodds") + b)), "mean_prob"))


@query("clean_labels", "L4", with_labeled("SELECT claim_id, denied FROM labeled"))
def clean_labels(spark, sf):
    scored, b, _ = claim_store(spark, sf)
    return scored.select("claim_id", rules.clean_label(sigmoid(F.col("base_logodds") + b), seed=SEED).alias("denied"))


@query("noisy_labels", "L5", with_labeled(f"SELECT claim_id, CASE WHEN {sql_uniform('claim_id', f'{SEED}:flip')} < 0.1::DOUBLE THEN 1 - denied ELSE denied END AS denied FROM labeled"))
def noisy_labels(spark, sf):
    return labeled_claims(spark, sf, noise=0.1).select("claim_id", "denied")


@query("denial_reasons", "L6", with_labeled("SELECT claim_id, denied, reason_code FROM labeled"))
def denial_reasons(spark, sf):
    return labeled_claims(spark, sf).select("claim_id", "denied", "reason_code")


@query("driver_trip_rates", "L7", with_labeled(
    "SELECT driver, (round(rate, 6) + 0.0::DOUBLE) AS rate FROM (SELECT unnest([" + ", ".join(f"'{d}'" for d in DRIVERS) + ", 'realized_prevalence']) AS driver, unnest(["
    + ", ".join(f"avg(CAST(c_{d} > 0 AS DOUBLE))" for d in DRIVERS) + ", avg(denied)]) AS rate FROM labeled)"))
def driver_trip_rates(spark, sf):
    return rules.driver_trip_rates(labeled_claims(spark, sf)).select("driver", r6("rate"))


REASONS_SQL = with_labeled("SELECT insurance_type, reason_code, count(*) AS n_denied FROM labeled WHERE denied = 1 GROUP BY ALL")


@query("reason_breakdown", "L8", REASONS_SQL)
def reason_breakdown(spark, sf):
    return rules.reason_breakdown(labeled_claims(spark, sf), ["insurance_type"])


_targets = ", ".join(f"({t}::DOUBLE)" for t in PREVALENCE_TARGETS)
_sweep_sql = with_labeled("x").split("targets AS (SELECT")[0] + f"targets AS (SELECT * FROM (VALUES {_targets}) v(t)), {bisect_sql('targets')}, " + f"""
 u AS (SELECT base_logodds, {sql_uniform('claim_id', f'{SEED}:label')} AS u FROM scored),
 res AS (SELECT t, b, (SELECT avg(CAST(u < 1.0::DOUBLE / (1.0::DOUBLE + exp(-(base_logodds + b))) AS DOUBLE)) FROM u) AS realized FROM intercepts)
 SELECT t AS target_prevalence, {s6('b', 'intercept')}, {s6('realized', 'realized_prevalence')}, {s6('abs(realized - t)', 'abs_error')} FROM res"""


@query("prevalence_sweep", "L9", _sweep_sql)
def prevalence_sweep(spark, sf):
    out = rules.prevalence_sweep(scored_claims(spark, sf), PREVALENCE_TARGETS, seed=SEED)
    return out.select("target_prevalence", r6("intercept"), r6("realized_prevalence"), r6("abs_error"))


_levels = ", ".join(f"({x}::DOUBLE)" for x in NOISE_LEVELS)


@query("noise_ceiling", "L10 L12", with_labeled("""SELECT label_noise, n, (round((sp - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * (n - p)), 6) + 0.0::DOUBLE) AS auroc FROM (
   SELECT label_noise, count(*) AS n, sum(y) AS p, sum(CASE WHEN y = 1 THEN rk END) AS sp FROM (
     SELECT *, rank() OVER (PARTITION BY label_noise ORDER BY true_denial_prob) + (count(*) OVER (PARTITION BY label_noise, true_denial_prob) - 1) / 2.0::DOUBLE AS rk FROM z) GROUP BY label_noise)""",
    f""", z AS (SELECT label_noise, true_denial_prob, CASE WHEN {sql_uniform('claim_id', f'{SEED}:flip')} < label_noise THEN 1 - denied ELSE denied END AS y
   FROM labeled, (VALUES {_levels}) lv(label_noise))"""))
def noise_ceiling(spark, sf):
    rows = rules.noise_levels_table(labeled_claims(spark, sf), NOISE_LEVELS, seed=SEED)
    rows = stage(rows.select("label_noise", "true_denial_prob", "denied"), "noise")
    area = evaluate.auroc(rows, "denied", "true_denial_prob", ["label_noise"])
    return area.join(rows.groupBy("label_noise").agg(F.count("*").alias("n")), "label_noise").select("label_noise", "n", r6("auroc"))


_flags = {
    "untimely_filing": "filing_days > filing_window", "missing_prior_auth": "pa_req AND NOT pa_got", "medical_necessity": "NOT nec_ok",
    "undocumented_necessity": "NOT nec_doc", "out_of_network": "NOT in_net", "billing_anomaly": "amount_ratio > 1.6::DOUBLE",
}


@query("rule_recovery", "L11", with_labeled(
    " UNION ALL ".join(
        f"SELECT '{d}' AS driver, {s6(f'avg(CASE WHEN {f} THEN p END)', 'mean_tripped')}, {s6(f'avg(CASE WHEN NOT ({f}) THEN p END)', 'mean_clear')} FROM g" for d, f in _flags.items()
    ), ", g AS (SELECT *, 1 / (1 + exp(-(base_logodds - propensity + (SELECT b FROM intercepts)))) AS p FROM labeled WHERE split = 'test')"))
def rule_recovery(spark, sf):
    _, b, _ = claim_store(spark, sf)
    test = labeled_claims(spark, sf).where("split = 'test'").withColumn("p", sigmoid(F.col("base_logodds") - F.col("_provider_propensity") + b))
    return rules.driver_risk_lift(test, "p").select("driver", r6("mean_tripped"), r6("mean_clear"))

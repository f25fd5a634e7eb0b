"""Splits, samples, metrics and drift (X, E, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitlens.catalog.claims import SEED, labeled_claims, scored_claims, sql_key, sql_uniform, table, with_claims, with_labeled
from remitlens.catalog.registry import query, r6, s6
from remitlens.catalog.tables import RUN_SQL
from remitlens.functions.hashing import PRIME
from remitlens.operators import drift, evaluate, placements, rules, sampling
from remitlens.operators.sampling import POISSON_CDF, fit_temporal_cut, replicate_multipliers
from remitlens.session import stage

BOOT = 20


def _test(spark, sf):
    """Test claims with two scores: the rule, and the rule blurred by the filing delay."""
    return (
        labeled_claims(spark, sf)
        .where("split = 'test'")
        .withColumn("blurred", F.col("true_denial_prob") * 0.6 + F.col("_filing_days") / 600.0)
    )


TEST_SQL = ", tt AS (SELECT *, true_denial_prob * 0.6::DOUBLE + filing_days / 600.0::DOUBLE AS blurred FROM labeled WHERE split = 'test')"


@query("temporal_split", "X1", with_labeled("SELECT claim_id, split FROM labeled"))
def temporal_split(spark, sf):
    scored = scored_claims(spark, sf)
    return fit_temporal_cut(scored, seed=SEED).apply(scored).select("claim_id", "split")


@query("stratified_folds", "X2", with_labeled(
    f"SELECT claim_id, denied, CAST((row_number() OVER (PARTITION BY denied ORDER BY {sql_key('claim_id', f'{SEED}:fold')}, claim_id) - 1) % 5 AS INT) AS fold FROM labeled WHERE split = 'train'"))
def stratified_folds(spark, sf):
    train = labeled_claims(spark, sf).where("split = 'train'")
    return sampling.stratified_folds(train.select("claim_id", "denied"), "denied", "claim_id", seed=SEED)


@query("smote_counts", "X4", """WITH c AS (SELECT CAST(label < 2 AS INT) AS y, count(*) AS n FROM embeddings GROUP BY ALL)
  SELECT y, n AS n_real, max(n) OVER () - n AS n_synthetic, 0::BIGINT AS n_outside FROM c""")
def smote_counts(spark, sf):
    """Class parity, and that no synthetic value leaves its class's range."""
    e = table(spark, sf, "embeddings").withColumn("y", (F.col("label") < 2).cast("int"))
    made = sampling.smote(e, "y", "vec_id", "embedding", seed=SEED)
    cells = made.select("y", "is_synthetic", F.posexplode("embedding").alias("pos", "x"))
    span = cells.where("not is_synthetic").groupBy("y", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    off = cells.where("is_synthetic").join(span, ["y", "pos"]).where("x < low - 1e-12 or x > high + 1e-12").groupBy("y").agg(F.count("*").alias("n_outside"))
    sizes = made.groupBy("y").agg(
        F.sum((~F.col("is_synthetic")).cast("long")).alias("n_real"), F.sum(F.col("is_synthetic").cast("long")).alias("n_synthetic")
    )
    return sizes.join(off, "y", "left").na.fill(0, ["n_outside"])


@query("seeded_subsample", "X5", with_labeled(
    f"SELECT claim_id, denied FROM labeled WHERE split = 'test' ORDER BY {sql_key('claim_id', f'{SEED}:sample')}, claim_id LIMIT 2000"))
def seeded_subsample(spark, sf):
    return sampling.subsample(labeled_claims(spark, sf).where("split = 'test'").select("claim_id", "denied"), 2000, "claim_id", SEED)


@query("stratified_sample", "X7", with_labeled(f"""SELECT claim_id, reason_code FROM (SELECT *, row_number() OVER (PARTITION BY reason_code ORDER BY {sql_key('claim_id', f'{SEED}:sample')}, claim_id) AS r
   FROM labeled WHERE denied = 1) WHERE r <= 6"""))
def stratified_sample(spark, sf):
    denied = labeled_claims(spark, sf).where("denied = 1").select("claim_id", "reason_code")
    return sampling.subsample(denied, 6, "claim_id", SEED, by=["reason_code"])


_MULT = ", ".join(f"({b}, {a}::BIGINT, {c}::BIGINT)" for b, (a, c) in ((b, replicate_multipliers(b, 0)) for b in range(BOOT)))
_P = f"{PRIME}::BIGINT"
_W = "(" + " + ".join(f"CAST(u >= {e}::DOUBLE AS INT)" for e in POISSON_CDF) + ")"
BOOT_SQL = TEST_SQL + f""", h1 AS (SELECT rep, denied, true_denial_prob, blurred, (a * ({sql_key('claim_id', 'boot')} % {_P}) + c) % {_P} AS h FROM tt, (VALUES {_MULT}) m(rep, a, c)),
 h2 AS (SELECT *, (h * h) % {_P} AS hh FROM h1), h3 AS (SELECT *, ((((hh * hh) % {_P}) * h) % {_P}) / {float(PRIME)}::DOUBLE AS u FROM h2),
 bw AS (SELECT *, {_W} AS w FROM h3),
 bs AS (SELECT rep, 'auroc_better' AS which, true_denial_prob AS s, denied, w FROM bw UNION ALL SELECT rep, 'auroc_base', blurred, denied, w FROM bw),
 bg AS (SELECT rep, which, s, sum(w * denied)::DOUBLE AS pos, sum(w * (1 - denied))::DOUBLE AS neg FROM bs GROUP BY ALL),
 bc AS (SELECT *, sum(neg) OVER (PARTITION BY rep, which ORDER BY s) - neg AS before FROM bg),
 ba AS (SELECT rep, which, sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM bc GROUP BY ALL),
 br AS (SELECT rep, max(CASE WHEN which = 'auroc_base' THEN auroc END) AS auroc_base, max(CASE WHEN which = 'auroc_better' THEN auroc END) AS auroc_better FROM ba GROUP BY rep)"""


@query("bootstrap_resample", "X6", with_labeled("SELECT CAST(rep AS INT) AS replicate, sum(w)::BIGINT AS n, sum(w * denied)::BIGINT AS n_denied FROM bw GROUP BY rep", BOOT_SQL))
def bootstrap_resample(spark, sf):
    rows = sampling.bootstrap_weights(_test(spark, sf).select("claim_id", "denied"), "claim_id", BOOT)
    return rows.groupBy("replicate").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("denied")).alias("n_denied"))


@query("oracle_ceiling", "E1 L12", with_labeled(f"SELECT {s6('auroc', 'auroc')} FROM area WHERE model = 'rule'", RUN_SQL))
def oracle_ceiling(spark, sf):
    return evaluate.auroc(_test(spark, sf), "denied", "true_denial_prob").select(r6("auroc"))


@query("confusion_counts", "E2", with_labeled("SELECT model, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, (n_samples - tp - fp - fn)::BIGINT AS tn FROM cm WHERE model = 'rule'", RUN_SQL))
def confusion_counts(spark, sf):
    return evaluate.confusion(_test(spark, sf), "denied", "true_denial_prob").select(F.lit("rule").alias("model"), "tp", "fp", "fn", "tn")


@query("evaluation_record", "E3 E4", with_labeled(f"SELECT phase, model, {s6('auroc', 'auroc')}, {s6('f1', 'f1')}, {s6('precision', 'precision')}, {s6('recall', 'recall')}, n_samples FROM ev", RUN_SQL))
def evaluation_record(spark, sf):
    rows = labeled_claims(spark, sf).where("split = 'test'").select(
        "denied", F.lit("audit").alias("phase"),
        F.inline(F.array(F.struct(F.lit("rule").alias("model"), F.col("true_denial_prob").alias("prob")), F.struct(F.lit("filing").alias("model"), (F.col("_filing_days") / 240.0).alias("prob")))),
    )
    return evaluate.evaluate(rows, "denied", "prob").select("phase", "model", *[r6(m) for m in ("auroc", "f1", "precision", "recall")], "n_samples")


_CI = lambda c: f"(round(quantile_cont({c}, 0.025), 6) + 0.0::DOUBLE) AS {c}_low, (round(quantile_cont({c}, 0.975), 6) + 0.0::DOUBLE) AS {c}_high"


@query("bootstrap_lift", "E5", with_labeled(
    f"SELECT {_CI('auroc_base')}, {_CI('auroc_better')}, {_CI('lift')}, {s6('avg(lift)', 'lift_mean')}, {s6('avg(CAST(lift <= 0 AS DOUBLE))', 'p_value_one_sided')}, count(*) AS n_boot "
    "FROM (SELECT *, auroc_better - auroc_base AS lift FROM br)", BOOT_SQL))
def bootstrap_lift(spark, sf):
    out = evaluate.bootstrap_auroc_lift(_test(spark, sf), "claim_id", "denied", "blurred", "true_denial_prob", replicates=BOOT)
    names = [f"{c}_{e}" for c in ("auroc_base", "auroc_better", "lift") for e in ("low", "high")]
    return out.select(*[r6(c) for c in names], r6("lift_mean"), r6("p_value_one_sided"), "n_boot")


@query("bootstrap_lift_full", "E5")
def bootstrap_lift_full(spark, sf):
    """The usual 2000 replicates."""
    return evaluate.bootstrap_auroc_lift(_test(spark, sf), "claim_id", "denied", "blurred", "true_denial_prob")


_MID = "(rank() OVER (PARTITION BY {g} ORDER BY {s}) + (count(*) OVER (PARTITION BY {t}) - 1) / 2.0::DOUBLE)"


def _placed(s: str) -> str:
    """Placement of each test row under a score, from its mid-ranks among all rows and in its class."""
    among = f"({_MID.format(g='1', s=s, t=s)} - {_MID.format(g='denied', s=s, t=f'denied, {s}')})"
    other = "count(*) FILTER (denied = {}) OVER ()"
    return f"CASE WHEN denied = 1 THEN {among} / {other.format(0)} ELSE 1.0::DOUBLE - {among} / {other.format(1)} END"


@query("placement_lift", "E5", with_labeled(
    f"""SELECT {s6('a', 'auroc_base')}, {s6('b', 'auroc_better')}, {s6('b - a', 'lift_point')}, round(va * 1e6::DOUBLE, 6) + 0.0::DOUBLE AS var_base, round(vb * 1e6::DOUBLE, 6) + 0.0::DOUBLE AS var_better,
     round(cab * 1e6::DOUBLE, 6) + 0.0::DOUBLE AS covariance, {s6('sqrt(va + vb - 2 * cab)', 'std_error')}, {s6('b - a - 1.959963984540054::DOUBLE * sqrt(va + vb - 2 * cab)', 'lift_low')},
     {s6('b - a + 1.959963984540054::DOUBLE * sqrt(va + vb - 2 * cab)', 'lift_high')}, n_pos, n_neg FROM (
      SELECT max(ma) FILTER (denied = 1) AS a, max(mb) FILTER (denied = 1) AS b, sum(sa / n) AS va, sum(sb / n) AS vb, sum(sab / n) AS cab, max(n) FILTER (denied = 1) AS n_pos, max(n) FILTER (denied = 0) AS n_neg FROM (
       SELECT denied, avg(pa) AS ma, avg(pb) AS mb, var_samp(pa) AS sa, var_samp(pb) AS sb, covar_samp(pa, pb) AS sab, count(*) AS n FROM pl GROUP BY denied))""",
    TEST_SQL + f", pl AS (SELECT denied, {_placed('blurred')} AS pa, {_placed('true_denial_prob')} AS pb FROM tt)"))
def placement_lift(spark, sf):
    """The lift of two scores with the variance of their difference from placements: one pass, no replicates."""
    out = placements.placement_lift(_test(spark, sf), "denied", "blurred", "true_denial_prob")
    micro = [F.round(F.col(c) * 1e6, 6).alias(c) for c in ("var_base", "var_better", "covariance")]
    return out.select("n_pos", "n_neg", *micro, *[r6(c) for c in ("auroc_base", "auroc_better", "lift_point", "std_error", "lift_low", "lift_high")])


@query("ks_small_samples", "D3")
def ks_small_samples(spark, sf):
    """Length of good and of bad labelled notes: largest CDF gap with its p-value."""
    rows = stage(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("n_chars", "quality"), "lengths")
    out = drift.ks_two_sample(rows.where("quality = 1"), rows.where("quality = 0"), "n_chars")
    return out.select("feature", r6("ks_stat"), r6("ks_pvalue"))


@query("brier_score", "E6", with_labeled(f"SELECT {s6('avg(pow(true_denial_prob - denied, 2))', 'brier')} FROM labeled WHERE split = 'test'"))
def brier_score(spark, sf):
    return evaluate.brier(_test(spark, sf), "denied", "true_denial_prob").select(r6("brier"))


def _edges_sql(col: str, rows: str) -> str:
    return "(SELECT quantile_cont(" + col + ", [" + ", ".join(f"{i / 10}" for i in range(1, 10)) + f"]) FROM {rows})"


@query("calibration_curve", "E7", with_labeled(f"""SELECT CAST(len(list_filter(e, lambda x: x < true_denial_prob)) AS INT) AS bin, {s6('avg(true_denial_prob)', 'mean_predicted')}, {s6('avg(denied)', 'observed')}, count(*) AS n
   FROM tt, (SELECT {_edges_sql('true_denial_prob', 'tt')} AS e) GROUP BY 1""", TEST_SQL))
def calibration_curve(spark, sf):
    out = evaluate.calibration_curve(_test(spark, sf), "denied", "true_denial_prob")
    return out.select("bin", r6("mean_predicted"), r6("observed"), "n")


_COST = """, th AS (SELECT CAST(i AS INT) AS pct, i / 100.0::DOUBLE AS t FROM range(2, 99) r(i)),
 cc AS (SELECT pct, t AS threshold, sum(CASE WHEN true_denial_prob < t AND denied = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN true_denial_prob >= t AND denied = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
   sum(CASE WHEN true_denial_prob >= t AND denied = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, count(*) AS n, sum(denied) * 400.0::DOUBLE AS do_nothing_cost FROM tt, th GROUP BY ALL)"""


@query("cost_threshold", "E8", with_labeled(f"""SELECT threshold, fn, fp, tp, fn * 400.0::DOUBLE + fp * 40.0::DOUBLE AS expected_cost, {s6('(fn * 400.0::DOUBLE + fp * 40.0::DOUBLE) / n', 'cost_per_claim')}, do_nothing_cost,
   do_nothing_cost - (fn * 400.0::DOUBLE + fp * 40.0::DOUBLE) AS savings_vs_do_nothing FROM cc ORDER BY fn * 400 + fp * 40, pct LIMIT 1""", TEST_SQL + _COST))
def cost_threshold(spark, sf):
    return evaluate.cost_optimal_threshold(_test(spark, sf), "denied", "true_denial_prob").withColumn("cost_per_claim", F.round("cost_per_claim", 6))


@query("cost_curve", "E10", with_labeled(f"SELECT pct, threshold, fn, fp, tp, {s6('(fn * 400.0::DOUBLE + fp * 40.0::DOUBLE) / n', 'cost_per_claim')}, do_nothing_cost FROM cc", TEST_SQL + _COST))
def cost_curve(spark, sf):
    curve = evaluate.cost_curve(_test(spark, sf), "denied", "true_denial_prob")
    return curve.select("pct", "threshold", "fn", "fp", "tp", r6("cost_per_claim"), "do_nothing_cost")


@query("spearman_agreement", "E9", with_labeled(f"""SELECT {s6('corr(ra, rb)', 'spearman')} FROM (SELECT rank() OVER (ORDER BY true_denial_prob) + (count(*) OVER (PARTITION BY true_denial_prob) - 1) / 2.0::DOUBLE AS ra,
   rank() OVER (ORDER BY blurred) + (count(*) OVER (PARTITION BY blurred) - 1) / 2.0::DOUBLE AS rb FROM tt)""", TEST_SQL))
def spearman_agreement(spark, sf):
    return evaluate.spearman(_test(spark, sf), "true_denial_prob", "blurred").select(r6("spearman"))


@query("score_histogram", "E12", with_labeled(f"""SELECT h.denied, bin, n, {s6('m', 'group_mean')} FROM (SELECT denied, CAST(least(floor(true_denial_prob * 25), 24) AS INT) AS bin, count(*) AS n FROM tt GROUP BY ALL) h
   JOIN (SELECT denied, avg(true_denial_prob) AS m FROM tt GROUP BY ALL) g ON h.denied = g.denied""", TEST_SQL))
def score_histogram(spark, sf):
    out = evaluate.score_histogram(_test(spark, sf), "true_denial_prob", "denied")
    return out.select("denied", "bin", "n", r6("group_mean"))


_FOLD_SQL = f""", z AS (SELECT *, CAST((row_number() OVER (PARTITION BY denied ORDER BY {sql_key('claim_id', f'{SEED}:fold')}, claim_id) - 1) % 5 AS INT) AS fold FROM labeled),
 rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY true_denial_prob) + (count(*) OVER (PARTITION BY fold, true_denial_prob) - 1) / 2.0::DOUBLE AS r FROM z),
 fm AS (SELECT fold, (sum(CASE WHEN denied = 1 THEN r END) - sum(denied) * (sum(denied) + 1) / 2.0::DOUBLE) / (sum(denied)::DOUBLE * sum(1 - denied)) AS auroc,
   sum(CASE WHEN denied = 1 AND true_denial_prob >= 0.5 THEN 1 ELSE 0 END)::DOUBLE / sum(denied) AS recall FROM rk GROUP BY fold)"""


@query("fold_summary", "E14", with_labeled(f"SELECT 'rule' AS model, {s6('avg(auroc)', 'auroc_mean')}, {s6('stddev_pop(auroc)', 'auroc_std')}, {s6('avg(recall)', 'recall_mean')}, {s6('stddev_pop(recall)', 'recall_std')} FROM fm", _FOLD_SQL))
def fold_summary(spark, sf):
    folded = sampling.stratified_folds(labeled_claims(spark, sf).select("claim_id", "denied", "true_denial_prob"), "denied", "claim_id", seed=SEED)
    per_fold = evaluate.evaluate(folded.withColumn("model", F.lit("rule")), "denied", "true_denial_prob", by=["model", "fold"])
    out = evaluate.fold_summary(per_fold, ["model"], ["auroc", "recall"])
    return out.select("model", *[r6(c) for c in out.columns if c != "model"])


_VERDICT = """, au AS (SELECT which, auroc FROM (SELECT which, sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM (
     SELECT which, pos, neg, sum(neg) OVER (PARTITION BY which ORDER BY s) - neg AS before FROM (
       SELECT which, s, sum(denied)::DOUBLE AS pos, sum(1 - denied)::DOUBLE AS neg FROM (
         SELECT 'better' AS which, true_denial_prob AS s, denied FROM tt UNION ALL SELECT 'base', blurred, denied FROM tt) GROUP BY ALL)) GROUP BY which)),
 mx AS (SELECT (SELECT auroc FROM au WHERE which = 'better') AS ceiling, (SELECT auroc FROM au WHERE which = 'base') AS base,
   (SELECT quantile_cont(auroc_better - auroc_base, 0.025) FROM br) AS low)"""


@query("health_verdict", "E13", with_labeled("""SELECT 'rule' AS model, concat_ws('  ', CASE WHEN ceiling - base <= 0.005 THEN 'SIREN: no text lift — note signal not landing' END,
     CASE WHEN low <= 0 THEN 'WARN: lift 95% CI includes 0 — not statistically clear' END) AS flags FROM mx
   UNION ALL SELECT 'blurred', concat_ws('  ', CASE WHEN base - ceiling <= 0.005 THEN 'SIREN: no text lift — note signal not landing' END,
     CASE WHEN base > ceiling + 0.01 THEN 'SIREN: fused above oracle ceiling — leak' END, CASE WHEN low > 0 THEN 'WARN: lift 95% CI includes 0 — not statistically clear' END) FROM mx""", BOOT_SQL + _VERDICT))
def health_verdict(spark, sf):
    """Verdict on the rule taken as the fused model over the blurred score, and the other way round.

    The interval is that of the usual 2000 replicates; blank_lift is the lift of note_ladder's blanked notes.
    """
    from remitlens.catalog.models import note_lifts

    lift = bootstrap_lift_full(spark, sf)
    ladder = note_lifts(spark, sf, ["structured", "structured+blank"])
    return verdicts(lift, ladder)


def verdicts(lift, ladder):
    """Flags of both directions from one row of bootstrap lift and a ladder with the rung structured+blank."""
    blank = ladder.where("model = 'structured+blank'").select(F.col("lift").alias("blank_lift"))
    lift = stage(lift.crossJoin(blank), "lift")
    up = lift.select(
        F.lit("rule").alias("model"), F.col("lift_point").alias("text_lift"), F.col("auroc_better").alias("fused"), F.col("auroc_better").alias("ceiling"),
        "blank_lift", F.col("lift_low").alias("lift_ci_low"),
    )
    down = lift.select(
        F.lit("blurred").alias("model"), (-F.col("lift_point")).alias("text_lift"), F.col("auroc_base").alias("fused"), F.col("auroc_better").alias("ceiling"),
        "blank_lift", (-F.col("lift_low")).alias("lift_ci_low"),
    )
    return evaluate.health_flags(up.unionByName(down)).select("model", F.array_join("flags", "  ").alias("flags"))


# --- drift --------------------------------------------------------------------------


def _sides(spark, sf):
    df = labeled_claims(spark, sf).withColumn("filing_days", F.col("_filing_days"))
    return df.where("split = 'train'"), df.where("split = 'test'")


def _psi_num_sql(c: str) -> str:
    return f"""(SELECT sum((a - e) * ln(a / e)) FROM (SELECT greatest(n0 / sum(n0) OVER (), 1e-6::DOUBLE) AS e, greatest(n1 / sum(n1) OVER (), 1e-6::DOUBLE) AS a FROM (
      SELECT len(list_filter(q, lambda x: x <= {c})) AS bin, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END)::DOUBLE AS n1
      FROM labeled, (SELECT {_edges_sql(c, "(SELECT * FROM labeled WHERE split = 'train')")} AS q) GROUP BY 1)))"""


def _psi_cat_sql(c: str) -> str:
    return f"""(SELECT sum((a - e) * ln(a / e)) FROM (SELECT greatest(n0 / sum(n0) OVER (), 1e-6::DOUBLE) AS e, greatest(n1 / sum(n1) OVER (), 1e-6::DOUBLE) AS a FROM (
      SELECT {c}, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END)::DOUBLE AS n1 FROM labeled GROUP BY 1)))"""


def _ks_sql(c: str) -> str:
    return f"""(SELECT max(abs(c0 / t0 - c1 / t1)) FROM (SELECT sum(n0) OVER (ORDER BY {c}) AS c0, sum(n1) OVER (ORDER BY {c}) AS c1, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1 FROM (
      SELECT {c}, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END)::DOUBLE AS n1 FROM labeled GROUP BY 1)))"""


def _ks_p_sql(c: str) -> str:
    """Asymptotic p-value: the same hundred terms."""
    return f"""(SELECT CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2.0::DOUBLE * list_sum([CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * lam * lam) FOR k IN range(1, 101)]))) END
      FROM (SELECT {_ks_sql(c)} * sqrt(n * m / (n + m)) AS lam FROM (SELECT count(*) FILTER (split = 'train')::DOUBLE AS n, count(*) FILTER (split = 'test')::DOUBLE AS m FROM labeled)))"""


@query("psi_numeric", "D1", with_labeled(" UNION ALL ".join(f"SELECT '{c}' AS feature, {s6(_psi_num_sql(c), 'psi')}" for c in ("billed_amount", "filing_days"))))
def psi_numeric(spark, sf):
    a, b = _sides(spark, sf)
    out = drift.psi_numeric(a, b, "billed_amount").unionByName(drift.psi_numeric(a, b, "filing_days"))
    return out.select("feature", r6("psi"))


@query("psi_categorical", "D2", with_labeled(" UNION ALL ".join(f"SELECT '{c}' AS feature, {s6(_psi_cat_sql(c), 'psi')}" for c in ("insurance_type", "cpt_code", "dx_category", "provider_id"))))
def psi_categorical(spark, sf):
    a, b = _sides(spark, sf)
    return drift.psi_categorical(a, b, ["insurance_type", "cpt_code", "dx_category", "provider_id"]).select("feature", r6("psi"))


@query("ks_two_sample", "D3", with_labeled(" UNION ALL ".join(f"SELECT '{c}' AS feature, {s6(_ks_sql(c), 'ks_stat')}, {s6(_ks_p_sql(c), 'ks_pvalue')}" for c in ("billed_amount", "filing_days"))))
def ks_two_sample(spark, sf):
    a, b = _sides(spark, sf)
    both = [drift.ks_two_sample(a, b, c, method="asymp") for c in ("billed_amount", "filing_days")]
    return both[0].unionByName(both[1]).select("feature", r6("ks_stat"), r6("ks_pvalue"))


_FLAG = "CASE WHEN psi > 0.25 THEN 'major' WHEN psi > 0.1 THEN 'moderate' ELSE 'negligible' END"


@query("population_shift_report", "D4 P13", with_labeled(
    f"SELECT feature, type, (round(psi, 6) + 0.0::DOUBLE) AS psi, (round(ks, 6) + 0.0::DOUBLE) AS ks_stat, (round(p, 6) + 0.0::DOUBLE) AS ks_pvalue, {_FLAG} AS drift FROM ("
    + " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, 'numeric' AS type, {_psi_num_sql(c)} AS psi, {_ks_sql(c)} AS ks, {_ks_p_sql(c)} AS p" for c in ("billed_amount", "filing_days")]
        + [f"SELECT '{c}', 'categorical', {_psi_cat_sql(c)}, NULL, NULL" for c in ("insurance_type", "cpt_code", "dx_category")]
    )
    + ") UNION ALL SELECT 'denial_prevalence', 'label', NULL, NULL, NULL, printf('%.3f -> %.3f', (SELECT avg(denied) FROM labeled WHERE split = 'train'), (SELECT avg(denied) FROM labeled WHERE split = 'test'))"))
def population_shift_report(spark, sf):
    a, b = _sides(spark, sf)
    return drift.population_shift_report(a, b, ks_method="asymp").select("feature", "type", r6("psi"), r6("ks_stat"), r6("ks_pvalue"), "drift")

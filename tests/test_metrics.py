import numpy as np
import pytest
from pyspark.sql import functions as F

from remitlens.constants import PREVALENCE_TARGETS
from remitlens.operators import drift, evaluate, ranking, rules, sampling
from remitlens.operators.evaluate import _replicate_weights


def scores(n=3000, hot=0.4, seed=0):
    """Labels and two scores; a large share of rows has one and the same score."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    a = np.where(rng.random(n) < hot, 0.5, np.round(rng.random(n) * 0.7 + 0.3 * y, 3))
    b = rng.random(n)
    return [f"r{i}" for i in range(n)], y, a, b


def frame(spark, ids, y, a, b):
    return spark.createDataFrame(list(zip(ids, y.tolist(), a.tolist(), b.tolist())), "claim_id string, denied int, p double, q double")


def area(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = w * (y == 1), w * (y == 0)
    below = sum(float(pos[s == v].sum()) * (float(neg[s < v].sum()) + float(neg[s == v].sum()) / 2) for v in np.unique(s))
    return below / (pos.sum() * neg.sum())


def test_auroc_counts_ties_half(spark):
    ids, y, a, b = scores()
    df = frame(spark, ids, y, a, b)
    assert evaluate.auroc(df, "denied", "p").first()["auroc"] == pytest.approx(area(y, a), abs=1e-12)


def test_auroc_of_negated_score_is_the_complement(spark):
    df = frame(spark, *scores())
    up = evaluate.auroc(df, "denied", "p").first()["auroc"]
    down = evaluate.auroc(df.withColumn("p", -F.col("p")), "denied", "p").first()["auroc"]
    assert up + down == pytest.approx(1.0, abs=1e-12)


def test_auroc_without_a_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "denied int, p double")
    assert evaluate.auroc(df, "denied", "p").first()["auroc"] is None


@pytest.mark.parametrize("rows", [100, 100_000])
def test_bootstrap_replicates_are_exact_with_a_hot_score(spark, rows):
    ids, y, a, b = scores(1500)
    df = frame(spark, ids, y, a, b)
    keys = {r["claim_id"]: r["k"] for r in df.select("claim_id", evaluate.residue_key("claim_id", "boot").alias("k")).collect()}
    w = _replicate_weights(np.array([keys[i] for i in ids]), 0, 5, seed=0)
    got = {r["replicate"]: r for r in evaluate.bootstrap_replicates(df, "claim_id", "denied", "p", "q", replicates=5, group_rows=rows).collect()}
    for r in range(5):
        assert got[r]["auroc_base"] == pytest.approx(area(y, a, w[:, r]), abs=1e-12)
        assert got[r]["auroc_better"] == pytest.approx(area(y, b, w[:, r]), abs=1e-12)


def test_poisson_interval_agrees_with_resampling(spark):
    ids, y, a, b = scores(800)
    out = evaluate.bootstrap_auroc_lift(frame(spark, ids, y, a, b), "claim_id", "denied", "q", "p", replicates=400).first()
    rng = np.random.default_rng(1)
    lifts = []
    for _ in range(300):
        i = rng.integers(0, len(y), len(y))
        lifts.append(area(y[i], a[i]) - area(y[i], b[i]))
    low, high = np.percentile(lifts, [2.5, 97.5])
    assert out["lift_low"] == pytest.approx(low, abs=0.02) and out["lift_high"] == pytest.approx(high, abs=0.02)


@pytest.mark.parametrize("kind", ["smooth", "hot", "tiny"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(2)
    x = {"smooth": rng.exponential(size=5000), "hot": np.where(rng.random(5000) < 0.4, 1.0, rng.random(5000)), "tiny": np.array([3.0, 1.0, 2.0])}[kind]
    probs = [i / 10 for i in range(11)]
    got = ranking.exact_quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", probs)
    assert got == pytest.approx(np.quantile(x, probs).tolist(), abs=1e-12)


def test_hash_rank_is_a_permutation_per_group(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3 == 0).alias("g"))
    rows = ranking.rank_by_hash(df, "id", "t", ["g"], parts=7).collect()
    for g in (True, False):
        ranks = sorted(r["rank"] for r in rows if r["g"] == g)
        assert ranks == list(range(1, len(ranks) + 1))


def test_cost_thresholds_are_exact_at_the_grid(spark):
    p = [i / 100 for i in range(0, 101)]
    df = spark.createDataFrame([(x, i % 2) for i, x in enumerate(p)], "p double, denied int")
    for r in evaluate.cost_curve(df, "denied", "p").collect():
        assert r["fn"] == sum(1 for i, x in enumerate(p) if x < r["threshold"] and i % 2 == 1)
        assert r["fp"] == sum(1 for i, x in enumerate(p) if x >= r["threshold"] and i % 2 == 0)


def test_no_drift_against_itself(spark):
    df = frame(spark, *scores()).withColumn("g", F.substring("claim_id", 2, 1))
    assert drift.psi_numeric(df, df, "p").first()["psi"] == pytest.approx(0.0, abs=1e-12)
    assert drift.psi_categorical(df, df, ["g"]).first()["psi"] == pytest.approx(0.0, abs=1e-12)
    ks = drift.ks_two_sample(df, df, "q").first()
    assert ks["ks_stat"] == 0.0 and ks["ks_pvalue"] == 1.0


def test_intercept_equals_plain_bisection(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=2000) * 2
    df = spark.createDataFrame([(float(v),) for v in base], "base_logodds double")

    def bisect(t):
        low, high = -20.0, 20.0
        for _ in range(200):
            mid = (low + high) / 2
            rate = (1 / (1 + np.exp(-(base + mid)))).mean()
            if abs(rate - t) < 1e-4:
                return mid
            low, high = (mid, high) if rate < t else (low, mid)
        return (low + high) / 2

    assert rules.calibrate_intercepts(df, PREVALENCE_TARGETS) == {t: bisect(t) for t in PREVALENCE_TARGETS}


@pytest.mark.parametrize("limit", [10_000, 20])
def test_temporal_cut_is_exact_when_one_day_is_hot(spark, monkeypatch, limit):
    monkeypatch.setattr(sampling, "SMALL_SAMPLE", limit)
    df = spark.range(900).select(
        F.col("id").cast("string").alias("claim_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 9).cast("int")).alias("submission_date"),
    )
    got = sampling.fit_temporal_cut(df).apply(df)
    assert got.where("split = 'train'").count() == 675
    edge = got.groupBy("split").agg(F.min("submission_date").alias("a"), F.max("submission_date").alias("b")).collect()
    by = {r["split"]: r for r in edge}
    assert by["train"]["b"] <= by["test"]["a"]


def test_folds_are_balanced(spark):
    df = frame(spark, *scores()).select("claim_id", "denied")
    sizes = sampling.stratified_folds(df, "denied", "claim_id").groupBy("denied", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in sizes if r["denied"] == y]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_smote_reaches_parity_inside_the_class(spark):
    rng = np.random.default_rng(6)
    rows = [(f"i{i}", int(i < 30), rng.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, y int, v array<double>")
    made = sampling.smote(df, "y", "id", "v").toPandas()
    assert (made["y"] == 1).sum() == (made["y"] == 0).sum() == 170
    real = np.array([r[2] for r in rows if r[1] == 1])
    for v in made[made["is_synthetic"]]["v"]:
        d = [np.linalg.norm(np.array(v) - a) + np.linalg.norm(np.array(v) - b) - np.linalg.norm(a - b) for a in real for b in real]
        assert min(d) < 1e-9


@pytest.mark.parametrize("slots", [1, 7])
def test_ranges_follow_the_values(spark, slots):
    rng = np.random.default_rng(8)
    x = np.where(rng.random(2000) < 0.4, 1.0, rng.exponential(size=2000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = ranking.with_range(df, "x", ranking.value_bounds(df, "x", 5), slots).orderBy("x").collect()
    ranges = [r["_range"] for r in got]
    assert ranges == sorted(ranges) and len({r["_range"] for r in got if r["x"] == 1.0}) == 1


def test_running_totals_with_slots(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(ranking, "MAX_QUANTILES", 4)
    rng = np.random.default_rng(10)
    x, n = rng.exponential(size=800), rng.integers(1, 9, size=800)
    df = spark.createDataFrame(list(zip(x.tolist(), n.tolist())), "x double, n long")
    got = {r["x"]: r["before_n"] for r in ranking.running_totals(df, "x", ["n"]).collect()}
    assert got == {float(v): int(n[x < v].sum()) for v in x}


def test_replicate_weights_equal_the_plain_hash():
    """Folded residues and the weight table give what modulo and division give, at the edges too."""
    from remitlens.functions.hashing import PRIME
    from remitlens.operators.evaluate import _EDGES, _residue
    from remitlens.operators.sampling import POISSON_CDF, replicate_multipliers

    x = np.array([0, PRIME - 1, PRIME, PRIME + 1, 2 * PRIME, (PRIME - 1) ** 2 + PRIME - 1, (1 << 62) - 1])
    assert _residue(x.copy()).tolist() == [int(v) % PRIME for v in x]
    keys = np.random.default_rng(3).integers(0, PRIME, 20_000)
    for b in (0, 7, 1999):
        a, c = replicate_multipliers(b, 4)
        u = np.array([pow((int(k) * a + c) % PRIME, 5, PRIME) / float(PRIME) for k in keys])
        assert (_replicate_weights(keys, b, b + 1, 4)[:, 0] == np.searchsorted(POISSON_CDF, u, side="right")).all()
    for t, edge in zip(_EDGES.tolist(), POISSON_CDF):
        assert (t - 1) / float(PRIME) < edge <= t / float(PRIME)


def test_bootstrap_ranges_are_not_merged_into_one_task(spark):
    """Ranges of few bytes, whose draws are the work, go to several tasks."""
    from remitlens.operators.evaluate import _partial_areas

    rows = spark.range(4000).selectExpr("id * 7919 % 2147483647 as _k", "cast(id % 3 = 0 as int) as _y", "id / 4000.0 as s")
    areas = _partial_areas(rows, "s", 3, 0, 500)
    areas.collect()
    assert "REPARTITION_BY_NUM" in areas._jdf.queryExecution().toString()

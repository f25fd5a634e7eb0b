"""Histogram boosting, placement variances, path counts and the cosine join against brute force."""

from itertools import permutations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitlens.operators import boosting
from remitlens.operators.boosting import Booster, BoostedModels, Growth, binned, fit_boosters
from remitlens.operators.cosine_join import cosine_join, term_cells
from remitlens.operators.drift import ks_two_sample
from remitlens.operators.placements import path_p_value, placement_lift
from remitlens.session import attach

EDGES = [[-1.0, -0.4, 0.0, 0.4, 1.0]] * 4


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    x = r.standard_normal((700, 4))
    y = (r.random(700) < 1 / (1 + np.exp(-2 * x[:, 0] - 3 * (x[:, 1] > 0.4) * (x[:, 2] > 0)))).astype(int)
    fold = r.integers(0, 3, 700)
    return x, y, fold


def frame(spark, rows):
    x, y, fold = rows
    data = [(i, [float(v) for v in x[i]], [int(y[i]), int(y[i]) if fold[i] else None, int(1 - y[i])]) for i in range(len(x))]
    return spark.createDataFrame(data, "id int, x array<double>, y array<int>").repartition(5)


def brute_trees(bins, y, features, growth, positive=1.0):
    """Second-order boosting without sampling, one node at a time."""
    margin, trees, w = np.zeros(len(y)), [], np.where(y == 1, positive, 1.0)
    for _ in range(growth.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * w, p * (1 - p) * w
        tree, step = {}, np.zeros(len(y))

        def grow(at, members, level):
            total_g, total_h = g[members].sum(), h[members].sum()
            step[members] = -growth.rate * total_g / (total_h + growth.l2)
            if level == growth.depth:
                return
            best = (1e-12, None, None)
            for f in features:
                for cut in range(5):
                    left = members[bins[members, f] <= cut]
                    right = members[bins[members, f] > cut]
                    if min(h[left].sum(), h[right].sum()) < growth.min_hessian:
                        continue
                    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + growth.l2)
                    gain = 0.5 * (score(left) + score(right) - score(members))
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
            if best[1] is not None:
                tree[at] = best[1:]
                for child, side in ((2 * at + 1, bins[members, best[1]] <= best[2]), (2 * at + 2, bins[members, best[1]] > best[2])):
                    grow(child, members[side], level + 1)

        grow(0, np.arange(len(y)), 0)
        trees.append(tree)
        margin = margin + step
    return trees, margin


def test_trees_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "CUT", 2)  # states are written and read again on the way
    x, y, fold = rows
    growth = Growth(trees=5, depth=3, rate=0.3, row_share=1.0, column_share=1.0)
    boosters = [Booster("all", (0, 1, 2, 3)), Booster("two folds", (0, 2, 3), positive=3.0), Booster("swapped", (1, 3))]
    fitted = fit_boosters(frame(spark, rows), boosters, growth, edges=EDGES)
    bins = binned(x, [np.array(e) for e in EDGES])
    probs = {r.id: r.probs for r in fitted.score(frame(spark, rows)).collect()}
    seen = [np.arange(len(y)), np.flatnonzero(fold), np.arange(len(y))]
    for m, (booster, members, labels) in enumerate(zip(boosters, seen, (y, y, 1 - y))):
        trees, margin = brute_trees(bins[members], labels[members], booster.features, growth, booster.positive)
        for t, tree in enumerate(trees):
            found = fitted.trees[m]
            assert {i: (int(found.feature[t, i]), int(found.cut[t, i])) for i in np.flatnonzero(found.feature[t] >= 0)} == tree
        assert np.allclose([probs[i][m] for i in members.tolist()], 1 / (1 + np.exp(-margin)), atol=1e-5)


def test_sampled_growth_is_repeatable_and_learns(spark, rows):
    x, y, _ = rows
    df, growth = frame(spark, rows).coalesce(1), Growth(trees=30, depth=3)
    one, two = (fit_boosters(df, [Booster("a", (0, 1, 2, 3))] * 3, growth) for _ in range(2))
    assert (one.trees[0].weight == two.trees[0].weight).all()
    again = BoostedModels.from_table(one.as_table(spark))
    p = {r.id: r.probs[0] for r in again.score(df.withColumn("probs", F.lit("taken"))).collect()}
    assert {r.id: r.probs[0] for r in one.score(df).collect()} == p
    best = np.array([p[i] for i in range(len(y))])
    assert np.mean((best > 0.5) == y) > 0.8
    gains = {r.feature: r.gain for r in one.gains(spark, ["f0", "f1", "f2", "f3"]).where("model = 'a'").collect()}
    assert set(gains) == {"f0", "f1", "f2", "f3"} and gains["f0"] > gains["f3"]


def test_odd_rows_of_boosting(spark, rows):
    df = frame(spark, rows)
    empty = fit_boosters(df.where("false"), [Booster("a", (0, 1))], Growth(trees=2))
    assert {r.probs[0] for r in empty.score(df.select("id", F.slice("x", 1, 2).alias("x"))).collect()} == {0.5}
    nulls = df.withColumn("x", F.transform("x", lambda v, i: F.when(i == 3, F.lit(None)).otherwise(v)))
    fitted = fit_boosters(nulls, [Booster("a", (0, 3))] * 3, Growth(trees=2), edges=EDGES)
    assert (fitted.trees[0].feature != 3).all() and fitted.score(nulls).count() == 700
    none = fit_boosters(df.withColumn("y", F.array(F.lit(None).cast("int"))), [Booster("a", (0, 1))], Growth(trees=2))
    assert set(none.trees[0].feature.ravel()) == {-1} and not none.trees[0].weight.any()


def brute_lift(y, a, b):
    def places(s):
        pos, neg = s[y == 1], s[y == 0]
        wins = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
        return wins.mean(axis=1), wins.mean(axis=0)

    (pa, na), (pb, nb) = places(a), places(b)
    s = np.cov(pa, pb) / len(pa) + np.cov(na, nb) / len(na)
    return pa.mean(), pb.mean(), s[0, 0], s[1, 1], s[0, 1]


def test_placement_lift(spark):
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 400)
    a, b = np.round(r.random(400) + 0.2 * y, 1), np.round(r.random(400) + 0.5 * y, 2)
    a[:150] = 0.5  # a third of all rows is one score
    df = spark.createDataFrame([(int(i), float(p), float(q)) for i, p, q in zip(y, a, b)] + [(None, 0.1, 0.2), (1, None, 0.3)], "y int, a double, b double")
    got = placement_lift(df, "y", "a", "b").first()
    want = brute_lift(y, a, b)
    assert np.allclose([got.auroc_base, got.auroc_better, got.var_base, got.var_better, got.covariance], want, atol=1e-12)
    assert got.lift_low < got.lift_point < got.lift_high and 0 < got.p_value_one_sided < 0.5
    same = placement_lift(df, "y", "a", "a").first()
    assert same.lift_point == 0 and same.std_error == 0 and same.z is None
    assert placement_lift(df.where("y = 1"), "y", "a", "b").first().lift_point is None
    assert placement_lift(df.where("false"), "y", "a", "b").first().n_pos == 0


def test_placements_agree_with_replicates(spark, sf):
    from remitlens.catalog.evaluation import _test
    from remitlens.operators.evaluate import bootstrap_auroc_lift

    rows = _test(spark, sf)
    one = placement_lift(rows, "denied", "blurred", "true_denial_prob").first()
    many = bootstrap_auroc_lift(rows, "claim_id", "denied", "blurred", "true_denial_prob", 400).first()
    assert abs(one.lift_point - many.lift_point) < 1e-9
    width = one.lift_high - one.lift_low
    assert abs(one.lift_low - many.lift_low) < 0.15 * width and abs(one.lift_high - many.lift_high) < 0.15 * width


def test_path_counts():
    for n, m in ((1, 1), (3, 2), (4, 4), (5, 3)):
        orders = set(permutations("a" * n + "b" * m)) if n + m < 9 else set()
        gaps = []
        for order in orders:
            i = j = top = 0
            for c in order:
                i, j = i + (c == "a"), j + (c == "b")
                top = max(top, abs(i * m - j * n))
            gaps.append(top)
        assert len(orders) == comb(n + m, n)
        for gap in range(0, n * m + 2):
            assert abs(path_p_value(n, m, gap) - sum(g >= gap for g in gaps) / len(gaps)) < 1e-12
    assert path_p_value(5, 0, 3) == 1.0 and 0 < path_p_value(10_000, 9_000, 2_500_000) < 1


def test_small_samples_are_exact(spark):
    a = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 9)], "x double")
    b = spark.createDataFrame([(float(x),) for x in (4, 5, 6, 7, 8)] + [(None,)], "x double")
    got = ks_two_sample(a, b, "x").first()
    assert got.ks_stat == 0.75 and abs(got.ks_pvalue - path_p_value(4, 5, 15)) < 1e-12
    assert ks_two_sample(a, b, "x", "asymp").first().ks_pvalue != got.ks_pvalue
    assert ks_two_sample(a, b.where("x is null"), "x").first().ks_stat is None


@pytest.mark.parametrize("threshold,rows_a_term", [(0.2, 100_000), (0.5, 3), (0.9, 100_000)])
def test_cosine_join_equals_all_pairs(spark, monkeypatch, threshold, rows_a_term):
    monkeypatch.setattr("remitlens.operators.cosine_join.TERM_ROWS", rows_a_term)
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words, r.integers(1, 9), p=np.array([0.3] + [0.7 / 39] * 39))) for _ in range(120)]
    left = spark.createDataFrame([(t,) for t in texts[:30] + ["w0", "", None]], "text string")
    right = spark.createDataFrame([(t,) for t in texts[20:] + ["w0", "w0 w0", "the", texts[40]]], "text string")
    cells = term_cells(left.unionByName(right), "text")
    names = lambda df: df.where("text is not null").select(F.md5("text").alias("text_key")).distinct()
    from remitlens.functions.text import text_key

    names = lambda df: df.where("text is not null").select(text_key("text").alias("text_key")).distinct()
    a, b = (cells.join(names(df), "text_key", "left_semi") for df in (left, right))
    vectors = {}
    for c in cells.collect():
        vectors.setdefault(c.text_key, {})[c.term] = c.w
    keys = lambda df: {c.text_key for c in df.collect()}
    want = {(p, q): round(s, 9) for p in keys(a) for q in keys(b) if (s := sum(w * vectors[q].get(t, 0) for t, w in vectors[p].items())) >= threshold - 1e-10}
    got = {(x.left_key, x.right_key): x.similarity for x in cosine_join(a, b, threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got) and len(got) > 10
    assert cosine_join(a.where("false"), b, threshold).count() == 0
    with pytest.raises(ValueError):
        cosine_join(a, b, 0)


def test_attach_splits_hot_keys(spark):
    members = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = members.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = attach(members, groups, ["k"], "n")
    assert got.columns == ["k", "id", "n", "top"] and got.count() == 3000
    assert got.where("k = 0").select("top").distinct().collect()[0].top == 2997


def test_histograms_need_no_matrix_of_wide_cells():
    """A block's histograms equal sums over rows, and take far less memory than eight bytes for each row and feature."""
    import tracemalloc

    from remitlens.operators.boosting import Booster, Growth, Trees, _histograms, _kept, _Layout

    rng = np.random.default_rng(5)
    n, width = 8000, 60
    bins, labels = rng.integers(0, 8, (n, width)).astype(np.uint8), rng.integers(0, 2, (n, 1)).astype(np.uint8)
    labels[::7] = 255
    margins, tree, growth = rng.normal(size=(n, 1)).astype(np.float32), Trees.empty(1, 2), Growth()
    tree.feature[0, 0], tree.cut[0, 0] = 3, 4
    layout = _Layout([Booster("m", tuple(range(0, width, 2)), 4.0)], [np.arange(7.0)] * width)
    tracemalloc.start()
    got = _histograms((2, bins, labels, margins), layout, growth, 0, 1, [tree])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen = _kept(growth.seed, 0, 2, n, growth.row_share) & (labels[:, 0] != 255)
    p = 1 / (1 + np.exp(-margins[:, 0].astype(float)))
    w = np.where(labels[:, 0] == 1, 4.0, 1.0)
    want = np.zeros((2, 2, layout.totals[0]))
    for i in np.flatnonzero(seen):
        for j, f in enumerate(range(0, width, 2)):
            want[:, int(bins[i, 3] > 4), layout.starts[0][j] + bins[i, f]] += (p[i] - labels[i, 0]) * w[i], p[i] * (1 - p[i]) * w[i]
    assert np.allclose(got, want.ravel(), rtol=1e-12, atol=1e-12)
    assert peak < n * width * 4


@pytest.mark.parametrize("cells,block,frequent", [(1_000_000, 1 << 21, 1000), (1_000_000, 8, 5), (0, 8, 5)])
def test_requirements_are_scored_without_a_join_on_terms(spark, monkeypatch, cells, block, frequent):
    rng = np.random.default_rng(11)
    words = [f"w{int(i)}" for i in range(30)]
    def text(): return " ".join(words[min(29, int(i))] for i in rng.exponential(6, int(rng.integers(0, 9))))  # noqa: E704
    asked, chunks = [text() for _ in range(12)] + [None, "never_seen"], [text() for _ in range(150)] + [None, "", "other_word"]
    chunks += chunks[:20] + asked[:2]
    reqs = spark.createDataFrame([("p", f"r{i}", t) for i, t in enumerate(asked + asked[:1])], "policy_id string, req_id string, requirement_text string")
    from remitlens.operators import evidence as ev
    monkeypatch.setattr(ev, "MAX_CELLS", cells)
    monkeypatch.setattr(ev, "BLOCK_CELLS", block)
    monkeypatch.setattr(ev, "MAX_FREQUENT", frequent)
    if cells:
        monkeypatch.setattr(ev, "cosine_join", lambda *a: pytest.fail("pairs of texts were joined on their terms"))
    got = ev.requirement_matches(reqs, spark.createDataFrame([(c,) for c in chunks], "chunk string"), 0.3, stop_words=())
    assert got.columns == ["policy_id", "req_id", "requirement_text", "chunk", "score"]
    every = {t for t in asked + chunks if t is not None}
    df = {w: sum(w in t.split() for t in every) for t in every for w in t.split()}
    def unit(t):
        v = {w: t.split().count(w) * (np.log((1 + len(every)) / (1 + df[w])) + 1) for w in t.split()}
        return {w: x / np.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    want = {}
    for i, q in enumerate(asked + asked[:1]):
        for c in {c for c in chunks if c is not None} if q is not None else ():
            a, b = unit(q), unit(c)
            s = sum(x * b.get(w, 0.0) for w, x in a.items())
            if s >= 0.3:
                want[f"r{i}", c] = s
    found = {(r.req_id, r.chunk): r.score for r in got.collect()}
    assert len(want) > 50 and found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-8 for k in want)


def test_dense_evidence_is_scored_from_the_chunk(spark, monkeypatch):
    from remitlens.operators import evidence as ev
    rows = [(1, "cardiac stress test", ["a cardiac stress test was done", "", "nothing else"]), (2, "cardiac stress test", None), (3, None, ["x ray of the chest"]), (4, "", ["-", None]), (5, "physical therapy", ["therapy", "physical therapy twice", "physical therapy twice"])]
    cases = spark.createDataFrame([(i, t, c, (c or [])[:1]) for i, t, c in rows], "case_id int, requirement_text string, full_record_chunks array<string>, submitted_chunks array<string>")
    want = sorted(map(str, ev.best_matches(cases, ev.dense_vectors(cases), ev._dense_dot).collect()))
    monkeypatch.setattr(ev, "dense_vectors", lambda *a: pytest.fail("a vector was kept for every chunk"))
    assert sorted(map(str, ev.hashed_matches(cases).collect())) == want and len(want) == 8
    labelled = cases.selectExpr("*", "'r' AS req_id", "'complete' AS gold_variant")
    assert ev.classify_dense(labelled).count() == 5

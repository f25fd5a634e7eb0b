import numpy as np
import pytest
from pyspark.sql import functions as F

from remitlens.operators import retrieval as rt

SMALL = (40, 16)


def vectors(spark, rows, schema="id string, v array<double>"):
    return spark.createDataFrame(rows, schema)


def brute(ids, x, k, metric="cosine", anchors=None, weight=0.0, days=None, skip_self=True):
    ids = np.asarray(ids)
    if metric == "cosine":
        dots, sq = x @ x.T, (x * x).sum(1)
        if anchors is not None:
            known = np.array([a is not None for a in anchors])
            same = np.array([[a is not None and a == b for b in anchors] for a in anchors])
            dots, sq = dots + weight**2 * same, sq + weight**2 * known
        n = np.sqrt(sq)
        n[n == 0] = 1
        cost = -np.round(dots / np.outer(n, n), 9)
    else:
        cost = np.round(((x[:, None] - x[None]) ** 2).sum(-1), 9)
    if skip_self:
        np.fill_diagonal(cost, np.inf)
    if days is not None:
        cost = np.where(np.asarray(days)[None] < np.asarray(days)[:, None], cost, np.inf)
    out = {}
    for q in range(len(x)):
        order = np.lexsort((ids, cost[q]))[:k]
        out[ids[q]] = [ids[j] for j in order if np.isfinite(cost[q, j])]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["neighbour_id"])
    return out


def random_rows(n=240, d=6, seed=1, copies=80, zeros=5):
    """Random vectors, a third of them copies of one, a few of length zero."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:copies] = x[0]
    x[copies : copies + zeros] = 0.0
    ids = [f"c{i:04d}" for i in rng.permutation(n)]
    anchors = [None if rng.random() < 0.05 else f"p{rng.integers(0, 6)}" for _ in range(n)]
    return ids, x, anchors


def test_nearest_first(spark):
    index = vectors(spark, [("far", [0.0, 0.0, 1.0, 0.0]), ("near", [1.0, 0.0, 0.0, 0.0])])
    asked = vectors(spark, [("q", [0.95, 0.05, 0.0, 0.0])])
    rows = rt.nearest(asked, index, id_col="id", vec_col="v", k=2).orderBy("rank").collect()
    assert [r["neighbour_id"] for r in rows] == ["near", "far"]
    assert rows[0]["similarity"] >= rows[1]["similarity"]


def test_excluded_id_is_not_returned(spark):
    index = vectors(spark, [("self", [1.0, 0.0]), ("other", [0.0, 1.0])])
    asked = vectors(spark, [("q", [1.0, 0.0])]).withColumn("skip", F.array(F.lit("self")))
    rows = rt.nearest(asked, index, id_col="id", vec_col="v", k=1, exclude_col="skip").collect()
    assert [r["neighbour_id"] for r in rows] == ["other"]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block", [(8192, 4096), SMALL])
def test_equals_brute_force_with_copies_and_zeros(spark, metric, block):
    ids, x, _ = random_rows()
    df = vectors(spark, [(i, v.tolist()) for i, v in zip(ids, x)])
    hits = rt.nearest(df, df, id_col="id", vec_col="v", k=4, metric=metric, exclude_self=True, block=block)
    assert found(hits) == brute(ids, x, 4, metric)


@pytest.mark.parametrize("block", [(8192, 4096), SMALL])
def test_anchored_search_equals_brute_force(spark, block):
    ids, x, anchors = random_rows(seed=3)
    df = vectors(spark, [(i, v.tolist(), a) for i, v, a in zip(ids, x, anchors)], "id string, v array<double>, a string")
    hits = rt.nearest(df, df, id_col="id", vec_col="v", k=5, anchor_col="a", anchor_weight=2.0, exclude_self=True, block=block)
    assert found(hits) == brute(ids, x, 5, anchors=anchors, weight=2.0)


def test_earlier_rows_only(spark):
    ids, x, _ = random_rows(seed=5)
    days = [int(i[1:]) % 17 for i in ids]
    df = vectors(spark, [(i, v.tolist(), d) for i, v, d in zip(ids, x, days)], "id string, v array<double>, n int").withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n"))
    )
    hits = rt.nearest(df, df, id_col="id", vec_col="v", k=3, before_col="day", block=SMALL)
    assert found(hits) == {i: v for i, v in brute(ids, x, 3, days=days, skip_self=False).items() if v}


def test_saved_index_gives_the_same_rows(spark, tmp_path):
    ids, x, anchors = random_rows(seed=7)
    df = vectors(spark, [(i, v.tolist(), a) for i, v, a in zip(ids, x, anchors)], "id string, v array<double>, a string")
    index = rt.build_index(df, id_col="id", vec_col="v", keep=6, anchor_col="a", anchor_weight=2.0, block=SMALL)
    index.save(str(tmp_path / "index"))
    again = rt.VectorIndex.load(spark, str(tmp_path / "index"))
    args = {"id_col": "id", "vec_col": "v", "k": 5, "anchor_col": "a", "exclude_self": True}
    assert found(rt.nearest(df, again, **args)) == found(rt.nearest(df, index, **args)) == brute(ids, x, 5, anchors=anchors, weight=2.0)


def test_result_does_not_depend_on_partitions(spark):
    ids, x, _ = random_rows(seed=9)
    df = vectors(spark, [(i, v.tolist()) for i, v in zip(ids, x)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(found(rt.nearest(df.repartition(int(n)), df, id_col="id", vec_col="v", k=4, block=SMALL)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_no_neighbours_give_zero_features(spark):
    queries = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "claim_id string, billed_amount double")
    hits = spark.createDataFrame([("a", 1, "n", -0.5, 1, 5.0)], "query_id string, rank int, neighbour_id string, similarity double, denied int, billed_amount double")
    rows = {r["claim_id"]: r for r in rt.neighbour_features(queries, hits).collect()}
    assert all(rows["b"][c] == 0.0 for c in rt.RETRIEVAL_FEATURES)
    assert rows["a"]["retr_max_similarity"] == 0.0 and rows["a"]["retr_denial_rate"] == 1.0
    assert rows["a"]["retr_billed_delta"] == pytest.approx(2.0)


def test_one_hot_anchor_among_small_ones(spark):
    """An anchor with most rows is split over many clusters, the small ones are not."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 5)) + 2.0
    ids = [f"c{i:04d}" for i in rng.permutation(300)]
    anchors = ["big" if i < 200 else f"p{i % 25}" for i in range(300)]
    df = vectors(spark, [(i, v.tolist(), a) for i, v, a in zip(ids, x, anchors)], "id string, v array<double>, a string")
    index = rt.build_index(df, id_col="id", vec_col="v", keep=7, anchor_col="a", anchor_weight=1.0, block=SMALL)
    sizes = {r["_anchor"]: r["_np"] for r in index.anchors.collect()}
    assert sizes["big"] == 13 and all(n == 1 for a, n in sizes.items() if a != "big")
    hits = rt.nearest(df, index, id_col="id", vec_col="v", k=6, anchor_col="a", exclude_self=True)
    assert found(hits) == brute(ids, x, 6, anchors=anchors, weight=1.0)


def test_cells_rule_out_one_hot_blocks(spark, monkeypatch, tmp_path):
    """Rows of few one-hot values and three numbers: exact, saved and loaded too, and few cells are visited."""
    rng = np.random.default_rng(5)
    n = 1200
    x = np.concatenate([rng.normal(size=(n, 3)), *[np.eye(c)[rng.integers(0, c, n)] for c in (3, 4)]], axis=1)
    ids = [f"c{i:04d}" for i in rng.permutation(n)]
    df = vectors(spark, [(i, v.tolist()) for i, v in zip(ids, x)])
    written, stage = {}, rt.stage

    def recorded(rows, name):
        written[name] = stage(rows, name)
        return written[name]

    monkeypatch.setattr(rt, "stage", recorded)
    index = rt.build_index(df, id_col="id", vec_col="v", keep=6, metric="euclidean", block=(256, 64))
    want = brute(ids, x, 5, "euclidean")
    options = dict(id_col="id", vec_col="v", k=5, metric="euclidean", exclude_self=True, block=(256, 64))
    assert found(rt.nearest(df, index, **options)) == want
    visits = written["visits"].agg(F.sum(F.size("_visits"))).first()[0]
    assert visits < n * len(index.clusters) / 2
    monkeypatch.undo()
    index.save(str(tmp_path / "index"))
    assert found(rt.nearest(df, rt.VectorIndex.load(spark, str(tmp_path / "index")), **options)) == want


def test_cells_of_few_values(spark):
    """Ties across cells go to the smaller id; equal rows are never cut."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, size=(200, 7)).astype(float) + np.where(np.arange(7) == 0, rng.integers(0, 40, (200, 1)), 0.0)
    ids = [f"c{i:04d}" for i in range(200)]
    df = vectors(spark, list(zip(ids, x.tolist())))
    assert found(rt.nearest(df, df, id_col="id", vec_col="v", k=4, metric="euclidean", exclude_self=True, block=(16, 8))) == brute(ids, x, 4, "euclidean")
    cells, means = rt._Cells.grow(np.ones((9, 3)), 4)
    assert len(means) == 1 and (cells.home(np.ones((2, 3))) == 0).all()

"""Sizes and values at which an earlier form of an operator failed or was wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitlens.functions.scalar import observable_columns, two_digits
from remitlens.functions.text import stop_list, tokens
from remitlens.operators.evaluate import cost_curve
from remitlens.operators.features import fit_encoder
from remitlens.operators.ranking import rank_by_hash, running_totals
from remitlens.operators.retrieval import build_index, nearest
from remitlens.session import staging_root, staging_scope, stage


@pytest.mark.parametrize("offset,gap", [(1e5, 0.01), (1e6, 0.003), (1e7, 0.05)])
def test_euclidean_is_exact_at_large_norms(spark, offset, gap):
    rng = np.random.default_rng(int(offset))
    x = offset * np.repeat(rng.standard_normal((3, 4)), 60, axis=0) + gap * rng.standard_normal((180, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = build_index(df, id_col="id", vec_col="v", keep=5, metric="euclidean")
    got = nearest(df, index, id_col="id", vec_col="v", k=4, exclude_self=True).collect()
    exact = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1).round(9)
    np.fill_diagonal(exact, np.inf)
    want = {(q, r + 1, int(i), float(exact[q, i])) for q in range(180) for r, i in enumerate(np.lexsort((np.arange(180), exact[q]))[:4])}
    assert {(r.query_id, r["rank"], r.neighbour_id, r.distance) for r in got} == want


def test_two_digits_round_the_binary_value(spark):
    values = [k / 1000 for k in range(-1000, 1001)] + [0.1250000001, 0.00499999999, 1 / 3]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", two_digits("x").alias("s")).collect()
    assert [r.s.replace("-0.00", "0.00") for r in rows] == [f"{r.x:.2f}".replace("-0.00", "0.00") for r in rows]


def test_encoder_takes_many_code_combinations(spark):
    rows = spark.range(50_000).select(
        (F.col("id") % 50).cast("string").alias("insurance_type"), (F.col("id") % 997).cast("string").alias("cpt_code"), (F.col("id") % 991).cast("string").alias("dx_category"),
        F.lit(10.0).alias("billed_amount"), F.lit(5.0).alias("_procedure_base_cost"), F.lit("2024-01-01").cast("date").alias("service_date"), F.lit("2024-01-05").cast("date").alias("submission_date"),
    )
    assert len(fit_encoder(rows).feature_names) == 3 + 50 + 997 + 991


def test_ranks_with_many_groups(spark):
    df = spark.range(6000).select("id", (F.col("id") % 2000).alias("g"))
    ranked = rank_by_hash(df, "id", "t", group=["g"], parts=2000)
    assert {tuple(r) for r in ranked.groupBy("g").agg(F.sum("rank"), F.max("rank")).select(F.col("sum(rank)"), F.col("max(rank)")).collect()} == {(6, 3)}
    totals = running_totals(df.select("g", F.col("id").cast("double").alias("x"), F.lit(1).alias("n")), "x", ["n"], group=["g"])
    assert sorted({r.before_n for r in totals.collect()}) == [0, 1, 2]


def test_cost_curve_takes_margins(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") - 500.0).alias("s"))
    rows = cost_curve(df, "y", "s").collect()
    assert len(rows) == 97 and all((r.fn, r.fp, r.tp) == (250, 249, 250) for r in rows)


def test_labels_stay_hidden(spark):
    df = spark.createDataFrame([(1, 2.0, 0.5, "train", 1, 3)], "claim_id int, c_late double, true_denial_prob double, split string, _x int, billed_amount int")
    assert observable_columns(df) == ["claim_id", "billed_amount"]


def test_named_stop_list(spark):
    assert "the" in stop_list("english") and stop_list(["a"]) == ["a"]
    assert spark.createDataFrame([("the claim was denied",)], "t string").select(tokens("t", "english").alias("w")).first().w == ["claim", "denied"]


def test_scope_removes_what_it_staged(spark):
    import os

    with staging_scope(spark):
        inner = stage(spark.range(3), "inside")
        assert inner.count() == 3
    assert not [d for d in os.listdir(staging_root(spark).removeprefix("file:")) if d.startswith("scope-")]
    assert stage(spark.range(2), "outside").count() == 2


def test_temporal_cut_takes_timestamps(spark):
    from remitlens.operators.sampling import fit_temporal_cut

    df = spark.range(400).select(F.col("id").cast("string").alias("claim_id"), F.timestamp_seconds(F.col("id") * 3600).alias("submission_date"))
    counts = {r.split: r["count"] for r in fit_temporal_cut(df).apply(df).groupBy("split").count().collect()}
    assert counts == {"train": 300, "test": 100}

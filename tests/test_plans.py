from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from remitlens.catalog.claims import claims_view
from remitlens.operators import models
from remitlens.plans import phases
from remitlens.session import stage


def test_whole_run(spark, sf):
    claims = stage(claims_view(spark, sf).withColumn("note", F.concat_ws(" ", F.lit("visit for"), "cpt_code", "icd10_code", F.when(F.col("_necessity_documented"), "therapy failed"))), "claims")
    labeled, intercept = phases.label_job(claims)
    assert -20 < intercept < 20
    run = phases.prepare(labeled, k=5)
    metrics, rows = phases.ablation_job(run, lambda x: models.gradient_boosting(x, trees=3), note="note", min_df=1)
    table = {r["model"]: r for r in metrics.collect()}
    assert set(table) == {"structured", "structured+text", "structured+retrieval", "structured+text+retrieval"}
    assert table["structured"]["lift"] == 0 and all(0.5 < r["auroc"] <= 1 for r in table.values())
    # The documentation driver is visible in the notes only.
    assert table["structured+text"]["lift"] > 0
    lift = phases.lift_job(rows, "structured", "structured+text", replicates=50).first()
    assert lift["n_boot"] == 50 and lift["lift_low"] <= lift["lift_mean"] <= lift["lift_high"]
    assert phases.shift_job(run).count() == 6
    model = Pipeline(stages=[VectorAssembler(inputCols=["structured", "retrieval"], outputCol="x"), models.gradient_boosting("x", trees=2)]).fit(run.train)
    new = run.test.select([c for c in run.test.columns if c not in ("embedding", "anchor", "structured", "retrieval")])
    decisions = phases.decide_job(run, model, new)
    assert decisions.count() == new.count()
    assert decisions.where("size(evidence) <> 5 or suggested_action is null or rationale is null").count() == 0

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from remitlens.catalog.claims import claim_store, labeled_claims
from remitlens.catalog.features import claim_neighbours
from remitlens.functions import scalar as fn
from remitlens.operators import attribution as at
from remitlens.operators import evidence as ev
from remitlens.operators import models, support
from remitlens.operators import text as tx
from remitlens.session import small_rows
from remitlens.sources.schema import CLAIM_SCHEMA, split_valid, validate_claims


def claim(**over):
    import datetime as dt

    row = {
        "claim_id": "c", "provider_id": "p", "patient_id": None, "icd10_code": "E11.9", "cpt_code": "99214", "insurance_type": "private",
        "billed_amount": 250.0, "service_date": dt.date(2026, 1, 1), "submission_date": dt.date(2026, 1, 3), "reason_code": None,
        "clinical_note": None, "denied": 1,
    }
    row.update(over)
    return tuple(row[f.name] for f in CLAIM_SCHEMA.fields)


def test_claim_rules(spark):
    import datetime as dt

    loose = CLAIM_SCHEMA.fromJson(CLAIM_SCHEMA.jsonValue())
    for f in loose.fields:
        f.nullable = True
    rows = [claim(), claim(billed_amount=-1.0), claim(insurance_type="x"), claim(submission_date=dt.date(2025, 1, 1)), claim(cpt_code=None)]
    df = spark.createDataFrame(rows, loose)
    got = [r["violations"] for r in validate_claims(df).collect()]
    assert got == [[], ["negative_billed_amount"], ["unknown_insurance_type"], ["submission_before_service"], ["missing_cpt_code"]]
    good, bad = split_valid(df)
    assert (good.count(), bad.count()) == (1, 4)


def test_realized_rate_is_near_the_target(spark, sf):
    rate = labeled_claims(spark, sf).agg(F.avg("denied")).first()[0]
    assert abs(rate - 0.19) < 0.02


def test_neighbours_are_past_rows_and_never_the_claim_itself(spark, sf):
    train = {r[0] for r in labeled_claims(spark, sf).where("split = 'train'").select("claim_id").collect()}
    for split in ("train", "test"):
        rows = claim_neighbours(spark, sf, split).select("query_id", "neighbour_id").collect()
        assert all(r["neighbour_id"] in train and r["neighbour_id"] != r["query_id"] for r in rows)


def test_response_text_is_read_or_neutral(spark):
    bodies = ['{"denial_probability": 0.3}', '{"denial_probability": 7}', '{"denial_probability": "0.25"}', "{broken", "{}", None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [r[0] for r in df.select(fn.response_probability("body")).collect()] == [0.3, 1.0, 0.25, 0.5, 0.5, 0.5]


def test_blank_text_has_no_words(spark):
    df = spark.createDataFrame([("",), ("  \n ",), (" a  b\nc ",)], "t string")
    assert [r[0] for r in df.select(fn.word_count("t")).collect()] == [0, 0, 3]


def test_long_codes_keep_their_remainder(spark):
    codes = ["9" * 40 + "1", "XYZ", "i10", " e11.9"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(fn.code_category("c")).collect()] == ["Endocrine", "General", "Cardiovascular", "Endocrine"]


def test_action_is_found_by_substring(spark):
    reasons = ["CO-29 Untimely filing: submitted after payer window", "CO-197 Precertification/authorization absent", None]
    df = spark.createDataFrame([(r,) for r in reasons], "r string")
    got = [r[0] for r in df.select(support.suggested_action("r")).collect()]
    assert got[0].startswith("Escalate") and got[1].startswith("Review this claim") and got[2].startswith("No action")


def test_collecting_too_much_is_an_error(spark):
    with pytest.raises(ValueError):
        small_rows(spark.range(11), 10, "rows")


def test_unknown_encoder_is_an_error():
    with pytest.raises(ValueError):
        tx.text_encoder("nothing")


def test_tfidf_matches_a_direct_computation(spark):
    notes = ["the knee pain knee", "knee surgery planned", "planned therapy for knee pain", ""]
    df = spark.createDataFrame(list(enumerate(notes)), "id int, t string")
    stop = ["the", "for"]
    table = tx.term_table(df, "t", ngrams=(1, 2), min_df=1, max_features=None, stop_words=stop)
    got = {(r["id"], r["term"]): r["weight"] for r in tx.tfidf_weights(df, "id", "t", table, stop_words=stop).collect()}
    docs = []
    for n in notes:
        w = [x for x in n.split() if x not in stop]
        docs.append(w + [" ".join(p) for p in zip(w, w[1:])])
    for i, d in enumerate(docs):
        raw = {t: d.count(t) * (np.log((1 + len(docs)) / (1 + sum(t in e for e in docs))) + 1) for t in set(d)}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            assert got.pop((i, t)) == pytest.approx(v / norm, abs=1e-12)
    assert not got


def evidence_case(case_id, submitted, record):
    return (case_id, "R1", "six weeks of physical therapy must be documented", submitted, record, "complete")


def test_evidence_status(spark):
    hit, miss = "Completed six weeks of physical therapy.", "Vitals recorded at intake."
    df = spark.createDataFrame(
        [evidence_case(1, [hit], [miss, hit]), evidence_case(2, [miss], [miss, hit]), evidence_case(3, [miss], [miss]), evidence_case(4, [], [])],
        "case_id int, req_id string, requirement_text string, submitted_chunks array<string>, full_record_chunks array<string>, gold_variant string",
    )
    for classify in (ev.classify_lexical, ev.classify_dense):
        rows = {r["case_id"]: r for r in classify(df).collect()}
        assert [rows[i]["predicted_status"] for i in (1, 2, 3, 4)] == ["complete", "omitted", "unsupported", "unsupported"]
        assert rows[2]["cited_chunk"] == hit and rows[4]["sub_score"] == 0.0 and rows[4]["cited_chunk"] is None
    text = {r["case_id"]: r["rationale"] for r in ev.deficiency_report(ev.classify_lexical(df)).collect()}
    assert text[1].startswith("Requirement met") and text[3].startswith("Requirement unsupported")


def small_data(spark, n=400):
    df = spark.range(n).select(
        F.col("id").cast("string").alias("claim_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("x")
    ).withColumn("denied", ((F.col("x")[0] + F.col("x")[1] * F.col("x")[2]) > 0.8).cast("int")).withColumn("features", array_to_vector("x"))
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_attributions_add_up(spark, kind):
    df = small_data(spark)
    learner = GBTClassifier(labelCol="denied", maxIter=4, maxDepth=3) if kind == "boosted" else RandomForestClassifier(labelCol="denied", numTrees=5, maxDepth=3)
    model = learner.fit(df)
    leaves = at.tree_leaves(spark, model)
    wide = at.tree_attribution(models.score(model, df), "claim_id", leaves, ["a", "b", "c"], keep=["prob"]).toPandas()
    total = wide[["a", "b", "c"]].sum(axis=1) + at.base_value(leaves)
    want = np.log(wide["prob"] / (1 - wide["prob"])) if kind == "boosted" else wide["prob"]
    assert np.allclose(total, want, atol=1e-9)


def test_attribution_is_the_shapley_value(spark):
    rng = np.random.default_rng(0)
    leaves = [
        at.Leaf(1.5, {0: (-np.inf, 0.5), 1: (0.2, 0.9), 2: (0.1, np.inf)}, {0: 0.4, 1: 0.7, 2: 0.3}),
        at.Leaf(-0.7, {0: (0.5, np.inf), 2: (-np.inf, 0.6)}, {0: 0.6, 2: 0.5}),
    ]
    x = rng.random((20, 3))
    phi = at._shapley_block(x, leaves)

    def worth(row, known):
        total = 0.0
        for leaf in leaves:
            v = leaf.value
            for f, (low, high) in leaf.spans.items():
                v *= float(low < row[f] <= high) if f in known else leaf.covers[f]
            total += v
        return total

    for row, got in zip(x, phi):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum(
                factorial(len(s)) * factorial(2 - len(s)) / factorial(3) * (worth(row, {*s, f}) - worth(row, set(s)))
                for r in range(3) for s in combinations(rest, r)
            )
            assert got[f] == pytest.approx(want, abs=1e-12)


def test_elimination_keeps_the_informative_feature(spark):
    df = small_data(spark).withColumn("denied", (F.col("x")[0] > 0.5).cast("int"))
    kept, _ = models.recursive_elimination(df, 3, 1)
    assert kept == [0]


def test_counted_rows_grow_the_trees_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.stack([np.round(rng.exponential(size=900), 2), rng.normal(size=900), rng.integers(0, 2, 900)], axis=1).round(3)
    x[::3] = x[0]
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=900) > 0.8).astype(int)
    df = spark.createDataFrame([(str(i), int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "claim_id string, denied int, x array<double>")
    df = df.select("claim_id", "denied", array_to_vector("x").alias("features"))
    whole = models.gradient_boosting(trees=5).fit(df)
    splits = models.split_points(df, "features")
    rows = models.counted(df, "features", splits)
    assert rows.agg(F.sum("weight")).first()[0] == 900 and rows.count() < 700
    model = models.gradient_boosting(trees=5, weight="weight").fit(rows)
    want = {r["claim_id"]: r["prob"] for r in models.score(whole, df).collect()}
    got = {r["claim_id"]: r["prob"] for r in models.score(model, models.coded(df, "features", splits)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_attribution_reads_patterns_instead_of_walking_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    leaves = [at.Leaf(float(v), {f: (-np.inf, 0.5) for f in range(d)}, {f: 0.5 for f in range(d)}) for d, v in ((3, 1.0), (7, 2.0), (0, 3.0))]
    x, sizes, values = rng.random((5000, 7)), [], at._leaf_values
    want = sum(values(leaf, (x[:, list(leaf.spans)] <= 0.5).astype(int)) @ np.eye(len(leaf.spans), 7) for leaf in leaves[:2])
    monkeypatch.setattr(at, "_leaf_values", lambda leaf, present: sizes.append(len(present)) or values(leaf, present))
    got = at._shapley_block(x, leaves)
    assert np.allclose(got, want, atol=1e-12) and max(sizes) <= 128

"""Whole jobs: what one call of the study does, from labelled claims to metric tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.constants import PREVALENCE_TARGET, PROVIDER_WEIGHT
from remitlens.operators import drift, evaluate, models, rules
from remitlens.operators.features import StructuredEncoder, fit_encoder, known_fee
from remitlens.operators.retrieval import RETRIEVAL_FEATURES, VectorIndex, build_index, nearest, neighbour_features
from remitlens.operators.sampling import TemporalCut, fit_temporal_cut
from remitlens.operators.support import decision_support
from remitlens.operators.text import text_encoder
from remitlens.session import stage

PAYLOAD = ["denied", "billed_amount", "reason_code", "provider_id", "icd10_code", "cpt_code", "insurance_type"]
ANCHOR = {"anchor_col": "anchor", "anchor_weight": PROVIDER_WEIGHT}


def label_job(claims: DataFrame, target: float = PREVALENCE_TARGET, noise: float = 0.0, seed: int = 42) -> tuple[DataFrame, float]:
    """Score, calibrate and label claims: (labelled claims, intercept)."""
    scored = stage(rules.base_risk(rules.driver_contributions(claims)), "scored")
    intercept = rules.calibrate_intercepts(scored, [target])[target]
    return rules.label_claims(scored, intercept, noise, seed=seed), intercept


@dataclass
class Prepared:
    """Encoder, index and feature tables of one run."""

    encoder: StructuredEncoder
    cut: TemporalCut
    providers: DataFrame
    index: VectorIndex
    train: DataFrame
    test: DataFrame
    k: int


def prepare(labeled: DataFrame, k: int = 10, seed: int = 42, test_frac: float = 0.25) -> Prepared:
    """Split by time, encode on training rows, index them, and add both feature vectors to every row."""
    usable, _ = known_fee(labeled)
    cut = fit_temporal_cut(usable, seed=seed, test_frac=test_frac)
    rows = stage(cut.apply(usable), "split")
    train_rows = rows.where("split = 'train'")
    encoder = fit_encoder(train_rows)
    providers = stage(train_rows.select("provider_id").distinct(), "providers")
    embedded = stage(encoder.embed(rows, providers), "embedded")
    index = build_index(embedded.where("split = 'train'"), id_col="claim_id", vec_col="embedding", keep=k + 1, payload=PAYLOAD, **ANCHOR)
    sides = []
    for split in ("train", "test"):
        side = embedded.where(F.col("split") == split)
        hits = nearest(side, index, id_col="claim_id", vec_col="embedding", k=k, exclude_self=split == "train", **ANCHOR)
        vec = neighbour_features(side, hits).select("claim_id", array_to_vector(F.array(*RETRIEVAL_FEATURES)).alias("retrieval"))
        sides.append(stage(side.join(vec, "claim_id").withColumn("structured", array_to_vector("embedding")), split))
    return Prepared(encoder, cut, providers, index, *sides, k)


def ablation_job(run: Prepared, learner: Callable[[str], object] | None = None, note: str | None = None, encoder: str = "tfidf", **options) -> tuple[DataFrame, DataFrame]:
    """Metric table with lifts, and the long predictions, over the feature-set ladder.

    With a ``note`` column the ladder has the text rungs too, its vocabulary
    fitted on training notes only.
    """
    train, test = run.train, run.test
    sets = {"structured": ["structured"], "structured+retrieval": ["structured", "retrieval"]}
    if note:
        fitted = text_encoder(encoder, **options).fit(train, note)
        train, test = (stage(fitted.transform(df, "claim_id", note, "text"), "noted") for df in (train, test))
        sets = {
            "structured": ["structured"], "structured+text": ["structured", "text"], "structured+retrieval": ["structured", "retrieval"],
            "structured+text+retrieval": ["structured", "text", "retrieval"],
        }
    learner = learner or (lambda x: models.regularised_boosting(x))
    rows = stage(models.ladder(train, test, sets, learner, keep=["true_denial_prob"]), "ladder")
    metrics = models.with_lifts(evaluate.evaluate(rows, "denied", "prob"), "structured")
    return metrics, rows


def lift_job(predictions: DataFrame, base: str, better: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Paired bootstrap between two rungs of a ladder."""
    wide = predictions.groupBy("claim_id", "denied").agg(
        F.max(F.when(F.col("model") == base, F.col("prob"))).alias("base"), F.max(F.when(F.col("model") == better, F.col("prob"))).alias("better")
    )
    return evaluate.bootstrap_auroc_lift(stage(wide, "pairs"), "claim_id", "denied", "base", "better", replicates, seed)


def shift_job(run: Prepared) -> DataFrame:
    """Drift between the earlier and the later claims."""
    return drift.population_shift_report(*(df.withColumn("filing_days", F.col("_filing_days")) for df in (run.train, run.test)))


def decide_job(run: Prepared, model, claims: DataFrame) -> DataFrame:
    """Decision rows of new claims: one retrieval serves features, reasons and evidence.

    ``model`` is a fitted pipeline over ``structured`` and ``retrieval``.
    """
    asked = run.encoder.embed(claims, run.providers).withColumn("structured", array_to_vector("embedding"))
    hits = stage(nearest(asked, run.index, id_col="claim_id", vec_col="embedding", k=run.k, **ANCHOR), "hits")
    vec = neighbour_features(asked, hits).select("claim_id", array_to_vector(F.array(*RETRIEVAL_FEATURES)).alias("retrieval"))
    return decision_support(models.score(model, asked.join(vec, "claim_id")), hits)

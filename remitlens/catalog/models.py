"""Models, attribution, cross-validation and sweeps (M, X3, L10). Rows-only: fitting has no SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.catalog.claims import SEED, labeled_claims, table, with_labeled
from remitlens.catalog.features import _ENC, _FEATS, ANCHOR, EVIDENCE, K, OUTCOME, claim_neighbours, retrieval_features, train_encoder
from remitlens.catalog.registry import query, r6, s6
from remitlens.constants import NOISE_LEVELS
from remitlens.operators import attribution as at
from remitlens.operators import boosting, evaluate, models, placements, rules, sampling
from remitlens.operators import features as ft
from remitlens.operators import retrieval as rt
from remitlens.operators import text as tx
from remitlens.operators import support as sp
from remitlens.session import stage
from remitlens.sources.tables import scratch_path, write_parquet

_structured: dict = {}


def structured(spark, sf):
    """Training and test claims with their structured feature vector (staged once per session)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _structured:
        _, embedded = train_encoder(spark, sf)
        rows = embedded.select("claim_id", "denied", "split", "true_denial_prob", array_to_vector("embedding").alias("structured"))
        _structured[key] = stage(rows, "structured")
    df = _structured[key]
    return df.where("split = 'train'"), df.where("split = 'test'")


def _record(rows, model: str, phase: str):
    return evaluate.evaluate(rows.withColumn("phase", F.lit(phase)).withColumn("model", F.lit(model)), "denied", "prob")


def _balanced(train):
    """Training rows with the rarer class filled up by interpolation."""
    arrays = train.select("claim_id", "denied", vector_to_array("structured").alias("x"))
    return stage(sampling.smote(arrays, "denied", "claim_id", "x", seed=SEED).select("denied", array_to_vector("x").alias("structured")), "balanced")


@query("logistic_elimination", "M1 M2 X4")
def logistic_elimination(spark, sf):
    """Oversampled training claims, features eliminated down to 15, test metrics."""
    train, test = structured(spark, sf)
    n = len(train_encoder(spark, sf)[0].feature_names)
    balanced = _balanced(train)
    kept, model = models.recursive_elimination(balanced, n, 15, "structured")
    return _record(models.score(model, test), f"logreg-{len(kept)}", "phase1")


@query("decision_tree", "M3")
def decision_tree(spark, sf):
    train, test = structured(spark, sf)
    return _record(models.score(models.decision_tree("structured").fit(_balanced(train)), test), "decision-tree", "phase1")


@query("gradient_boosting", "M4")
def gradient_boosting(spark, sf):
    model, test, _ = _boosted(spark, sf)
    return _record(models.score(model, test), "gradient-boosting", "phase2")


@query("random_forest", "M5")
def random_forest(spark, sf):
    train, test = structured(spark, sf)
    return _record(models.score(models.random_forest("structured").fit(train), test), "random-forest", "phase2")


@query("weighted_boosting", "M6")
def weighted_boosting(spark, sf):
    train, test = structured(spark, sf)
    learner = models.regularised_boosting("structured", trees=200, depth=4, rate=0.05, weight="weight")
    return _record(models.score(learner.fit(models.class_weight(train)), test), "weighted-boosting", "phase4")


RUNGS = ("structured", "structured+text", "structured+retrieval", "structured+text+retrieval", "leaky-index")
_ladders: dict = {}


def claim_texts(spark, sf):
    """Notes of the claims: codes, and what the record says about therapy where necessity is documented."""
    said = F.when(F.col("_necessity_documented"), "conservative therapy failed").otherwise("routine visit")
    return labeled_claims(spark, sf).select("claim_id", "split", F.concat_ws(" ", "icd10_code", "cpt_code", said).alias("note"))


def ladder_claims(spark, sf):
    """All claims with one feature vector for every rung, and each rung's positions in it.

    Training claims find neighbours among the other training claims, test claims among the training claims. The leaky
    rung's neighbours come from an index of all claims, the claim itself included, on both sides.
    """
    train, test = structured(spark, sf)
    _, embedded = train_encoder(spark, sf)
    encoder = tx.text_encoder("tfidf").fit(claim_texts(spark, sf).where("split = 'train'"), "note")
    noted = encoder.transform(claim_texts(spark, sf), "claim_id", "note", "text").select("claim_id", vector_to_array("text").alias("text"))
    honest = retrieval_features(spark, sf, "train").unionByName(retrieval_features(spark, sf, "test"))
    everything = embedded.where("split = 'train'").unionByName(embedded.where("split = 'test'"))
    seen = rt.nearest(everything, everything, id_col="claim_id", vec_col="embedding", k=K, payload=OUTCOME, **ANCHOR)
    leaky = rt.neighbour_features(everything, seen)
    wide = train.unionByName(test).select("claim_id", "split", "denied", "true_denial_prob", vector_to_array("structured").alias("x"))
    for part in (noted, *(r.select("claim_id", F.array(*rt.RETRIEVAL_FEATURES).alias("found")) for r in (honest, leaky))):
        wide = wide.join(part.withColumnRenamed("text", "found"), "claim_id").withColumn("x", F.concat("x", "found")).drop("found")
    ends = [0]
    for width in (len(train_encoder(spark, sf)[0].feature_names), encoder.dim, len(rt.RETRIEVAL_FEATURES), len(rt.RETRIEVAL_FEATURES)):
        ends.append(ends[-1] + width)
    own, text, found, leak = (tuple(range(x, y)) for x, y in zip(ends, ends[1:]))
    positions = dict(zip(RUNGS, (own, own + text, own + found, own + text + found, own + leak)))
    return stage(wide, "ladder"), positions


def fitted_ladder(spark, sf):
    """The rungs' models, grown together (once per session), and the claims they see."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ladders:
        wide, positions = ladder_claims(spark, sf)
        boosters = [boosting.Booster(name, features) for name, features in positions.items()]
        train = wide.where("split = 'train'").withColumn("y", F.array(*[F.col("denied")] * len(boosters)))
        _ladders[key] = (boosting.fit_boosters(train, boosters), wide)
    return _ladders[key]


def ladder_predictions(spark, sf):
    """Test claims with one probability column per rung."""
    fitted, wide = fitted_ladder(spark, sf)
    scored = fitted.score(wide.where("split = 'test'"))
    return scored.select("claim_id", "denied", "true_denial_prob", *[F.col("probs")[i].alias(b.name.replace("+", "_").replace("-", "_")) for i, b in enumerate(fitted.boosters)])


@query("feature_ladder", "M6 M7 R6 F4 E5 L12")
def feature_ladder(spark, sf):
    """Four rungs, the leaky contrast and the ceiling: metrics, cost point, and the lift over the first with its interval."""
    rows = stage(ladder_predictions(spark, sf), "ladder")
    names = {r: r.replace("+", "_").replace("-", "_") for r in RUNGS} | {"ceiling": "true_denial_prob"}
    long = rows.select("denied", F.inline(F.array(*[F.struct(F.lit("ablation").alias("phase"), F.lit(n).alias("model"), F.col(c).alias("prob")) for n, c in names.items()])))
    metrics = evaluate.evaluate(long, "denied", "prob")
    def lift(name, column):
        one = placements.placement_lift(rows, "denied", RUNGS[0], column)
        return one.select(F.lit(name).alias("model"), F.col("lift_point").alias("lift"), "lift_low", "lift_high", "p_value_one_sided")

    found = models.fit_all([lambda n=n, c=c: lift(n, c) for n, c in names.items() if n != RUNGS[0]])
    lifts = reduce(DataFrame.unionByName, found)
    return metrics.join(lifts, "model", "left")


@query("ladder_importance", "F7 M6")
def ladder_importance(spark, sf):
    """The twelve features with the largest total gain in the full rung."""
    fitted, _ = fitted_ladder(spark, sf)
    gains = fitted.gains(spark, [f"f{i:03d}" for i in range(len(fitted.edges))])
    return gains.where(F.col("model") == RUNGS[3]).orderBy(F.desc("gain"), "feature").limit(12).select("feature", r6("gain"), "n_splits")


@query("augmented_decisions", "K1 M11 S8")
def augmented_decisions(spark, sf):
    """The retrieval-augmented rung, written and read back, decides on every test claim with its neighbours at hand."""
    fitted, wide = fitted_ladder(spark, sf)
    path = scratch_path(spark, "boosters")
    write_parquet(fitted.as_table(spark), path)
    again = boosting.BoostedModels.from_table(spark.read.parquet(path))
    scored = again.score(wide.where("split = 'test'")).withColumn("prob", F.col("probs")[RUNGS.index("structured+retrieval")]).drop("probs")
    return sp.decision_support(scored, claim_neighbours(spark, sf, "test", EVIDENCE)).select("claim_id", "denial_probability", "risk_band", "suggested_action", "rationale")


NOTE_RUNGS = {"structured": ["structured"], "text": ["note"], "structured+text": ["structured", "note"], "structured+blank": ["structured", "blank"]}


def note_lifts(spark, sf, rungs):
    """Metrics and lifts of note quality on the named rungs."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("denied"),
        array_to_vector(F.array(F.log1p("n_chars"), *[(F.col("lang") == x).cast("double") for x in ("en", "de", "fr", "es")])).alias("structured"),
    )
    docs = stage(sampling.stratified_folds(docs, "denied", "doc_id", folds=4, seed=SEED), "notes")
    encoder = tx.text_encoder("tfidf").fit(docs.where("fold > 0"), "text")
    noted = encoder.transform(docs, "doc_id", "text", "note")
    blank = encoder.transform(tx.blank_notes(docs, "text"), "doc_id", "text", "blank").select("doc_id", "blank")
    full = stage(noted.join(blank, "doc_id"), "notes")
    rows = models.ladder(
        full.where("fold > 0"), full.where("fold = 0"),
        {r: NOTE_RUNGS[r] for r in rungs},
        models.regularised_boosting, id_col="doc_id", phase="phase3",
    )
    return models.with_lifts(evaluate.evaluate(stage(rows, "ladder"), "denied", "prob"), "structured")


@query("note_ladder", "M8 T6 T7")
def note_ladder(spark, sf):
    """Note quality from document facts, from the text, from both, and from blanked notes."""
    return note_lifts(spark, sf, NOTE_RUNGS)


_W = [round(0.1 * (i + 1), 1) for i in range(len(_FEATS))]


@query("linear_attribution", "M9 F7", with_labeled(
    "SELECT feature, (round(avg(abs(w * (x - m))), 6) + 0.0::DOUBLE) AS mean_abs FROM (SELECT feature, x, w, avg(x) OVER (PARTITION BY feature) AS m FROM (SELECT unnest(["
    + ", ".join(f"'f{i:02d}'" for i in range(len(_FEATS))) + "]) AS feature, unnest(v) AS x, unnest([" + ", ".join(f"{w}::DOUBLE" for w in _W) + "]) AS w FROM enc WHERE split = 'test')) GROUP BY feature", _ENC))
def linear_attribution(spark, sf):
    """Attribution of a linear score with given weights over the test claims."""
    _, test = structured(spark, sf)
    names = [f"f{i:02d}" for i in range(len(_W))]
    wide = test.select("claim_id", vector_to_array("structured").alias("v")).select("claim_id", *[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    means = wide.agg(*[F.avg(n).alias(n) for n in names]).first()
    long = at.linear_attribution(wide, "claim_id", names, _W, [means[n] for n in names])
    return ft.rank_importance(long, top=len(names)).select("feature", r6("mean_abs"))


_fitted: dict = {}


def _boosted(spark, sf):
    """The boosted model (fitted once per session), the test claims with the features it sees, and the feature names."""
    key = (spark.sparkContext.applicationId, sf)
    train, test = structured(spark, sf)
    if key not in _fitted:
        _fitted[key] = models.boost_counted(train, "structured")
    model, splits = _fitted[key]
    return model, models.coded(test, "structured", splits), train_encoder(spark, sf)[0].feature_names


@query("tree_attribution", "M9 F7")
def tree_attribution(spark, sf):
    """Mean absolute Shapley value per feature over all test claims."""
    model, test, names = _boosted(spark, sf)
    wide = at.tree_attribution(test, "claim_id", at.tree_leaves(spark, model), names, "structured")
    return ft.rank_importance(at.long_attribution(wide, "claim_id", names))


@query("attribution_table", "M10")
def attribution_table(spark, sf):
    """Per-claim attributions with label and probability, written and read back."""
    model, test, names = _boosted(spark, sf)
    scored = models.score(model, test)
    wide = at.tree_attribution(scored, "claim_id", at.tree_leaves(spark, model), names, "structured", keep=["denied", "prob"])
    path = scratch_path(spark, "attributions")
    write_parquet(wide, path)
    return spark.read.parquet(path)


@query("batch_scoring", "M11 S8 K1")
def batch_scoring(spark, sf):
    """A saved and reloaded model scores every test claim; decisions follow from its probability."""
    from pyspark.ml.classification import GBTClassificationModel

    model, test, _ = _boosted(spark, sf)
    path = scratch_path(spark, "model")
    model.save(path)
    scored = models.score(GBTClassificationModel.load(path), test)
    return sp.decision_support(scored, claim_neighbours(spark, sf, "test", EVIDENCE)).select("claim_id", "denial_probability", "risk_band", "suggested_action", "rationale")


@query("cross_validated_logistic", "X3 E14 M1")
def cross_validated_logistic(spark, sf):
    """Oversampling and elimination see the training rows of a fold only."""
    train, _ = structured(spark, sf)
    folded = stage(sampling.stratified_folds(train, "denied", "claim_id", seed=SEED), "folds")
    n = len(train_encoder(spark, sf)[0].feature_names)
    per_fold = models.cross_validate(folded, lambda: models.Elimination(n, 15, "structured"), prepare=_balanced, name="logreg")
    return models.cross_validated_score(per_fold)


_STUMP_EDGES = [-1.0, -0.5, 0.0, 0.5, 1.0]


@query("histogram_stump", "M6 L10", with_labeled(
    f"""SELECT CAST(i AS INT) AS feature, {s6('edge', 'edge')}, {s6('gain', 'gain')}, {s6('-gl / (hl + 1)', 'left_weight')}, {s6('-(g - gl) / (h - hl + 1)', 'right_weight')} FROM (
     SELECT *, 0.5::DOUBLE * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain FROM sums WHERE hl >= 2 AND h - hl >= 2)
     ORDER BY gain DESC, i, edge LIMIT 1""",
    _ENC + f""", cells AS (SELECT denied, unnest(v) AS x, unnest(range(len(v))) AS i FROM enc WHERE split = 'train'),
     sums AS (SELECT i, edge, sum(0.5::DOUBLE - denied) AS g, count(*) * 0.25::DOUBLE AS h, coalesce(sum(0.5::DOUBLE - denied) FILTER (x <= edge), 0) AS gl, count(*) FILTER (x <= edge) * 0.25::DOUBLE AS hl
      FROM cells, (SELECT unnest({_STUMP_EDGES}::DOUBLE[]) AS edge) GROUP BY i, edge)"""))
def histogram_stump(spark, sf):
    """The first split of a boosted model over given bins: where, how good, and what its leaves weigh."""
    train, _ = structured(spark, sf)
    n = len(train_encoder(spark, sf)[0].feature_names)
    rows = train.select(vector_to_array("structured").alias("x"), F.array("denied").alias("y"))
    growth = boosting.Growth(trees=1, depth=1, rate=1.0, row_share=1.0, column_share=1.0)
    fitted = boosting.fit_boosters(rows, [boosting.Booster("stump", tuple(range(n)))], growth, edges=[_STUMP_EDGES] * n)
    tree = fitted.trees[0]
    edge, values = _STUMP_EDGES[int(tree.cut[0, 0])], [float(x) for x in (tree.gain[0, 0], tree.weight[0, 1], tree.weight[0, 2])]
    out = spark.createDataFrame([(int(tree.feature[0, 0]), edge, *values)], "feature int, edge double, gain double, left_weight double, right_weight double")
    return out.select("feature", *[r6(c) for c in out.columns[1:]])


def _retrieved(spark, sf, outcomes, hits):
    """Retrieval features of all claims, as an array, under the given outcomes of their neighbours."""
    claims = labeled_claims(spark, sf).select("claim_id", "billed_amount")
    seen = hits.join(outcomes.select(F.col("claim_id").alias("neighbour_id"), "denied"), "neighbour_id")
    return rt.neighbour_features(claims, seen).select("claim_id", F.array(*rt.RETRIEVAL_FEATURES).alias("retrieval"))


def _ladder_rows(scored, boosters, phases):
    """Long predictions (phase, model, claim_id, denied, prob, true_denial_prob) of models scored side by side."""
    each = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(b.name).alias("model"), F.col("y")[i].alias("denied"), F.col("probs")[i].alias("prob")) for i, (b, p) in enumerate(zip(boosters, phases))])
    return scored.select("claim_id", "true_denial_prob", F.inline(each))


@query("noise_sweep", "L10")
def noise_sweep(spark, sf):
    """Retrain under rising label noise: all levels' models grow together on one binned table.

    As labels change, so do neighbour outcomes: the retrieval result is kept and
    its denied flags are swapped.
    """
    noisy = stage(rules.noise_levels_table(labeled_claims(spark, sf), NOISE_LEVELS, seed=SEED).select("claim_id", "label_noise", "denied"), "noise")
    columns = ["query_id", "rank", "neighbour_id", "similarity", "billed_amount"]
    hits = stage(claim_neighbours(spark, sf, "train", ["billed_amount"]).select(*columns).unionByName(claim_neighbours(spark, sf, "test", ["billed_amount"]).select(*columns)), "hits")
    n = len(train_encoder(spark, sf)[0].feature_names)
    labels = noisy.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label_noise", "denied"))), lambda s: s["denied"]).alias("y"))
    train, test = structured(spark, sf)
    wide = train.unionByName(test).select("claim_id", "split", "true_denial_prob", vector_to_array("structured").alias("x")).join(labels, "claim_id")
    for level in NOISE_LEVELS:
        found = _retrieved(spark, sf, noisy.where(F.col("label_noise") == level), hits)
        wide = wide.join(found, "claim_id").withColumn("x", F.concat("x", "retrieval")).drop("retrieval")
    wide = stage(wide.withColumn("y", F.concat("y", "y")), "sweep")
    own, width = tuple(range(n)), len(rt.RETRIEVAL_FEATURES)
    boosters = [boosting.Booster("structured", own) for _ in NOISE_LEVELS]
    boosters += [boosting.Booster("augmented", own + tuple(range(n + i * width, n + (i + 1) * width))) for i in range(len(NOISE_LEVELS))]
    fitted = boosting.fit_boosters(wide.where("split = 'train'"), boosters)
    rows = stage(_ladder_rows(fitted.score(wide.where("split = 'test'")), boosters, [str(x) for x in NOISE_LEVELS] * 2), "sweep")
    ceiling = rows.where("model = 'structured'").select("phase", F.lit("ceiling").alias("model"), "denied", F.col("true_denial_prob").alias("prob"))
    result = evaluate.evaluate(rows.select("phase", "model", "denied", "prob").unionByName(ceiling), "denied", "prob")
    return result.groupBy(F.col("phase").cast("double").alias("label_noise")).agg(
        *[F.max(F.when(F.col("model") == m, F.col("auroc"))).alias(n) for m, n in (("structured", "auroc_structured"), ("augmented", "auroc_augmented"), ("ceiling", "oracle_ceiling"))],
        F.max(F.when(F.col("model") == "augmented", F.col("f1"))).alias("f1_augmented"),
    )

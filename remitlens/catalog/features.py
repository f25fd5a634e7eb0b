"""Feature encoding and similarity retrieval (F, R)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from remitlens.catalog.claims import claim_store, labeled_claims, scored_claims, table, with_claims, with_labeled
from remitlens.catalog.registry import query, r6, s6
from remitlens.catalog.tables import category_sql, signals_sql
from remitlens.constants import INSURANCE_TYPES, PROVIDER_WEIGHT
from remitlens.functions import scalar as fn
from remitlens.operators import features as ft
from remitlens.operators import retrieval as rt
from remitlens.session import stage

# Vocabularies of the test claims, only needed to spell out the SQL twins.
PAYERS = sorted(INSURANCE_TYPES)
CPTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CATS = [f"dx{i}" for i in range(5)]
K = 10

_STATS = """, st AS (SELECT avg(ln(1 + billed_amount)) AS m1, stddev_pop(ln(1 + billed_amount)) + 1e-8::DOUBLE AS s1, avg(amount_ratio) AS m2,
  stddev_pop(amount_ratio) + 1e-8::DOUBLE AS s2, avg(filing_days) AS m3, stddev_pop(filing_days) + 1e-8::DOUBLE AS s3 FROM labeled WHERE split = 'train')"""
_HOT = [("insurance_type", v) for v in PAYERS] + [("cpt_code", v) for v in CPTS] + [("dx_category", v) for v in CATS]
_FEATS = ["(ln(1 + billed_amount) - m1) / s1", "(amount_ratio - m2) / s2", "(filing_days - m3) / s3"] + [f"CAST({c} = '{v}' AS DOUBLE)" for c, v in _HOT]
_ENC = _STATS + f""", enc AS (SELECT labeled.*, [{', '.join(_FEATS)}]::DOUBLE[] AS v FROM labeled, st),
 emb AS (SELECT enc.*, sqrt(list_inner_product(v, v) + {PROVIDER_WEIGHT ** 2}::DOUBLE) AS nrm FROM enc)"""

_encoders: dict = {}
#: What retrieval, models and decisions read of an embedded claim.
EMBEDDED = ["claim_id", "split", "denied", "true_denial_prob", "billed_amount", "reason_code", "provider_id", "icd10_code", "cpt_code", "insurance_type", "embedding", "anchor"]


def train_encoder(spark, sf):
    """Encoder fitted on the training claims, and those claims' embeddings (staged once per session)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _encoders:
        df = labeled_claims(spark, sf)
        train = df.where("split = 'train'")
        encoder = ft.fit_encoder(train)
        # Written first, so that its size is known before the claims would be shuffled for it.
        providers = stage(train.select("provider_id").distinct(), "providers")
        # A training claim's provider is known, so only the others look theirs up.
        own = train.withColumns({"embedding": encoder.array(), "anchor": F.col("provider_id")})
        rest = encoder.embed(df.where(~F.col("split").eqNullSafe("train")), providers)
        embedded = stage(own.select(*EMBEDDED).unionByName(rest.select(*EMBEDDED)), "embedded")
        _encoders[key] = (encoder, embedded)
    return _encoders[key]


@query("encoder_fit", "F1", with_labeled(
    f"SELECT {', '.join(s6(f'{a}{i}', f'{n}_{i}') for i in (1, 2, 3) for a, n in (('m', 'mean'), ('s', 'std')))}, "
    "(SELECT string_agg(DISTINCT insurance_type, ',' ORDER BY insurance_type) FROM labeled WHERE split = 'train') AS payers, "
    "(SELECT string_agg(DISTINCT cpt_code, ',' ORDER BY cpt_code) FROM labeled WHERE split = 'train') AS cpts, "
    "(SELECT string_agg(DISTINCT dx_category, ',' ORDER BY dx_category) FROM labeled WHERE split = 'train') AS categories FROM st", _STATS))
def encoder_fit(spark, sf):
    t = ft.fit_encoder(labeled_claims(spark, sf).where("split = 'train'")).as_table(spark)
    return t.select(
        *[r6(F.col(n)[i - 1], f"{n}_{i}") for i in (1, 2, 3) for n in ("mean", "std")],
        *[F.array_join(c, ",").alias(c) for c in ("payers", "cpts", "categories")],
    )


@query("encoder_transform", "F2", with_labeled("SELECT claim_id, " + ", ".join(s6(f"v[{i + 1}]", f"f{i:02d}") for i in range(len(_FEATS))) + " FROM enc", _ENC))
def encoder_transform(spark, sf):
    encoder, _ = train_encoder(spark, sf)
    return encoder.transform(labeled_claims(spark, sf)).select("claim_id", vector_to_array("features").alias("v")).select(
        "claim_id", *[r6(F.col("v")[i], f"f{i:02d}") for i in range(len(encoder.feature_names))]
    )


@query("retrieval_embedding", "F3", with_labeled(f"SELECT claim_id, provider_id AS anchor, {s6('nrm', 'norm')} FROM emb", _ENC))
def retrieval_embedding(spark, sf):
    _, embedded = train_encoder(spark, sf)
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) + F.when(F.col("anchor").isNotNull(), PROVIDER_WEIGHT**2).otherwise(0.0))
    return embedded.select("claim_id", "anchor", r6(norm, "norm"))


@query("vector_means", "F5", """SELECT label, pos, (round(avg(x), 6) + 0.0::DOUBLE) AS x FROM (
   SELECT label, unnest(embedding)::DOUBLE AS x, CAST(unnest(range(len(embedding))) AS INT) AS pos FROM embeddings) GROUP BY ALL""")
def vector_means(spark, sf):
    means = ft.vector_means(table(spark, sf, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("mean_vector").alias("pos", "x")).select("label", "pos", r6("x"))


_SIG = ["has_medical_necessity", "has_prior_auth_mention", "note_length", "has_diagnosis_mention", "has_procedure_mention"]


@query("category_profile", "F6", with_claims(
    f"""SELECT claim_id, diagnosis_category, {', '.join(s6(f'coalesce(m_{c}, 0)', f'cat_{c}') for c in _SIG)}
      FROM (SELECT claim_id, {category_sql('icd10_code')} AS diagnosis_category FROM claims) LEFT JOIN prof USING (diagnosis_category)""").replace(
    " SELECT claim_id, diagnosis_category", f""", sig AS (SELECT {category_sql("concat('n', doc_id)")} AS diagnosis_category, {signals_sql('text')} FROM documents),
     prof AS (SELECT diagnosis_category, {', '.join(f'avg({c}) AS m_{c}' for c in _SIG)} FROM sig GROUP BY ALL) SELECT claim_id, diagnosis_category""", 1))
def category_profile(spark, sf):
    notes = table(spark, sf, "documents").select(
        fn.code_category(F.concat(F.lit("n"), F.col("doc_id").cast("string"))).alias("diagnosis_category"), *fn.note_signals("text")
    )
    claims = scored_claims(spark, sf).select("claim_id", fn.code_category("icd10_code").alias("diagnosis_category"))
    out = ft.category_profile(claims, notes, "diagnosis_category", _SIG)
    return out.select("claim_id", "diagnosis_category", *[r6(f"cat_{c}") for c in _SIG])


@query("importance_rank", "F7", with_labeled("SELECT feature, (round(avg(abs(value)), 6) + 0.0::DOUBLE) AS mean_abs FROM (SELECT unnest(["
   + ", ".join(f"'f{i:02d}'" for i in range(len(_FEATS))) + "]) AS feature, unnest(v) AS value FROM enc) GROUP BY feature ORDER BY avg(abs(value)) DESC, feature LIMIT 12", _ENC))
def importance_rank(spark, sf):
    encoder, embedded = train_encoder(spark, sf)
    long = embedded.select(F.posexplode("embedding").alias("i", "value")).select(F.format_string("f%02d", "i").alias("feature"), "value")
    return ft.rank_importance(long).select("feature", r6("mean_abs"))


# --- retrieval on the embeddings table -------------------------------------------

_DOT = "list_inner_product({a}, {b})"
_COS = """p AS (SELECT q.vec_id AS query_id, i.vec_id AS neighbour_id, i.label AS label, q.label AS own,
  round(list_inner_product(q.e, i.e) / (q.n * i.n), 9) AS s, round(q.n * q.n + i.n * i.n - 2 * list_inner_product(q.e, i.e), 9) AS d
  FROM v q, v i WHERE {where})"""
_VEC = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), "


def _topk_sql(where: str, order: str, k: int, select: str) -> str:
    return _VEC + _COS.format(where=where) + f", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, neighbour_id) AS INT) AS rank FROM p), t AS (SELECT * FROM r WHERE rank <= {k}) {select}"


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings")


@query("l2_normalize", "R1", _VEC.rstrip(", ") + " SELECT vec_id, CAST(unnest(range(len(e))) AS INT) AS pos, (round(unnest(list_transform(e, lambda x: x / n)), 6) + 0.0::DOUBLE) AS x FROM v")
def l2_normalize(spark, sf):
    return _embeddings(spark, sf).select("vec_id", F.posexplode(rt.l2_normalize("embedding")).alias("pos", "x")).select("vec_id", "pos", r6("x"))


@query("cosine_top_k", "R2", _topk_sql("TRUE", "s DESC", 5, f"SELECT query_id, rank, neighbour_id, label, {s6('s', 'similarity')} FROM t"))
def cosine_top_k(spark, sf):
    e = _embeddings(spark, sf)
    hits = rt.nearest(e, e, id_col="vec_id", vec_col="embedding", k=5, payload=["label"])
    return hits.select("query_id", "rank", "neighbour_id", "label", r6("similarity"))


@query("cosine_top_k_excluding", "R3", _topk_sql("i.vec_id NOT IN (q.vec_id, q.vec_id + 1, q.vec_id - 1)", "s DESC", 5, f"SELECT query_id, rank, neighbour_id, {s6('s', 'similarity')} FROM t"))
def cosine_top_k_excluding(spark, sf):
    e = _embeddings(spark, sf)
    asked = e.withColumn("skip", F.array("vec_id", F.col("vec_id") + 1, F.col("vec_id") - 1))
    hits = rt.nearest(asked, e, id_col="vec_id", vec_col="embedding", k=5, exclude_col="skip")
    return hits.select("query_id", "rank", "neighbour_id", r6("similarity"))


@query("euclidean_top_k", "R7", _topk_sql("i.vec_id <> q.vec_id", "d", 3, f"SELECT query_id, rank, neighbour_id, {s6('d', 'distance')} FROM t"))
def euclidean_top_k(spark, sf):
    e = _embeddings(spark, sf)
    hits = rt.nearest(e, e, id_col="vec_id", vec_col="embedding", k=3, metric="euclidean", exclude_self=True)
    return hits.select("query_id", "rank", "neighbour_id", r6("distance"))


@query("distance_features", "R8", _topk_sql("i.vec_id <> q.vec_id", "d", 3,
    f"SELECT query_id AS vec_id, {s6('avg(d)', 'rag_mean_distance')}, {s6('min(d)', 'rag_top1_distance')}, CAST(max(CASE WHEN rank = 1 THEN CAST(label = own AS INT) END) AS INT) AS rag_category_match FROM t GROUP BY query_id"))
def distance_features(spark, sf):
    e = _embeddings(spark, sf)
    hits = rt.nearest(e, e, id_col="vec_id", vec_col="embedding", k=3, metric="euclidean", exclude_self=True, payload=["label"])
    out = rt.distance_features(e, hits, "vec_id", "label")
    return out.select("vec_id", r6("rag_mean_distance"), r6("rag_top1_distance"), "rag_category_match")


@query("approximate_recall", "R9")
def approximate_recall(spark, sf):
    """Share of the exact neighbours that a search of four clusters finds."""
    e = _embeddings(spark, sf)
    block = (512, 64)
    exact = rt.nearest(e, e, id_col="vec_id", vec_col="embedding", k=5, exclude_self=True, block=block)
    rough = rt.nearest(e, e, id_col="vec_id", vec_col="embedding", k=5, exclude_self=True, block=block, probes=4)
    both = exact.select("query_id", "neighbour_id").join(rough.select("query_id", "neighbour_id", F.lit(1).alias("hit")), ["query_id", "neighbour_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n_exact"))


@query("neighbours_as_of", "R10", _topk_sql("i.vec_id // 3 < q.vec_id // 3", "s DESC", 5, f"SELECT query_id, rank, neighbour_id, {s6('s', 'similarity')} FROM t"))
def neighbours_as_of(spark, sf):
    e = _embeddings(spark, sf).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("vec_id") / 3).cast("int")))
    hits = rt.nearest(e, e, id_col="vec_id", vec_col="embedding", k=5, before_col="day")
    return hits.select("query_id", "rank", "neighbour_id", r6("similarity"))


# --- retrieval on claims ----------------------------------------------------------
# Rows of different providers score below 0.5, rows of one provider above, and every
# provider of the test tables has more than k training claims; so the SQL twins may
# join on the provider. The Spark side makes no such assumption.


def _claims_sql(query_rows: str, index_rows: str, self_ok: bool, select: str) -> str:
    own = "" if self_ok else " AND q.claim_id <> i.claim_id"
    return with_labeled(select, _ENC + f""", p AS (SELECT q.claim_id AS query_id, q.billed_amount AS own_billed, i.claim_id AS neighbour_id, i.denied, i.billed_amount, i.reason_code, i.provider_id,
      i.icd10_code, i.cpt_code, i.insurance_type,
      round((list_inner_product(q.v, i.v) + {PROVIDER_WEIGHT ** 2}::DOUBLE) / (q.nrm * i.nrm), 9) AS s
      FROM emb q JOIN emb i ON q.provider_id = i.provider_id WHERE {query_rows} AND {index_rows}{own}),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS INT) AS rank FROM p), t AS (SELECT * FROM r WHERE rank <= {K}),
     nf AS (SELECT query_id, avg(denied) AS retr_denial_rate, sum(greatest(s, 0) * denied) / (sum(greatest(s, 0)) + 1e-8::DOUBLE) AS retr_weighted_denial, avg(greatest(s, 0)) AS retr_mean_similarity,
       max(greatest(s, 0)) AS retr_max_similarity, sum(denied)::DOUBLE AS retr_n_denied, max(own_billed) / (avg(billed_amount) + 1e-8::DOUBLE) AS retr_billed_delta,
       max(greatest(s, 0)) - avg(greatest(s, 0)) AS retr_sim_spread FROM t GROUP BY query_id)""")


_NF = "SELECT query_id AS claim_id, " + ", ".join(s6(c, c) for c in rt.RETRIEVAL_FEATURES) + " FROM nf"
PAYLOAD = ["denied", "billed_amount", "reason_code", "provider_id", "icd10_code", "cpt_code", "insurance_type"]
OUTCOME = ["denied", "billed_amount"]
EVIDENCE = ["denied", "reason_code", "provider_id"]
ANCHOR = {"anchor_col": "anchor", "anchor_weight": PROVIDER_WEIGHT}

_indexes: dict = {}


def train_index(spark, sf, payload=PAYLOAD) -> rt.VectorIndex:
    """Index over training claims only, with the payload that is asked for (built once per session)."""
    key = (spark.sparkContext.applicationId, sf, *payload)
    if key not in _indexes:
        _, embedded = train_encoder(spark, sf)
        _indexes[key] = rt.build_index(
            embedded.where("split = 'train'"), id_col="claim_id", vec_col="embedding", keep=K + 1, payload=payload, **ANCHOR
        )
    return _indexes[key]


def claim_neighbours(spark, sf, split: str, payload=()):
    """Neighbours in the index of training claims with the named payload (all if empty); a training claim never returns itself."""
    _, embedded = train_encoder(spark, sf)
    return rt.nearest(
        embedded.where(F.col("split") == split), train_index(spark, sf, payload or PAYLOAD), id_col="claim_id", vec_col="embedding", k=K,
        exclude_self=split == "train", payload=payload, **ANCHOR,
    )


def retrieval_features(spark, sf, split: str):
    _, embedded = train_encoder(spark, sf)
    return rt.neighbour_features(embedded.where(F.col("split") == split), claim_neighbours(spark, sf, split, OUTCOME))


def _rounded(df):
    return df.select("claim_id", *[r6(c) for c in rt.RETRIEVAL_FEATURES])


@query("neighbour_features", "R4", _claims_sql("q.split = 'train'", "i.split = 'train'", False, _NF))
def neighbour_features(spark, sf):
    return _rounded(retrieval_features(spark, sf, "train"))


@query("neighbour_features_test", "R5", _claims_sql("q.split = 'test'", "i.split = 'train'", True, _NF))
def neighbour_features_test(spark, sf):
    return _rounded(retrieval_features(spark, sf, "test"))


@query("neighbour_features_leaky", "R6", _claims_sql("q.split = 'test'", "TRUE", True, _NF))
def neighbour_features_leaky(spark, sf):
    """The invalid contrast: the index holds the test claims, and nothing is excluded."""
    _, embedded = train_encoder(spark, sf)
    index = embedded.where("split = 'train'").unionByName(embedded.where("split = 'test'"))
    test = embedded.where("split = 'test'")
    hits = rt.nearest(test, index, id_col="claim_id", vec_col="embedding", k=K, payload=OUTCOME, **ANCHOR)
    return _rounded(rt.neighbour_features(test, hits))


@query("feature_assembly", "F4")
def feature_assembly(spark, sf):
    """Structured and retrieval vectors of the test claims, joined by id and concatenated."""
    encoder, embedded = train_encoder(spark, sf)
    test = embedded.where("split = 'test'").select("claim_id", "denied", array_to_vector("embedding").alias("structured"))
    retrieved = retrieval_features(spark, sf, "test").select("claim_id", array_to_vector(F.array(*rt.RETRIEVAL_FEATURES)).alias("retrieval"))
    joined = ft.assemble(test, "claim_id", {"retrieval": retrieved}, ["structured", "retrieval"])
    x = vector_to_array("features")
    return joined.select("claim_id", F.size(x).alias("n_features"), r6(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), "total"))

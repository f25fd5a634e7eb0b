"""Sources, sinks, validation, projections and scalar functions (S, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitlens.catalog.claims import CLAIMS_SQL, SEED, labeled_claims, notes, scored_claims, table, with_claims, with_labeled
from remitlens.catalog.registry import query, r6, s6
from remitlens.constants import FILING_WINDOW_DAYS, INSURANCE_TYPES, MEDICAL_NECESSITY_PHRASES, PAYER_RESIDUAL, PRIOR_AUTH_PHRASES
from remitlens.functions import scalar as fn
from remitlens.operators import evaluate, models, support
from remitlens.operators.retrieval import VectorIndex, build_index, nearest
from remitlens.sources import tables as src
from remitlens.sources.schema import split_valid, to_record, validate_claims

DIGITS_SQL = "regexp_replace({c}, '[^0-9]', '', 'g')"


def category_sql(c: str) -> str:
    u = f"upper(trim({c}))"
    d = DIGITS_SQL.format(c=u)
    return (
        f"CASE WHEN {u} LIKE 'I%' THEN 'Cardiovascular' WHEN {u} LIKE 'E%' THEN 'Endocrine' WHEN {u} LIKE 'J%' THEN 'Respiratory' "
        f"WHEN {d} = '' THEN 'General' WHEN CAST({d} AS HUGEINT) % 3 = 0 THEN 'Cardiovascular' WHEN CAST({d} AS HUGEINT) % 3 = 1 THEN 'Endocrine' ELSE 'General' END"
    )


def signals_sql(text: str) -> str:
    low = f"lower({text})"

    def any_of(phrases):
        return "CAST(" + " OR ".join(f"contains({low}, '{p}')" for p in phrases) + " AS INT)"

    trimmed = f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"
    return (
        f"{any_of(MEDICAL_NECESSITY_PHRASES)} AS has_medical_necessity, {any_of(PRIOR_AUTH_PHRASES)} AS has_prior_auth_mention, "
        f"CAST(CASE WHEN {trimmed} = '' THEN 0 ELSE len(regexp_split_to_array({trimmed}, '\\s+')) END AS INT) AS note_length, "
        f"{any_of(['diagnosis', 'diagnoses'])} AS has_diagnosis_mention, {any_of(['procedure', 'operation'])} AS has_procedure_mention"
    )


@query("csv_source", "S1", "SELECT doc_id, trim(source) AS source, lang, CAST(length(text) AS INT) AS n, md5(text) AS digest FROM documents")
def csv_source(spark, sf):
    docs = table(spark, sf, "documents")
    path = src.scratch_path(spark, "notes-csv")
    src.write_csv(docs.select("doc_id", F.concat(F.lit("  "), "source", F.lit(" ")).alias("source"), "lang", "text"), path)
    back = src.read_csv(spark, path, "doc_id bigint, source string, lang string, text string", trim=["source"], multiline=True)
    return back.select("doc_id", "source", "lang", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("parquet_sink", "S2", with_labeled(f"SELECT insurance_type, split, count(*) AS n, {s6('avg(billed_amount)', 'mean_billed')} FROM labeled GROUP BY ALL"))
def parquet_sink(spark, sf):
    path = src.scratch_path(spark, "predictions")
    src.write_parquet(labeled_claims(spark, sf).select("claim_id", "insurance_type", "split", "billed_amount"), path, ["split"])
    return src.read_parquet(spark, path).groupBy("insurance_type", F.col("split").cast("string").alias("split")).agg(
        F.count("*").alias("n"), r6(F.avg("billed_amount"), "mean_billed")
    )


@query("csv_sink", "S3", f"SELECT doc_id, {signals_sql('text')} FROM documents")
def csv_sink(spark, sf):
    path = src.scratch_path(spark, "signals-csv")
    src.write_csv(notes(spark, sf).select("doc_id", *fn.note_signals("text")), path)
    return src.read_csv(
        spark, path,
        "doc_id bigint, has_medical_necessity int, has_prior_auth_mention int, note_length int, has_diagnosis_mention int, has_procedure_mention int",
    )


def _two_runs(spark, sf):
    """Two scores of every test claim, evaluated as two models."""
    test = labeled_claims(spark, sf).where("split = 'test'")
    rows = test.select(
        "denied",
        F.lit("audit").alias("phase"),
        F.inline(
            F.array(
                F.struct(F.lit("rule").alias("model"), F.col("true_denial_prob").alias("prob")),
                F.struct(F.lit("filing").alias("model"), (F.col("_filing_days") / 240.0).alias("prob")),
            )
        ),
    )
    return evaluate.evaluate(rows, "denied", "prob")


RUN_SQL = """, s AS (SELECT 'rule' AS model, denied, true_denial_prob AS prob FROM labeled WHERE split = 'test'
 UNION ALL SELECT 'filing', denied, filing_days / 240.0::DOUBLE FROM labeled WHERE split = 'test'),
ranked AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0::DOUBLE AS rk FROM s),
area AS (SELECT model, (sum(CASE WHEN denied = 1 THEN rk END) - sum(denied) * (sum(denied) + 1) / 2.0::DOUBLE) / (sum(denied)::DOUBLE * sum(1 - denied)) AS auroc FROM ranked GROUP BY model),
cm AS (SELECT model, sum(CASE WHEN denied = 1 AND prob >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN denied = 0 AND prob >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN denied = 1 AND prob < 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fn, count(*) AS n_samples FROM s GROUP BY model),
ev AS (SELECT 'audit' AS phase, model, auroc, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
  CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, n_samples FROM area JOIN cm USING (model))"""


@query(
    "metrics_append", "S4",
    with_labeled("SELECT run, phase, model, metric, " + s6("value", "value") + """ FROM (
      SELECT run, phase, model, unnest(['auroc', 'f1', 'precision', 'recall', 'n_samples']) AS metric,
             unnest([auroc, f1, precision, recall, n_samples::DOUBLE]) AS value FROM ev, (VALUES ('a'), ('b')) runs(run))""", RUN_SQL),
)
def metrics_append(spark, sf):
    path = src.scratch_path(spark, "metrics")
    result = _two_runs(spark, sf)
    for run in ("a", "b"):
        src.append_metrics(src.metrics_long(run, result, evaluate.METRICS), path)
    documents = src.scratch_path(spark, "metrics-json")
    src.write_metrics_json(src.read_parquet(spark, path), documents)
    return src.read_metrics_json(spark, documents).select("run", F.col("phase").cast("string").alias("phase"), "model", "metric", r6("value"))


@query("run_search", "S5", with_labeled(f"SELECT run, phase, model, {s6('auroc', 'auroc')}, {s6('f1', 'f1')}, n_samples::DOUBLE AS n_samples FROM ev, (VALUES ('a'), ('b')) runs(run)", RUN_SQL))
def run_search(spark, sf):
    """Two stored runs, searched in the metrics table."""
    path = src.scratch_path(spark, "runs")
    result = _two_runs(spark, sf)
    for run in ("a", "b"):
        src.append_metrics(src.metrics_long(run, result, evaluate.METRICS), path)
    wide = src.search_runs(src.read_parquet(spark, path), evaluate.METRICS)
    return wide.select("run", "phase", "model", r6("auroc"), r6("f1"), "n_samples")


VALID_SQL = """, dirty AS (SELECT claim_id, provider_id,
  CASE WHEN part_key % 11 = 0 THEN NULL ELSE icd10_code END AS icd10_code, cpt_code,
  CASE WHEN part_key % 7 = 0 THEN 'unlisted' ELSE insurance_type END AS insurance_type,
  CASE WHEN part_key % 5 = 0 THEN -billed_amount ELSE billed_amount END AS billed_amount,
  service_date, CASE WHEN part_key % 13 = 0 THEN service_date - 1 ELSE submission_date END AS submission_date FROM claims)"""


def _dirty_claims(spark, sf):
    """Claims with rule violations planted by part key."""
    k = F.col("_part_key")
    return scored_claims(spark, sf).withColumns(
        {
            "icd10_code": F.when(k % 11 != 0, F.col("icd10_code")),
            "insurance_type": F.when(k % 7 == 0, "unlisted").otherwise(F.col("insurance_type")),
            "billed_amount": F.when(k % 5 == 0, -F.col("billed_amount")).otherwise(F.col("billed_amount")),
            "submission_date": F.when(k % 13 == 0, F.date_sub("service_date", 1)).otherwise(F.col("submission_date")),
        }
    )


@query(
    "claim_validation", "S6",
    with_claims("""SELECT claim_id, concat_ws(',', CASE WHEN icd10_code IS NULL THEN 'missing_icd10_code' END,
      CASE WHEN insurance_type = 'unlisted' THEN 'unknown_insurance_type' END,
      CASE WHEN billed_amount < 0 THEN 'negative_billed_amount' END,
      CASE WHEN submission_date < service_date THEN 'submission_before_service' END) AS violations FROM dirty""").replace(" SELECT claim_id, concat_ws", VALID_SQL + " SELECT claim_id, concat_ws", 1),
)
def claim_validation(spark, sf):
    return validate_claims(_dirty_claims(spark, sf)).select("claim_id", F.array_join("violations", ",").alias("violations"))


@query(
    "claim_rejects", "S6",
    f"WITH {CLAIMS_SQL}{VALID_SQL}, f AS (SELECT icd10_code IS NULL OR insurance_type = 'unlisted' OR billed_amount < 0 OR submission_date < service_date AS bad FROM dirty) "
    "SELECT CASE WHEN bad THEN 'rejected' ELSE 'valid' END AS side, count(*) AS n FROM f GROUP BY ALL",
)
def claim_rejects(spark, sf):
    good, bad = split_valid(_dirty_claims(spark, sf))
    return good.select(F.lit("valid").alias("side")).unionByName(bad.select(F.lit("rejected").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query(
    "record_projection", "S7",
    with_labeled("""SELECT claim_id, provider_id, patient_id, icd10_code, cpt_code, insurance_type, billed_amount,
      service_date, submission_date, reason_code, denied = 1 AS denied FROM labeled"""),
)
def record_projection(spark, sf):
    return to_record(labeled_claims(spark, sf))


TOPK_SQL = """WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS neighbour_id,
  round(list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(i.embedding::DOUBLE[], i.embedding::DOUBLE[]))), 9) AS s,
  i.label AS label FROM embeddings q, embeddings i WHERE q.vec_id <> i.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS rank FROM p)
 SELECT query_id, CAST(rank AS INT) AS rank, neighbour_id, (round(s, 6) + 0.0::DOUBLE) AS similarity FROM r WHERE rank <= 5"""


@query("index_reload", "S8", TOPK_SQL)
def index_reload(spark, sf):
    e = table(spark, sf, "embeddings")
    path = src.scratch_path(spark, "saved-index")
    build_index(e, id_col="vec_id", vec_col="embedding", keep=6).save(path)
    hits = nearest(e, VectorIndex.load(spark, path), id_col="vec_id", vec_col="embedding", k=5, exclude_self=True)
    return hits.select("query_id", "rank", "neighbour_id", r6("similarity"))


@query("observable_columns", "P1", with_labeled("""SELECT claim_id, provider_id, patient_id, icd10_code, cpt_code, dx_category, insurance_type, billed_amount,
  service_date, submission_date, denied, reason_code FROM labeled"""))
def observable_columns(spark, sf):
    df = labeled_claims(spark, sf)
    return df.select(fn.observable_columns(df))


@query("amount_features", "P2 P3", with_claims(f"SELECT claim_id, filing_days, {s6('ln(1 + billed_amount)', 'log_billed')}, {s6('billed_amount / base_cost', 'amount_ratio')} FROM claims"))
def amount_features(spark, sf):
    return scored_claims(spark, sf).select(
        "claim_id", fn.filing_days().alias("filing_days"), r6(F.log1p("billed_amount"), "log_billed"),
        r6(fn.amount_ratio("billed_amount", "_procedure_base_cost"), "amount_ratio"),
    )


def _case(col, mapping):
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


@query("value_lookups", "P4", with_claims(
    f"SELECT insurance_type, dx_category, CAST({_case('insurance_type', FILING_WINDOW_DAYS)} AS INT) AS filing_window, CAST({_case('insurance_type', PAYER_RESIDUAL)} AS DOUBLE) AS residual, count(*) AS n FROM claims GROUP BY ALL"))
def value_lookups(spark, sf):
    return scored_claims(spark, sf).groupBy("insurance_type", "dx_category").agg(F.count("*").alias("n")).select(
        "insurance_type", "dx_category", fn.lookup("insurance_type", FILING_WINDOW_DAYS).alias("filing_window"),
        fn.lookup("insurance_type", PAYER_RESIDUAL).alias("residual"), "n",
    )


@query("code_category", "P5", f"""WITH codes AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN concat(' j', p_size, '.9') WHEN 2 THEN concat('i', p_size) ELSE p_brand END AS code FROM part)
  SELECT p_partkey, code, {category_sql('code')} AS category FROM codes""")
def code_category(spark, sf):
    k = F.col("p_partkey") % 4
    code = (
        F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lit(" j"), F.col("p_size").cast("string"), F.lit(".9")))
        .when(k == 2, F.concat(F.lit("i"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    )
    return table(spark, sf, "part").select("p_partkey", code.alias("code")).withColumn("category", fn.code_category("code"))


SOURCE_CATEGORY = {f"src{i}": ["Cardiovascular", "Endocrine", "General"][i % 3] for i in range(15)}


@query("note_filter", "P6", f"""WITH n AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS transcription,
   CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS description FROM documents)
  SELECT doc_id, CASE source {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_CATEGORY.items())} END AS diagnosis_category, md5(coalesce(transcription, description)) AS digest
  FROM n WHERE source IN ({', '.join(f"'{k}'" for k in SOURCE_CATEGORY)}) AND coalesce(transcription, description) IS NOT NULL""")
def note_filter(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", "source", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("transcription"),
        F.when(F.col("doc_id") % 6 != 0, F.col("lang")).alias("description"),
    )
    return src.filter_notes(rows, SOURCE_CATEGORY, "source").select("doc_id", "diagnosis_category", F.md5("discharge_note").alias("digest"))


@query("note_signals", "P7", f"SELECT doc_id, {signals_sql('text')} FROM documents")
def note_signals(spark, sf):
    return notes(spark, sf).select("doc_id", *fn.note_signals("text"))


@query("code_pair_text", "P8", with_claims("SELECT concat_ws(' ', cpt_code, icd10_code) AS claim_text, count(*) AS n FROM claims GROUP BY ALL"))
def code_pair_text(spark, sf):
    return scored_claims(spark, sf).groupBy(fn.code_pair_text("cpt_code", "icd10_code").alias("claim_text")).agg(F.count("*").alias("n"))


@query("calendar_parts", "P9", with_claims("""SELECT CAST(month(service_date) AS INT) AS service_month, CAST(isodow(service_date) - 1 AS INT) AS service_dayofweek, count(*) AS n FROM claims GROUP BY ALL"""))
def calendar_parts(spark, sf):
    parts = scored_claims(spark, sf).select(*fn.calendar_parts("service_date"))
    return parts.groupBy("service_month", "service_dayofweek").agg(F.count("*").alias("n"))


@query("risk_bands", "P10 P11 P12", with_claims(f"""SELECT claim_id, {s6('1 / (1 + exp(-(base_logodds - 4)))', 'prob')}, {s6('least(greatest(amount_ratio - 1.6, 0), 1)', 'excess')},
   CASE WHEN 1 / (1 + exp(-(base_logodds - 4))) >= 0.5 THEN 'HIGH' WHEN 1 / (1 + exp(-(base_logodds - 4))) >= 0.25 THEN 'ELEVATED' ELSE 'LOW' END AS band FROM scored"""))
def risk_bands(spark, sf):
    p = fn.sigmoid(F.col("base_logodds") - 4.0)
    return scored_claims(spark, sf).select(
        "claim_id", r6(p, "prob"), r6(fn.clip(F.col("_amount_ratio") - 1.6, 0.0, 1.0), "excess"), fn.risk_band(p).alias("band")
    )


@query("drift_flags", "P13", with_claims("SELECT claim_id, CASE WHEN abs(amount_ratio - 1) > 0.25 THEN 'major' WHEN abs(amount_ratio - 1) > 0.1 THEN 'moderate' ELSE 'negligible' END AS flag FROM claims"))
def drift_flags(spark, sf):
    return scored_claims(spark, sf).select("claim_id", fn.drift_flag(F.abs(F.col("_amount_ratio") - 1)).alias("flag"))


@query("threshold_predictions", "P14", with_labeled("SELECT claim_id, CAST(true_denial_prob >= 0.5 AS INT) AS flagged, CAST(true_denial_prob >= 0.07::DOUBLE AS INT) AS flagged_cheap FROM labeled"))
def threshold_predictions(spark, sf):
    return labeled_claims(spark, sf).select(
        "claim_id", fn.predict_at("true_denial_prob").alias("flagged"), fn.predict_at("true_denial_prob", 0.07).alias("flagged_cheap")
    )


@query("response_parse", "P15", """WITH a AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
  SELECT event_id, CASE WHEN event_id % 3 = 2 OR k % 10 = 0 OR k % 10 = 1 THEN 0.5::DOUBLE ELSE least(greatest(k / 50.0::DOUBLE - 0.2::DOUBLE, 0), 1) END AS prob FROM a""")
def response_parse(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf, "events").withColumn("k", k)
    body = (
        F.when(F.col("k") % 10 == 0, F.lit("not json {"))
        .when(F.col("k") % 10 == 1, F.lit('{"denied": true}'))
        .otherwise(F.concat(F.lit('{"denial_probability": '), (F.col("k") / 50.0 - 0.2).cast("string"), F.lit(', "denied": false}')))
    )
    answers = events.where(F.col("event_id") % 3 != 2).select(F.concat(F.lit("note-"), F.col("event_id").cast("string")).alias("custom_id"), body.alias("body"))
    return support.attach_responses(events.select("event_id"), answers, "event_id")


@query("highest_risk_claims", "P17", with_labeled(f"SELECT claim_id, provider_id, {s6('true_denial_prob', 'prob')} FROM (SELECT * FROM labeled WHERE split = 'test' ORDER BY true_denial_prob DESC, claim_id LIMIT 200)"))
def highest_risk_claims(spark, sf):
    test = labeled_claims(spark, sf).where("split = 'test'")
    return support.highest_risk(test, "true_denial_prob").select("claim_id", "provider_id", r6("true_denial_prob", "prob"))


@query("distinct_codes", "P18", with_claims("SELECT DISTINCT icd10_code FROM claims"))
def distinct_codes(spark, sf):
    return scored_claims(spark, sf).select("icd10_code").distinct().orderBy("icd10_code")


@query("value_counts", "P18", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def value_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(15)


@query("describe_signals", "P18", f"""WITH s AS (SELECT {signals_sql('text')} FROM documents)
  SELECT count(*) AS n, {s6('avg(note_length)', 'mean')}, {s6('stddev_samp(note_length)', 'std')}, CAST(min(note_length) AS INT) AS low, CAST(max(note_length) AS INT) AS high FROM s""")
def describe_signals(spark, sf):
    s = notes(spark, sf).select(*fn.note_signals("text"))
    return s.agg(
        F.count("*").alias("n"), r6(F.avg("note_length"), "mean"), r6(F.stddev_samp("note_length"), "std"),
        F.min("note_length").alias("low"), F.max("note_length").alias("high"),
    )

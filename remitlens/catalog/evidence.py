"""Evidence completeness (V) and its evaluation (E11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitlens.catalog.claims import notes, table
from remitlens.catalog.registry import query, r6, s6
from remitlens.catalog.text import DIM, tokens_sql
from remitlens.constants import ACTION_BY_STATUS, DENSE_THRESHOLD, EXPLANATIONS, LEXICAL_THRESHOLD, POLICIES
from remitlens.functions.text import sentences
from remitlens.operators import evaluate
from remitlens.operators import evidence as ev
from remitlens.session import stage


def evidence_cases(spark, sf):
    """A case per document: its sentences as the record, the first as the packet, a benchmark item as the requirement."""
    items = table(spark, sf, "benchmark")
    n = items.count()
    docs = notes(spark, sf).select("doc_id", sentences("text").alias("full_record_chunks"))
    labels = table(spark, sf, "labels")
    gold = F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 1, "complete").otherwise("omitted")
    return (
        docs.join(items.withColumnRenamed("text", "requirement_text"), F.col("doc_id") % n == F.col("item_id"))
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("case_id"), F.concat(F.lit("R"), F.col("item_id").cast("string")).alias("req_id"), "requirement_text",
            "full_record_chunks", F.slice("full_record_chunks", 1, 1).alias("submitted_chunks"), gold.alias("gold_variant"),
        )
    )


CASES = """cases AS (SELECT d.doc_id AS case_id, concat('R', item_id) AS req_id, b.text AS requirement_text, chunks AS full_chunks, list_slice(chunks, 1, 1) AS sub_chunks,
   CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'complete' ELSE 'omitted' END AS gold_variant
   FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS chunks FROM documents) d
   JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
 corpus AS (SELECT DISTINCT t FROM (SELECT requirement_text AS t FROM cases UNION ALL SELECT unnest(full_chunks) FROM cases))"""
LEXICAL = CASES + f""", occ AS (SELECT t, unnest({tokens_sql('t')}) AS term FROM corpus),
 tf AS (SELECT t, term, count(*) AS n FROM occ GROUP BY ALL),
 idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tf GROUP BY term),
 raw AS (SELECT t, term, n * idf AS w FROM tf JOIN idf USING (term)),
 wt AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM raw),"""
DENSE = CASES + f""", occ AS (SELECT t, unnest({tokens_sql('t')}) AS term FROM corpus),
 raw AS (SELECT t, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS term, count(*)::DOUBLE AS w FROM occ GROUP BY ALL),
 wt AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM raw),"""
_SPARSE_DOTS = "SELECT k.q, k.c, sum(a.w * b.w) AS dot FROM {p}keys k JOIN {p}wt a ON a.t = k.q JOIN {p}wt b ON b.t = k.c AND b.term = a.term GROUP BY ALL"
_DENSE_DOTS = (
    "SELECT k.q, k.c, list_inner_product(a.v, b.v) AS dot FROM {p}keys k JOIN {p}dv a ON a.t = k.q JOIN {p}dv b ON b.t = k.c"
)


def _dense_cte(prefix: str) -> str:
    """Weights by slot as one list per text."""
    return f""" {prefix}dv AS (SELECT t, list_transform(range({DIM}), lambda i: coalesce(list_extract(ws, list_position(slots, i)), 0.0::DOUBLE)) AS v
   FROM (SELECT t, list(term ORDER BY term) AS slots, list(w ORDER BY term) AS ws FROM {prefix}wt GROUP BY t)),"""


def _match(prefix: str, threshold: float, dots: str = _SPARSE_DOTS) -> str:
    """CTEs from weights ``wt`` to ``cl``, the classified cases."""
    return f""" {prefix}pairs AS (SELECT case_id, requirement_text AS q, 'rec' AS side, unnest(full_chunks) AS c, unnest(range(len(full_chunks))) AS pos FROM cases
   UNION ALL SELECT case_id, requirement_text, 'sub', unnest(sub_chunks), unnest(range(len(sub_chunks))) FROM cases),
 {prefix}keys AS (SELECT DISTINCT q, c FROM {prefix}pairs),
 {prefix}dots AS ({dots.format(p=prefix)}),
 {prefix}sc AS (SELECT p.*, round(coalesce(dot, 0.0::DOUBLE) / DEN, 9) AS s FROM {prefix}pairs p LEFT JOIN {prefix}dots d ON d.q = p.q AND d.c = p.c),
 {prefix}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, side ORDER BY s DESC, pos) AS r FROM {prefix}sc) WHERE r = 1),
 {prefix}cl AS (SELECT cases.case_id, req_id, requirement_text, gold_variant, coalesce(b.s, 0) AS sub_raw, coalesce(a.s, 0) AS rec_raw, b.c AS sub_chunk, a.c AS rec_chunk,
   CASE WHEN coalesce(b.s, 0) >= {threshold}::DOUBLE THEN 'complete' WHEN coalesce(a.s, 0) >= {threshold}::DOUBLE THEN 'omitted' ELSE 'unsupported' END AS predicted_status
   FROM cases LEFT JOIN {prefix}best a ON a.case_id = cases.case_id AND a.side = 'rec' LEFT JOIN {prefix}best b ON b.case_id = cases.case_id AND b.side = 'sub')"""


LEX_CL = "WITH " + LEXICAL + _match("", LEXICAL_THRESHOLD).replace("DEN", "((1.0::DOUBLE + 1e-9::DOUBLE) * (1.0::DOUBLE + 1e-9::DOUBLE))")
DENSE_CL = "WITH " + DENSE + _dense_cte("") + _match("", DENSE_THRESHOLD, _DENSE_DOTS).replace("DEN", "1.0::DOUBLE")
_CITED = "CASE predicted_status WHEN 'complete' THEN sub_chunk WHEN 'omitted' THEN rec_chunk END"
_CLASSIFIED = f" SELECT case_id, req_id, gold_variant, predicted_status, (round(sub_raw, 3) + 0.0::DOUBLE) AS sub_score, (round(rec_raw, 3) + 0.0::DOUBLE) AS rec_score, {_CITED} AS cited_chunk FROM cl"


@query("evidence_corpus", "V1", "WITH " + CASES + " SELECT md5(t) AS text_key, CAST(length(t) AS INT) AS n FROM corpus")
def evidence_corpus(spark, sf):
    return ev.case_texts(evidence_cases(spark, sf)).select("text_key", F.length("text").alias("n"))


@query("evidence_best_match", "V2", LEX_CL + f" SELECT case_id, CASE side WHEN 'rec' THEN 'record' ELSE 'submitted' END AS side, c AS chunk, {s6('s', 'score')} FROM best")
def evidence_best_match(spark, sf):
    out = ev.lexical_matches(stage(evidence_cases(spark, sf), "cases"))
    return out.select("case_id", "side", "chunk", r6("score"))


@query("evidence_status_lexical", "V3", LEX_CL + _CLASSIFIED)
def evidence_status_lexical(spark, sf):
    return ev.classify_lexical(evidence_cases(spark, sf)).drop("requirement_text")


@query("evidence_status_dense", "V3 T5", DENSE_CL + _CLASSIFIED)
def evidence_status_dense(spark, sf):
    return ev.classify_dense(evidence_cases(spark, sf)).drop("requirement_text")


def policies(spark, sf):
    """Nested policies: the known ones, and one per ten benchmark items with the items as its requirements."""
    items = table(spark, sf, "benchmark").where("text IS NOT NULL")
    number = F.floor(F.col("item_id") / 10).cast("string")
    own = items.groupBy(F.concat(F.lit("B"), number).alias("policy_id")).agg(
        F.lit("benchmark").alias("family"), F.lit("benchmark").alias("source"),
        F.array_sort(F.collect_list(F.struct(F.concat(F.lit("B-"), F.col("item_id").cast("string")).alias("req_id"), "text"))).alias("requirements"),
    )
    return ev.policy_table(spark).unionByName(own)


def _policies_sql() -> str:
    known = ", ".join(f"('{p['policy_id']}', '{p['family']}', '{i}', '{t}')" for p in POLICIES for i, t in p["requirements"])
    return f"""reqs AS (SELECT * FROM (VALUES {known}) v(policy_id, family, req_id, t) UNION ALL SELECT concat('B', item_id // 10), 'benchmark', concat('B-', item_id), text FROM benchmark),
 recs AS (SELECT DISTINCT t FROM (SELECT unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')) AS t FROM documents)),
 corpus AS (SELECT t FROM reqs UNION SELECT t FROM recs), occ AS (SELECT t, unnest({tokens_sql('t')}) AS term FROM corpus),
 tf AS (SELECT t, term, count(*) AS n FROM occ GROUP BY ALL),
 idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tf GROUP BY term),
 raw AS (SELECT t, term, n * idf AS w FROM tf JOIN idf USING (term)), wt AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM raw),
 hits AS (SELECT a.t AS q, b.t AS c, round(sum(a.w * b.w), 9) AS s FROM wt a JOIN wt b USING (term) WHERE a.t IN (SELECT t FROM reqs) AND b.t IN (SELECT t FROM recs) GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= {LEXICAL_THRESHOLD}::DOUBLE)"""


@query("policy_requirements", "V4", "WITH " + _policies_sql() + f""" SELECT policy_id, family, req_id, count(*) AS n_chunks, {s6('max(s)', 'best_score')}, {s6('sum(s)', 'total_score')}
 FROM reqs JOIN hits ON hits.q = reqs.t GROUP BY policy_id, family, req_id""")
def policy_requirements(spark, sf):
    """Requirements of nested policies against every chunk of every record."""
    chunks = notes(spark, sf).select(F.explode(sentences("text")).alias("chunk"))
    found = ev.requirement_matches(ev.requirement_rows(policies(spark, sf)), chunks)
    return found.groupBy("policy_id", "family", "req_id").agg(F.count("*").alias("n_chunks"), r6(F.max("score"), "best_score"), r6(F.sum("score"), "total_score"))


_ACT = "CASE predicted_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTION_BY_STATUS.items()) + " END"
_SHOWN = "printf('%.2f', CASE WHEN predicted_status = 'complete' THEN round(sub_raw, 3) ELSE round(rec_raw, 3) END)"


@query("deficiency_report", "V5", LEX_CL + f""" SELECT case_id, req_id, predicted_status AS status, {_CITED} AS cited_chunk, {_ACT} AS suggested_action,
  CASE WHEN predicted_status = 'complete' THEN (round(sub_raw, 3) + 0.0::DOUBLE) ELSE (round(rec_raw, 3) + 0.0::DOUBLE) END AS confidence, length(requirement_text)::BIGINT AS n_requirement FROM cl""")
def deficiency_report(spark, sf):
    report = ev.deficiency_report(ev.classify_lexical(evidence_cases(spark, sf)))
    return report.select("case_id", "req_id", "status", "cited_chunk", "suggested_action", "confidence", F.length("requirement_text").cast("long").alias("n_requirement"))


def _explained(status: str) -> str:
    fields = {"$requirement": "requirement_text", "$confidence": _SHOWN, "$chunk": f"({_CITED})"}
    quoted = [fields.get(part) or "'" + part.replace("'", "''") + "'" for part in EXPLANATIONS[status]]
    return " || ".join(quoted)


@query("deficiency_rationale", "V5 K3", LEX_CL + f""" SELECT case_id, predicted_status AS status, CASE predicted_status WHEN 'complete' THEN {_explained('complete')}
  WHEN 'omitted' THEN {_explained('omitted')} ELSE {_explained('unsupported')} END AS rationale FROM cl""")
def deficiency_rationale(spark, sf):
    return ev.deficiency_report(ev.classify_lexical(evidence_cases(spark, sf))).select("case_id", "status", "rationale")


_BOTH = ("WITH " + LEXICAL + _match("", LEXICAL_THRESHOLD).replace("DEN", "((1.0::DOUBLE + 1e-9::DOUBLE) * (1.0::DOUBLE + 1e-9::DOUBLE))")
    + f""", draw AS (SELECT t, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS term, count(*)::DOUBLE AS w FROM occ GROUP BY ALL),
 d_wt AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM draw),""" + _dense_cte("d_") + _match("d_", DENSE_THRESHOLD, _DENSE_DOTS).replace("DEN", "1.0::DOUBLE"))


@query("evidence_methods", "V6", _BOTH + """ SELECT cl.case_id, cl.gold_variant, cl.predicted_status AS lexical_status, (round(cl.rec_raw, 3) + 0.0::DOUBLE) AS lexical_score, d.predicted_status AS dense_status,
   (round(d.rec_raw, 3) + 0.0::DOUBLE) AS dense_score, CAST(cl.predicted_status = cl.gold_variant AS INT) AS lexical_correct, CAST(d.predicted_status = cl.gold_variant AS INT) AS dense_correct
   FROM cl JOIN d_cl d ON d.case_id = cl.case_id""")
def evidence_methods(spark, sf):
    cases = evidence_cases(spark, sf)
    return ev.compare_methods(ev.classify_lexical(cases), ev.classify_dense(cases))


@query("chunk_membership", "P16", "WITH " + CASES + """ SELECT case_id, CAST(pos AS INT) AS pos, CASE WHEN list_contains(sub_chunks, chunk) THEN 'submitted' ELSE 'not submitted' END AS membership FROM (
   SELECT case_id, sub_chunks, unnest(full_chunks) AS chunk, unnest(range(len(full_chunks))) AS pos FROM cases)""")
def chunk_membership(spark, sf):
    return ev.chunk_membership(evidence_cases(spark, sf)).select("case_id", "pos", "membership")


@query("evidence_confusion", "E11", LEX_CL + """ SELECT gold_variant, count(*) FILTER (predicted_status = 'complete') AS complete, count(*) FILTER (predicted_status = 'omitted') AS omitted,
   count(*) FILTER (predicted_status = 'unsupported') AS unsupported FROM cl GROUP BY gold_variant""")
def evidence_confusion(spark, sf):
    return evaluate.status_confusion(ev.classify_lexical(evidence_cases(spark, sf)), "gold_variant", "predicted_status", ev.CLASSES)


@query("evidence_accuracy", "E11", LEX_CL + f" SELECT {s6('avg(CAST(gold_variant = predicted_status AS INT))', 'accuracy')}, count(*) AS n FROM cl")
def evidence_accuracy(spark, sf):
    return ev.accuracy(ev.classify_lexical(evidence_cases(spark, sf)), "gold_variant", "predicted_status").select(r6("accuracy"), "n")


@query("evidence_score_histogram", "E12", DENSE_CL + f""" SELECT present, bin, count(*) AS n, any_value(m) AS group_mean FROM (
   SELECT gold_variant <> 'unsupported' AS present, CAST(least(floor(round(rec_raw, 3) * 25), 24) AS INT) AS bin, (round(avg(round(rec_raw, 3)) OVER (PARTITION BY gold_variant <> 'unsupported'), 6) + 0.0::DOUBLE) AS m FROM cl) GROUP BY present, bin""")
def evidence_score_histogram(spark, sf):
    classified = ev.classify_dense(evidence_cases(spark, sf)).withColumn("present", F.col("gold_variant") != "unsupported")
    out = evaluate.score_histogram(classified, "rec_score", "present")
    return out.select("present", "bin", "n", r6("group_mean"))

"""Term tables, TF-IDF and encoding jobs (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitlens.catalog.claims import notes, scored_claims, with_claims
from remitlens.catalog.registry import query, r6, s6
from remitlens.constants import STOP_WORDS
from remitlens.functions.scalar import code_pair_text
from remitlens.operators import text as tx

DIM = 256
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP_SQL}, w))"


def terms_cte(rows: str, id_col: str, text: str) -> str:
    """CTE ``trm``: one row per uni- and bigram occurrence of ``rows``."""
    return f"""tok AS (SELECT {id_col}, {tokens_sql(text)} AS w FROM {rows}),
 trm AS (SELECT {id_col}, unnest(w) AS term FROM tok UNION ALL
   SELECT {id_col}, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM tok WHERE len(w) > 1)"""


def vocab_cte(rows: str, id_col: str, min_df: int, top: int) -> str:
    return f"""voc AS (SELECT term, count(DISTINCT {id_col}) AS doc_freq, count(*) AS total,
   ln((1.0::DOUBLE + (SELECT count(*) FROM {rows})) / (1.0::DOUBLE + count(DISTINCT {id_col}))) + 1.0::DOUBLE AS idf
   FROM trm GROUP BY term HAVING count(DISTINCT {id_col}) >= {min_df} ORDER BY total DESC, term LIMIT {top})"""


def weights_select(id_col: str) -> str:
    return f"""cnt AS (SELECT {id_col}, term, count(*) * any_value(idf) AS w FROM trm JOIN voc USING (term) GROUP BY ALL)
 SELECT {id_col}, term, (round(w / sqrt(sum(w * w) OVER (PARTITION BY {id_col})), 6) + 0.0::DOUBLE) AS weight FROM cnt"""


_DOCS = "WITH " + terms_cte("documents", "doc_id", "text") + ", " + vocab_cte("documents", "doc_id", 5, 400)


@query("term_table", "T1 T2", _DOCS + f" SELECT term, doc_freq, total, {s6('idf', 'idf')} FROM voc")
def term_table(spark, sf):
    return tx.term_table(notes(spark, sf), "text").select("term", "doc_freq", "total", r6("idf"))


@query("tfidf_weights", "T1 T2", _DOCS + ", " + weights_select("doc_id"))
def tfidf_weights(spark, sf):
    docs = notes(spark, sf)
    vocab = tx.term_table(docs, "text")
    return tx.tfidf_weights(docs, "doc_id", "text", vocab, bounded=True).select("doc_id", "term", r6("weight"))


@query("tfidf_unseen_notes", "T1", "WITH " + terms_cte("(SELECT doc_id, text FROM documents WHERE doc_id % 4 <> 3)", "doc_id", "text").replace("trm AS", "trm0 AS").replace("tok", "tok0")
    + ", " + vocab_cte("(SELECT doc_id FROM documents WHERE doc_id % 4 <> 3)", "doc_id", 5, 400).replace("FROM trm ", "FROM trm0 ") + ", "
    + terms_cte("(SELECT doc_id, text FROM documents WHERE doc_id % 4 = 3)", "doc_id", "text") + ", " + weights_select("doc_id"))
def tfidf_unseen_notes(spark, sf):
    """Vocabulary fitted on the training notes, weights of the held-out notes."""
    docs = notes(spark, sf)
    vocab = tx.term_table(docs.where("doc_id % 4 <> 3"), "text")
    return tx.tfidf_weights(docs.where("doc_id % 4 = 3"), "doc_id", "text", vocab, bounded=True).select("doc_id", "term", r6("weight"))


_PAIR = with_claims("x").rsplit(" x", 1)[0] + ", pr AS (SELECT claim_id, concat_ws(' ', cpt_code, icd10_code) AS t FROM claims), " + terms_cte("pr", "claim_id", "t") + """,
 voc AS (SELECT term, count(DISTINCT claim_id) AS doc_freq, count(*) AS total, ln((1.0::DOUBLE + (SELECT count(*) FROM pr)) / (1.0::DOUBLE + count(DISTINCT claim_id))) + 1.0::DOUBLE AS idf
   FROM trm WHERE NOT contains(term, ' ') GROUP BY term ORDER BY total DESC, term LIMIT 50), cnt AS (SELECT claim_id, term, count(*) * any_value(idf) AS w FROM trm JOIN voc USING (term) GROUP BY ALL)
 SELECT claim_id, term, (round(w / sqrt(sum(w * w) OVER (PARTITION BY claim_id)), 6) + 0.0::DOUBLE) AS weight FROM cnt"""


@query("code_pair_tfidf", "T3", _PAIR)
def code_pair_tfidf(spark, sf):
    pairs = scored_claims(spark, sf).select("claim_id", code_pair_text("cpt_code", "icd10_code").alias("claim_text"))
    options = {"ngrams": (1, 1)}
    vocab = tx.term_table(pairs, "claim_text", min_df=1, max_features=50, **options)
    return tx.tfidf_weights(pairs, "claim_id", "claim_text", vocab, bounded=True, **options).select("claim_id", "term", r6("weight"))


@query("hashed_note_vectors", "T4", f"""WITH tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM documents),
  b AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} AS INT) AS slot, count(*)::DOUBLE AS n FROM tok GROUP BY ALL)
  SELECT doc_id, slot, (round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) + 0.0::DOUBLE) AS x FROM b""")
def hashed_note_vectors(spark, sf):
    v = tx.hashed_vectors(notes(spark, sf), "text", DIM)
    return v.select("doc_id", F.posexplode("vector").alias("slot", "x")).where("x <> 0").select("doc_id", "slot", r6("x"))


def _length_encoder():
    """A stand-in for an injected model: two numbers per text."""
    import numpy as np

    return lambda texts: np.array([[float(len(t)), float(t.count(" "))] for t in texts])


@query("injected_encoder", "T4", "SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents")
def injected_encoder(spark, sf):
    v = tx.encode_notes(notes(spark, sf), "doc_id", "text", _length_encoder)
    return v.select("doc_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("blanks"))


@query("encode_distinct_notes", "T5", "SELECT doc_id, length(text)::DOUBLE AS chars, md5(text) AS text_key FROM documents")
def encode_distinct_notes(spark, sf):
    encode = lambda t: tx.encode_notes(t, "text_key", "text", _length_encoder)
    return tx.encode_distinct(notes(spark, sf), "text", encode).select("doc_id", F.col("vector")[0].alias("chars"), "text_key")


@query("text_reuse", "T5", "SELECT count(text) AS n_texts, count(DISTINCT text) AS n_distinct, count(text) - count(DISTINCT text) AS n_reused FROM documents")
def text_reuse(spark, sf):
    return tx.text_reuse(notes(spark, sf), "text")


@query("blank_note_vectors", "T6 T7", "SELECT doc_id, 0::BIGINT AS n_terms FROM documents")
def blank_note_vectors(spark, sf):
    """Blank notes through the fitted encoder chosen by name: no term survives."""
    docs = notes(spark, sf)
    encoder = tx.text_encoder("tfidf").fit(docs, "text")
    blank = encoder.transform(tx.blank_notes(docs, "text"), "doc_id", "text")
    from pyspark.ml.functions import vector_to_array

    return blank.select("doc_id", F.size(F.filter(vector_to_array("text_features"), lambda x: x != 0)).cast("long").alias("n_terms"))

"""Requirement-level evidence: best matching chunk, completeness status, reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.constants import ACTION_BY_STATUS, DENSE_THRESHOLD, EXPLANATIONS, LEXICAL_THRESHOLD, POLICIES, STOP_WORDS
from remitlens.functions.scalar import lookup, two_digits
from remitlens.functions.text import flagged, text_key, tokens
from remitlens.operators.cosine_join import cosine_join, term_cells
from remitlens.operators.text import hash_slots, hashed_vectors, slot_matrix
from remitlens.session import small_rows, stage

CLASSES = ["complete", "omitted", "unsupported"]
SMALL = 1e-9
#: Requirement vectors that may be broadcast.
MAX_REQUIREMENTS = 10_000
#: Terms of all requirements that may travel with the tasks that score chunks.
MAX_CELLS = 1_000_000
#: Terms whose weights are broadcast, the most frequent ones.
MAX_FREQUENT = 200_000
#: Products, and scores, of one block of chunks.
BLOCK_CELLS = 1 << 21
POLICY_SCHEMA = "policy_id string, family string, source string, requirements array<struct<req_id:string,text:string>>"


def policy_table(spark: SparkSession, policies: Sequence[dict] = POLICIES) -> DataFrame:
    return spark.createDataFrame([(p["policy_id"], p["family"], p["source"], p["requirements"]) for p in policies], POLICY_SCHEMA)


def requirement_rows(policies: DataFrame) -> DataFrame:
    """One row per requirement of nested policies."""
    return policies.select("policy_id", "family", "source", F.inline("requirements")).withColumnRenamed("text", "requirement_text")


def requirement_matches(requirements: DataFrame, chunks: DataFrame, threshold: float = LEXICAL_THRESHOLD, chunk: str = "chunk", stop_words: Sequence[str] | str = STOP_WORDS) -> DataFrame:
    """Every requirement with each distinct record chunk that reaches the threshold.

    Returns the columns of ``requirements`` (rows as of ``requirement_rows``) with chunk and score, exactly:
    no requirement is tied to a case beforehand, and none is compared with chunks that cannot reach the
    threshold. Term weights are fitted over the distinct texts of both sides. Requirements without a
    match have no row.
    """
    if threshold <= 0:
        raise ValueError("threshold: a pair without common terms has similarity 0 and is never listed")
    both = requirements.select(F.col("requirement_text").alias("text"), F.lit(True).alias("asked")).unionByName(chunks.select(F.col(chunk).alias("text"), F.lit(False).alias("asked")))
    distinct = both.where(F.col("text").isNotNull()).groupBy("text").agg(F.max("asked").alias("asked"), F.min("asked").alias("_no_record"))
    # Numbers are shorter than digests; they are written with the texts.
    texts = stage(distinct.withColumn("text_key", F.monotonically_increasing_id()), "requirement-texts")
    records, keyed = texts.where(~F.col("_no_record")), requirements.withColumn("left_key", text_key("requirement_text"))
    idf, norms = _corpus_weights(texts, texts, stop_words)
    cells = stage(_term_counts(texts.where("asked"), stop_words).join(idf, "term").join(norms, "text_key").select("text_key", "term", (F.col("tf") * F.col("idf") / F.col("norm") * F.col("idf")).alias("w")), "requirement-cells")
    if cells.count() > MAX_CELLS:
        return _joined_matches(keyed, texts, records, threshold, stop_words)
    held = small_rows(cells, MAX_CELLS, "terms of requirements")
    names = sorted({r["text_key"] for r in held})
    found = _scored(records.join(norms, "text_key"), held, names, threshold, stop_words)
    listed = requirements.sparkSession.createDataFrame(list(enumerate(names)), "left int, text_key long")
    listed = listed.join(texts.where("asked").select("text_key", text_key("text").alias("left_key")), "text_key").drop("text_key")
    return _few(stage(keyed.join(listed, "left_key"), "requirements")).join(found, "left").drop("left", "left_key")


def _scored(chunks: DataFrame, cells: Sequence, names: Sequence[str], threshold: float, stop_words: Sequence[str] | str) -> DataFrame:
    """(left, chunk, score) of every chunk (text_key, text, norm) and requirement (its number in ``names``) at the threshold.

    ``cells`` are the requirements' weights per occurrence of a term in a chunk, but for the chunk's norm. They travel with the
    tasks, so that scores below the threshold exist only inside a block.
    """
    terms, number = {t: i for i, t in enumerate(sorted({r["term"] for r in cells}))}, {k: i for i, k in enumerate(names)}
    order = sorted((terms[r["term"]], number[r["text_key"]], r["w"]) for r in cells)
    slot, left, weight = (np.array([c[i] for c in order], t) for i, t in enumerate((np.int64, np.int64, float)))
    starts = np.searchsorted(slot, np.arange(len(terms) + 1))
    shared = chunks.sparkSession.sparkContext.broadcast((terms, starts, left, weight))

    @F.pandas_udf("left array<int>, score array<double>")
    def score(words: pd.Series, norm: pd.Series) -> pd.DataFrame:
        terms, starts, left, weight = shared.value
        width, norms = len(names), norm.to_numpy()
        slots = np.array([terms.get(t, -1) for found in words for t in found], np.int64)
        rows = np.repeat(np.arange(len(words)), words.map(len).to_numpy(np.int64))
        # One entry a chunk and term, with its count.
        code, tf = np.unique((rows * len(terms) + slots)[slots >= 0], return_counts=True)
        rows, slots = code // max(1, len(terms)), code % max(1, len(terms))
        sizes = starts[slots + 1] - starts[slots]
        ends, work = np.searchsorted(rows, np.arange(len(words)), side="right"), np.r_[0, np.cumsum(sizes)]
        lefts, scores, a = [], [], 0
        while a < len(words):
            first = ends[a - 1] if a else 0
            b = min(int(np.searchsorted(work[ends], work[first] + BLOCK_CELLS, side="right")), a + max(1, BLOCK_CELLS // max(1, width)), len(words))
            b = max(b, a + 1)
            own = slice(first, ends[b - 1])
            many = sizes[own]
            at = np.repeat(starts[slots[own]] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            place = np.repeat((rows[own] - a) * width, many) + left[at]
            dots = np.bincount(place, np.repeat(tf[own], many) * weight[at], (b - a) * width).reshape(b - a, width)
            dots = np.round(dots / norms[a:b, None], 9)
            r, c = np.nonzero(dots >= threshold)
            cuts = np.searchsorted(r, np.arange(1, b - a))
            lefts += np.split(c.astype(np.int32), cuts)
            scores += np.split(dots[r, c], cuts)
            a = b
        return pd.DataFrame({"left": pd.Series(lefts, dtype=object), "score": pd.Series(scores, dtype=object)})

    scored = chunks.select(F.col("text").alias("chunk"), score(tokens("text", stop_words), "norm").alias("_s"))
    return scored.select("chunk", F.inline(F.arrays_zip(F.col("_s.left").alias("left"), F.col("_s.score").alias("score")))).select("left", "chunk", "score")


def _joined_matches(keyed: DataFrame, texts: DataFrame, records: DataFrame, threshold: float, stop_words: Sequence[str] | str) -> DataFrame:
    """Matches of very many requirements, by a join on terms."""
    cells = stage(term_cells(texts, "text", stop_words), "requirement-cells")
    sides = [cells.join(side.select(text_key("text").alias("text_key")), "text_key", "left_semi") for side in (texts.where("asked"), records)]
    found = stage(cosine_join(*sides, threshold), "requirement-pairs")
    shown = found.join(records.select(text_key("text").alias("right_key"), F.col("text").alias("chunk")), "right_key")
    return keyed.join(shown.select("left_key", "chunk", F.col("similarity").alias("score")), "left_key").drop("left_key")


def case_texts(cases: DataFrame) -> DataFrame:
    """Distinct requirement and record texts: the corpus the term weights are fitted on."""
    long = cases.select(F.explode(F.concat(F.array("requirement_text"), F.coalesce("full_record_chunks", F.array().cast("array<string>")))).alias("text"))
    return long.where(F.col("text").isNotNull()).groupBy(text_key("text").alias("text_key")).agg(F.first("text").alias("text"))


def _all_texts(cases: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    long = cases.select(
        F.explode(F.concat(F.array("requirement_text"), F.coalesce("full_record_chunks", none), F.coalesce("submitted_chunks", none))).alias("text")
    )
    return long.where(F.col("text").isNotNull()).groupBy(text_key("text").alias("text_key")).agg(F.first("text").alias("text"))


def _term_counts(texts: DataFrame, stop_words: Sequence[str] | str) -> DataFrame:
    """(text_key, term, tf): runs of a text's sorted tokens, counted in the row."""
    sorted_ = texts.select("text_key", F.sort_array(tokens("text", stop_words)).alias("_t"))
    starts = F.filter(F.transform("_t", lambda x, i: F.when((i == 0) | (x != F.get(F.col("_t"), i - 1)), i)), lambda i: i.isNotNull())
    runs = F.transform("_s", lambda s, j: F.struct(F.get(F.col("_t"), s).alias("term"), (F.coalesce(F.get(F.col("_s"), j + 1), F.size("_t")) - s).alias("tf")))
    return sorted_.withColumn("_s", starts).select("text_key", F.inline(runs))


def lexical_weights(cases: DataFrame, stop_words: Sequence[str] | str = STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """Term weights (term, idf) fitted on the corpus, and (text_key, norm) of every distinct text of the cases.

    A text's terms need not be kept: whoever has the text has them, and its vector is their idf over the norm.
    A term outside the fitted corpus has no weight; a text without weighted terms has no row.
    """
    corpus = stage(case_texts(cases), "corpus")
    sent = cases.select(F.explode("submitted_chunks").alias("text")).where(F.col("text").isNotNull())
    other = sent.groupBy(text_key("text").alias("text_key")).agg(F.first("text").alias("text")).join(corpus.select("text_key"), "text_key", "left_anti")
    return _corpus_weights(corpus, corpus.unionByName(other), stop_words)


def _corpus_weights(corpus: DataFrame, texts: DataFrame, stop_words: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    """(term, idf) fitted on a corpus of distinct texts, and (text_key, norm) of the given texts."""
    n = corpus.count()
    idf = stage(
        corpus.select(F.inline(flagged(tokens("text", stop_words))))
        .groupBy("term")
        .agg(F.sum("new").alias("df"))
        .select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")),
        "idf",
    )
    # Most occurrences are of frequent terms, whose weights go to the texts; only rare terms are shuffled to theirs.
    frequent = stage(idf.orderBy("idf", "term").limit(MAX_FREQUENT), "frequent")
    known = _term_counts(texts, stop_words).join(F.broadcast(frequent), "term", "left")
    cells = known.where(F.col("idf").isNotNull()).select("text_key", "tf", "idf")
    if idf.count() > MAX_FREQUENT:
        rare = idf.join(F.broadcast(frequent), "term", "left_anti")
        cells = cells.unionByName(known.where(F.col("idf").isNull()).drop("idf").join(rare, "term").select("text_key", "tf", "idf"))
    w = F.col("tf") * F.col("idf")
    return idf, stage(cells.groupBy("text_key").agg(F.sqrt(F.sum(w * w)).alias("norm")), "norms")


def lexical_matches(cases: DataFrame, stop_words: Sequence[str] | str = STOP_WORDS) -> DataFrame:
    """``best_matches`` by TF-IDF cosine: a chunk's terms are read from the chunk itself, only its norm is joined."""
    idf, norms = lexical_weights(cases, stop_words)
    asked = cases.where(F.col("requirement_text").isNotNull()).groupBy(text_key("requirement_text").alias("text_key")).agg(F.first("requirement_text").alias("text"))
    cells = _term_counts(asked, stop_words).join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # Weight of each term per occurrence in a chunk, but for the chunk's norm.
    vectors = cells.groupBy(F.col("text_key").alias("q_key")).agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("w") * F.col("idf")))).alias("_terms"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    q = _few(stage(vectors, "requirements"))
    scored = _pairs(cases).join(norms.withColumnRenamed("text_key", "c_key"), "c_key", "left").join(q, "q_key", "left")
    dot = F.aggregate(tokens("chunk", stop_words), F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at("_terms", t), F.lit(0.0)))
    cosine = F.when(F.col("norm").isNotNull() & F.col("q_norm").isNotNull(), dot / F.col("q_norm") / F.col("norm") / F.lit((1.0 + SMALL) * (1.0 + SMALL))).otherwise(0.0)
    return _best(scored.select("case_id", "side", "pos", "chunk", F.round(cosine, 9).alias("score")))


def dense_vectors(cases: DataFrame, encode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(text_key, vec: array of doubles) per distinct text, each encoded once."""
    texts = _all_texts(cases)
    encoded = encode(texts) if encode else hashed_vectors(texts, "text", out="vec")
    return encoded.select("text_key", "vec")


def _dense_dot(q: Column, c: Column) -> Column:
    dot = F.aggregate(F.zip_with(q, c, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(dot, F.lit(0.0))


def _pairs(cases: DataFrame) -> DataFrame:
    """(case_id, side, q_key, pos, chunk, c_key) for every chunk of both sides."""
    sides = F.array(
        F.struct(F.lit("submitted").alias("side"), F.col("submitted_chunks").alias("chunks")),
        F.struct(F.lit("record").alias("side"), F.col("full_record_chunks").alias("chunks")),
    )
    listed = cases.select("case_id", text_key("requirement_text").alias("q_key"), F.inline(sides))
    return listed.select("case_id", "side", "q_key", F.posexplode("chunks").alias("pos", "chunk")).withColumn("c_key", text_key("chunk"))


def _few(q: DataFrame) -> DataFrame:
    """A few keys over all cases: the checked table goes to the cases, not the cases to a few tasks."""
    return F.broadcast(q) if q.count() <= MAX_REQUIREMENTS else q


def _best(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("case_id", "side").agg(F.max_by(F.struct("chunk", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("case_id", "side", "b.chunk", "b.score")


def best_matches(cases: DataFrame, vectors: DataFrame, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """Best chunk per case and side (``submitted``, ``record``): (case_id, side, chunk, score).

    The first of equal chunks wins. A side without chunks has no row here.
    """
    vectors = stage(vectors, "vectors")
    wanted = cases.select(text_key("requirement_text").alias("text_key")).distinct()
    q = _few(stage(vectors.join(wanted, "text_key", "left_semi"), "requirements").select(F.col("text_key").alias("q_key"), F.col("vec").alias("q_vec")))
    c = vectors.select(F.col("text_key").alias("c_key"), F.col("vec").alias("c_vec"))
    scored = _pairs(cases).join(c, "c_key", "left").join(q, "q_key", "left").select(
        "case_id", "side", "pos", "chunk", F.round(similarity(F.col("q_vec"), F.col("c_vec")), 9).alias("score")
    )
    return _best(scored)


def hashed_matches(cases: DataFrame, dim: int = 256) -> DataFrame:
    """``best_matches`` by hashed token counts: a chunk's vector is made where it is scored, only requirements' vectors are kept."""
    asked = cases.where(F.col("requirement_text").isNotNull()).groupBy(text_key("requirement_text").alias("q_key")).agg(F.first("requirement_text").alias("text"))
    q = stage(hashed_vectors(asked, "text", dim, "vec").select("q_key", "vec"), "requirements")
    if q.count() > MAX_REQUIREMENTS:
        return best_matches(cases, dense_vectors(cases), _dense_dot)
    held = small_rows(q, MAX_REQUIREMENTS, "requirement vectors")
    shared = cases.sparkSession.sparkContext.broadcast(np.array([r["vec"] for r in held], float).reshape(-1, dim))
    numbers = cases.sparkSession.createDataFrame([(r["q_key"], i) for i, r in enumerate(held)], "q_key string, number int")

    @F.pandas_udf("double")
    def cosine(slots: pd.Series, number: pd.Series) -> pd.Series:
        out, known = np.zeros(len(slots)), number.notna().to_numpy()
        out[known] = (slot_matrix(slots[known], dim) * shared.value[number[known].to_numpy(np.int64)]).sum(axis=1)
        return pd.Series(out, index=slots.index)

    paired = _pairs(cases).drop("c_key").join(F.broadcast(numbers), "q_key", "left")
    return _best(paired.select("case_id", "side", "pos", "chunk", F.round(cosine(hash_slots("chunk", dim), "number"), 9).alias("score")))


def classify_cases(cases: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """Three-way status per case; thresholds see full scores, the output is rounded to 3."""
    wide = matches.groupBy("case_id").agg(
        *[
            x
            for side, p in (("submitted", "sub"), ("record", "rec"))
            for x in (
                F.max(F.when(F.col("side") == side, F.col("chunk"))).alias(f"{p}_chunk"),
                F.max(F.when(F.col("side") == side, F.col("score"))).alias(f"{p}_raw"),
            )
        ]
    )
    joined = cases.join(wide, "case_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("sub_raw", "rec_raw")})
    status = F.when(F.col("sub_raw") >= threshold, "complete").when(F.col("rec_raw") >= threshold, "omitted").otherwise("unsupported")
    return joined.withColumn("predicted_status", status).select(
        *[c for c in ("case_id", "req_id", "requirement_text", "gold_variant") if c in cases.columns],
        "predicted_status",
        F.round("sub_raw", 3).alias("sub_score"),
        F.round("rec_raw", 3).alias("rec_score"),
        F.when(F.col("predicted_status") == "complete", F.col("sub_chunk"))
        .when(F.col("predicted_status") == "omitted", F.col("rec_chunk"))
        .alias("cited_chunk"),
    )


def classify_lexical(cases: DataFrame, threshold: float = LEXICAL_THRESHOLD, stop_words: Sequence[str] | str = STOP_WORDS) -> DataFrame:
    cases = stage(cases, "cases")
    return classify_cases(cases, lexical_matches(cases, stop_words), threshold)


def classify_dense(cases: DataFrame, threshold: float = DENSE_THRESHOLD, encode=None) -> DataFrame:
    cases = stage(cases, "cases")
    return classify_cases(cases, best_matches(cases, dense_vectors(cases, encode), _dense_dot) if encode else hashed_matches(cases), threshold)


def deficiency_report(classified: DataFrame) -> DataFrame:
    """Reviewer rows: confidence, action and a templated explanation per status."""
    status, req, chunk = F.col("predicted_status"), F.col("requirement_text"), F.col("cited_chunk")
    confidence = F.when(status == "complete", F.col("sub_score")).otherwise(F.col("rec_score"))
    fields = {"requirement": req, "confidence": two_digits(confidence), "chunk": chunk}

    def text(of: str) -> Column:
        return F.concat(*[fields[part[1:]] if part.startswith("$") else F.lit(part) for part in EXPLANATIONS[of]])

    return classified.select(
        "case_id", "req_id", "requirement_text", status.alias("status"), "cited_chunk", confidence.alias("confidence"),
        lookup("predicted_status", ACTION_BY_STATUS).alias("suggested_action"),
        F.when(status == "complete", text("complete")).when(status == "omitted", text("omitted")).otherwise(text("unsupported")).alias("rationale"),
    )


def compare_methods(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Both matchers side by side per case, each with its agreement with gold."""
    a = lexical.select("case_id", "gold_variant", F.col("predicted_status").alias("lexical_status"), F.col("rec_score").alias("lexical_score"))
    b = dense.select("case_id", F.col("predicted_status").alias("dense_status"), F.col("rec_score").alias("dense_score"))
    return a.join(b, "case_id").withColumns(
        {
            "lexical_correct": (F.col("lexical_status") == F.col("gold_variant")).cast("int"),
            "dense_correct": (F.col("dense_status") == F.col("gold_variant")).cast("int"),
        }
    )


def chunk_membership(cases: DataFrame) -> DataFrame:
    """Every record chunk with its place and whether it was submitted."""
    return cases.select("case_id", F.posexplode("full_record_chunks").alias("pos", "chunk"), "submitted_chunks").select(
        "case_id", "pos", "chunk",
        F.when(F.coalesce(F.array_contains("submitted_chunks", F.col("chunk")), F.lit(False)), "submitted").otherwise("not submitted").alias("membership"),
    )


def accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n"))

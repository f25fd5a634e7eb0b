"""Exact cosine join of two sets of texts by prefix filtering.

Every text is a unit vector of term weights with its terms in one order for all texts: ascending document
frequency. Take a pair's first common term. If it lies so far back in one text that the weights from there on
have a norm below the threshold, the pair cannot reach the threshold. So only the front of each text, up to
that place, is joined, which leaves the frequent terms out; what the later terms can still add is bounded by
the norms of both rests, and the pairs that pass are compared in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitlens.constants import STOP_WORDS
from remitlens.functions.text import text_key, tokens
from remitlens.session import attach, stage

#: Rows of one term that one task joins; a term with more is dealt to several.
TERM_ROWS = 100_000
MARGIN = 1e-9


def term_cells(texts: DataFrame, text: str, stop_words: Sequence[str] | str = STOP_WORDS) -> DataFrame:
    """Weights of every distinct text: (text_key, term, df, w), unit length per text.

    Weights are term counts times smoothed inverse document frequency over the distinct texts. Texts
    without terms, and null texts, have no rows.
    """
    distinct = stage(texts.where(F.col(text).isNotNull()).groupBy(text_key(text).alias("text_key")).agg(F.first(text).alias("text")), "texts")
    n = distinct.count()
    counts = stage(distinct.select("text_key", F.explode(tokens("text", stop_words)).alias("term")).groupBy("text_key", "term").agg(F.count("*").alias("tf")), "term-counts")
    frequency = stage(counts.groupBy("term").agg(F.count("*").alias("df")), "term-frequencies")
    raw = attach(counts, frequency, ["term"], "df").withColumn("w", F.col("tf") * (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("text_key")))
    return raw.select("text_key", "term", "df", (F.col("w") / norm).alias("w"))


def _front(cells: DataFrame, threshold: float, side: str) -> DataFrame:
    """The terms of each text up to the place where the rest is too short to reach the threshold alone."""
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("text_key").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("before"))
    after = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("before") - F.col("w") * F.col("w")))
    front = cells.withColumn("before", before).where(F.sqrt(from_here) >= threshold - MARGIN)
    return front.select("term", F.col("text_key").alias(side), F.col("w").alias(f"w_{side}"), after.alias(f"rest_{side}"))


def cosine_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Every pair of texts with a cosine of ``threshold`` (above 0) or more: (left_key, right_key, similarity).

    Both sides are ``term_cells`` rows, weighted together. Similarities are rounded to nine digits before they are held
    against the threshold. A term that very many texts have in front is dealt to several tasks by
    the right text; so is a text in very many pairs, when its vector is fetched. Keys are distinct in each
    side; an empty side gives no rows.
    """
    if threshold <= 0:
        raise ValueError("threshold: a pair without common terms has similarity 0 and is never listed")
    left, right = stage(left, "cosine-left"), stage(right, "cosine-right")
    a, b = stage(_front(left, threshold, "left_key"), "cosine-front"), stage(_front(right, threshold, "right_key"), "cosine-front")
    shares = b.groupBy("term").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / TERM_ROWS).cast("int"))
    shares = stage(shares, "cosine-terms")
    dealt_a = attach(a, shares, ["term"], "n").drop("n").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    dealt_b = attach(b, shares, ["term"], "n").drop("n").withColumn("share", F.pmod(F.xxhash64("right_key"), F.col("shares")).cast("int")).drop("shares")
    most = F.col("w_left_key") * F.col("w_right_key") + F.col("rest_left_key") * F.col("rest_right_key")
    pairs = stage(dealt_a.join(dealt_b, ["term", "share"]).where(most >= threshold - MARGIN).select("left_key", "right_key").distinct(), "cosine-pairs")
    vector = F.map_from_entries(F.collect_list(F.struct("term", "w")))
    full = pairs
    for cells, key in ((left, "left_key"), (right, "right_key")):
        used = pairs.groupBy(F.col(key).alias("text_key")).agg(F.count("*").alias("n_pairs"))
        vectors = cells.join(used, "text_key").groupBy("text_key", "n_pairs").agg(vector.alias(f"v_{key}")).withColumnRenamed("text_key", key)
        full = attach(full, stage(vectors, "cosine-vectors"), [key], "n_pairs").drop("n_pairs")
    dot = F.aggregate(F.map_entries("v_right_key"), F.lit(0.0), lambda acc, e: acc + F.coalesce(F.try_element_at("v_left_key", e["key"]), F.lit(0.0)) * e["value"])
    return full.select("left_key", "right_key", F.round(dot, 9).alias("similarity")).where(F.col("similarity") >= threshold)

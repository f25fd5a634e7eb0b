"""Documents to training tokens in stages; each stage's result is written and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm.common import stage, text_of
from remitlens.llm.exact_dedup import deduplicated
from remitlens.llm.mixing import mix
from remitlens.llm.quality import quality_scores
from remitlens.llm.sentencepiece_scan import decode, encode
from remitlens.llm.simhash import near_duplicates


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key per row: a 128-bit digest of id and text, so that ids may be null or repeat.

    Rows that repeat both share a key, and with it every decision.
    """
    return docs.withColumn("_row", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), text_of("text"))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    rows = keyed(docs)
    scores = quality_scores(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("_row",))
    return rows.join(scores.filter("predicted = 1").select("_row").distinct(), "_row", "left_semi").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose SimHash fingerprints link (3-word shingles, 2 bits), the document with the smallest id stays; null ids come last."""
    rows = keyed(docs)
    groups = near_duplicates(rows, id_col="_row").select("_row", "component_id")
    named = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row").alias("name")).distinct()
    staying = groups.distinct().join(named, "_row").groupBy("component_id").agg(F.min("name")["_row"].alias("_row"))
    return rows.join(staying.select("_row"), "_row", "left_semi").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words.

    The whole times of taken / size are kept, and the rest is one more time with that
    probability, decided by id and text. A document without words passes once.
    """
    rows = keyed(docs)
    taken = mix(rows, id_col="_row").groupBy("_row").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    chance = F.pmod(F.xxhash64(F.lit("mix"), "_row"), F.lit(1 << 20)) / (1 << 20)
    ratio = F.col("taken") / F.col("size")
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(ratio) + F.when(chance < ratio - F.floor(ratio), 1).otherwise(0)).cast("int")
    counted = taken.select("_row", times.alias("_times")).filter("_times > 0")
    return rows.join(counted, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, decoded again: doc_id, ids, n_pieces, ids_crc32, decoded_sha256."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = decode(encode(docs, model), model, keep=("ids",))
    return texts.select("doc_id", "ids", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("sentence pieces", sentence_pieces),
]

#: Models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents table; returns the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

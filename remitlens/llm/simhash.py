"""Near-duplicates by SimHash, linked through a segment-popcount grid.

A fingerprint's 64 bits are read as 16 segments of 4. The vector of segment
popcounts is a point on a small integer grid, and the Manhattan distance of two
points is never above the Hamming distance of their fingerprints: each differing
bit moves one coordinate by at most one. Fingerprints within Hamming distance 2
therefore lie within Manhattan distance 2, and any two grid points that close have
a common grid point at distance 1 or less from both. Every distinct fingerprint is
listed at its own point and at the neighbours at distance 1 (at most 33 rows of two
longs); one equi-join of that list with itself finds every candidate, and the
XOR's bit count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import attach, stage, text_of
from remitlens.llm.components import components

SEGMENTS, SEGMENT_BITS = 16, 4
HASH_SEED = 42
_BLOCK = 1 << 16


def text_fingerprint(text: str, words_per_shingle: int) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned integer.

    A-Z are lower-cased and words split at ASCII white space; shingles keep their
    repeats. Bit votes are summed over blocks of shingles, so memory does not grow
    with the number of shingles of a very long text beyond its words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        h = np.array([digest(joined[s:e], HASH_SEED) for s, e in spans], np.dtype("<u8"))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.dtype("<u8"))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row (id, fingerprint long) per row of ``docs``; the long holds the 64 bits.

    Whole texts are read batch by batch; null and blank texts get fingerprint 0.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1)
            prints = np.fromiter((text_fingerprint(texts[i].as_py(), words) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(batches, f"id {kind}, fingerprint long")


def segment_counts(fingerprint: Column) -> Column:
    """The 16 popcounts of 4-bit segments, packed as 16 nibbles of a long.

    Both halves are counted apart, so that no sum reaches the sign bit.
    """

    def half(x: Column) -> Column:
        fives, threes = F.lit(0x55555555), F.lit(0x33333333)
        pairs = x.bitwiseAND(fives) + F.shiftright(x, 1).bitwiseAND(fives)
        return pairs.bitwiseAND(threes) + F.shiftright(pairs, 2).bitwiseAND(threes)

    low, high = fingerprint.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fingerprint, 32)
    return F.shiftleft(half(high), 32).bitwiseOR(half(low))


def links_within_two(prints: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in 1 or 2 bits.

    ``prints`` has one row per distinct fingerprint (column fp). A fingerprint has
    at most 2080 others within two bits, whatever the corpus, so the result is
    linear in the number of distinct fingerprints. The popcount of all bits splits
    the candidates further: it may differ by 2 at most and is compared in the join.
    Spark takes the list for as small as ``prints``, as if nothing were exploded; the
    merge join that is asked for keeps it from being broadcast.
    """
    at = segment_counts(F.col("fp"))
    nibble = lambda i: F.shiftrightunsigned(F.col("point"), SEGMENT_BITS * i).bitwiseAND(F.lit(15))
    step = lambda i: F.shiftleft(F.lit(1).cast("long"), SEGMENT_BITS * i)
    up = [F.when(nibble(i) < SEGMENT_BITS, F.col("point") + step(i)) for i in range(SEGMENTS)]
    down = [F.when(nibble(i) > 0, F.col("point") - step(i)) for i in range(SEGMENTS)]
    listed = prints.select("fp", at.alias("point")).select("fp", F.explode(F.array_compact(F.array(F.col("point"), *up, *down))).alias("point"))
    a, b = listed.select("point", F.col("fp").alias("a")).hint("merge"), listed.select("point", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    return a.join(b, (a["point"] == b["point"]) & (F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Component of every document under SimHash distance 2 or less.

    Returns one row per row of ``docs``: id_col, fingerprint (16 hex digits),
    n_links (distinct other fingerprints linked to its own), n_same (rows with its
    fingerprint), component_id (smallest id reachable, its own included). Texts
    without words have fingerprint zero and are linked like any other; a null id
    is carried but never becomes a component unless all ids of it are null.
    Other columns are not read; an empty table gives no rows.
    """
    prints = stage(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    classes = stage(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least"), F.count("*").alias("n_same")), "simhash-classes")
    links = stage(links_within_two(classes.select("fp")), "simhash-links")
    degree = links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(links).withColumnRenamed("node", "fp")
    placed = classes.join(degree, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stage(placed, "simhash-placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints"))
    known = stage(attach(placed, least, ["root"], "n_prints").select("fp", "n_same", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id"), "simhash-components")
    members = attach(prints.withColumnRenamed("fingerprint", "fp"), known, ["fp"], "n_same")
    return members.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same", "n_links"
    )

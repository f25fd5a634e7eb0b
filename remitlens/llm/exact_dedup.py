"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. The fingerprint of a text is the first 48 bits of its SHA-256; contiguous ranges of
   fingerprints belong to owners. Each scan partition is a sender: it sorts its
   distinct fingerprints per owner and sends their gaps as one Golomb-Rice bit string,
   about log2(gap) + 1.5 bits each. A text repeated inside a sender is sent
   once, so a text held by a third of all rows reaches its owner once per sender.
2. An owner decodes the strings of all senders, finds the fingerprints that two or more
   sent, and answers every string with a bitmap in the order of the string.
3. A sender reads the bitmaps by rank: a zero means unique for certain (or repeated
   only inside the sender, which it knows itself). The suspects' fingerprints go into a
   Bloom filter of bounded size; only texts that pass it are shuffled, after equal
   ones have met inside their partition, and grouped by their bytes. A false positive
   costs a little shuffle and ends as a group of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import attach, stage, text_of
from remitlens.session import shuffle_width

PRINT_BITS = 48
#: Fingerprints an owner should hold; owners follow the row count.
OWNER_ROWS = 1 << 20
_EMIT = 10_000
#: The filter has 16 bits a suspect, and 2 ** 26 bits (8 MB) at most; it is broadcast.
FILTER_BITS_EACH, MOST_FILTER_BITS, FILTER_HASHES = 16, 1 << 26, 3


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as a Golomb-Rice bit string of their gaps.

    Layout: one byte with the Rice parameter, eight with the count, eight with the
    first value, then all remainders (parameter bits each), then all quotients in unary.
    """
    gaps = np.diff(values, prepend=values[:1])
    mean = max(1, int(values[-1] - values[0]) // len(values)) if len(values) else 1
    rice = mean.bit_length() - 1
    low = ((gaps[:, None] >> np.arange(rice)) & 1).astype(np.uint8).ravel()
    ends = np.cumsum((gaps >> rice) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    head = bytes([rice]) + len(values).to_bytes(8, "little") + int(values[0] if len(values) else 0).to_bytes(8, "little")
    return head + np.packbits(low, bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    """The values that golomb_encode was given."""
    rice, count, first = code[0], int.from_bytes(code[1:9], "little"), int.from_bytes(code[9:17], "little")
    split = 17 + -(-rice * count // 8)
    low = np.unpackbits(np.frombuffer(code[17:split], np.uint8), bitorder="little")[: rice * count].reshape(count, rice)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[split:], np.uint8), bitorder="little"))[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    return first + np.cumsum((quotients.astype(np.int64) << rice) + low.astype(np.int64) @ (1 << np.arange(rice, dtype=np.int64)))


def _owner(prints: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each fingerprint: equal ranges of the fingerprint's values."""
    return (prints * np.uint64(owners) >> np.uint64(PRINT_BITS)).astype(np.int32) if owners > 1 else np.zeros(len(prints), np.int32)


def _sender(owners: int, id_type: pa.DataType):
    """Map function of pass 1: the rows of a partition with owner and rank, then its bit strings."""
    schema = pa.schema(
        [("sender", pa.int32()), ("owner", pa.int32()), ("rank", pa.int32()), ("twice", pa.bool_()), ("id", id_type), ("sha", pa.string()), ("code", pa.binary())]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [p for p in parts if p.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        sender = TaskContext.get().partitionId()
        shas = table.column(1).to_pylist()
        prints = np.fromiter((int(s[: PRINT_BITS // 4], 16) for s in shas), np.uint64, len(shas))
        distinct, where, times = np.unique(prints, return_inverse=True, return_counts=True)
        owner = _owner(distinct, owners)
        first = np.searchsorted(owner, np.arange(owners + 1))
        rank = np.arange(len(distinct)) - first[owner]
        columns = [
            pa.array(np.full(len(shas), sender, np.int32)), pa.array(owner[where]), pa.array(rank[where].astype(np.int32)), pa.array(times[where] > 1),
            table.column(0).combine_chunks(), pa.array(shas, pa.string()), pa.nulls(len(shas), pa.binary()),
        ]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches(_EMIT)
        for o in np.unique(owner).tolist():
            code = golomb_encode(distinct[first[o] : first[o + 1]].astype(np.int64))
            row = {"sender": [sender], "owner": [o], "rank": [None], "twice": [None], "id": [None], "sha": [None], "code": [code]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    return run


def _answer(sent: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: bit i of a sender's map is set if another sender also sent its i-th fingerprint."""
    lists = [golomb_decode(c) for c in sent["code"]]
    seen, times = np.unique(np.concatenate(lists), return_counts=True)
    shared = seen[times > 1]
    maps = [np.packbits(np.isin(v, shared, assume_unique=True)).tobytes() for v in lists]
    return pd.DataFrame({"sender": sent["sender"], "owner": sent["owner"], "bitmap": maps})


def _suspects(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The sender's rows whose bit is set or whose text it holds twice itself."""
    suspect = rows["twice"].to_numpy(bool).copy()
    maps = dict(zip(answers["owner"], answers["bitmap"]))
    for owner, part in rows.groupby("owner").indices.items():
        bits = np.unpackbits(np.frombuffer(maps[owner], np.uint8))
        suspect[part] |= bits[rows["rank"].to_numpy()[part]].astype(bool)
    return rows.loc[suspect, ["print"]].drop_duplicates()


def _filter_bits(prints: DataFrame) -> np.ndarray:
    """A Bloom filter of a table of fingerprints, as words of 64 bits; built by Spark, at most 8 MB."""
    wanted = FILTER_BITS_EACH * max(64, prints.count())
    bits = min(MOST_FILTER_BITS, 1 << (wanted - 1).bit_length())
    place = F.explode(F.array(*[F.pmod(F.xxhash64("print", F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)]))
    placed = prints.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    words = np.zeros(bits // 64, np.int64)
    got = placed.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return words.view(np.uint64)


def _passing(texts: DataFrame, words: np.ndarray) -> DataFrame:
    """Rows whose print the filter holds; only hash positions go through Python."""
    held, bits = texts.sparkSession.sparkContext.broadcast(words), len(words) * 64

    @F.pandas_udf("boolean")
    def passes(*places: pd.Series) -> pd.Series:
        hit = np.ones(len(places[0]), bool)
        for place in places:
            at = place.to_numpy(np.uint64)
            hit &= (held.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(hit)

    return texts.filter(passes(*[F.pmod(F.xxhash64("print", F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)]))


def _print_of(sha: str):
    """The fingerprint of a digest column: its first 48 bits."""
    return F.conv(F.substring(sha, 1, PRINT_BITS // 4), 16, 10).cast("long")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Returns id_col, keep_id (largest id among the rows with the same bytes), group_size,
    kept, text_sha256. Null texts count as empty and equal each other. Rows that
    repeat both id and text are all listed, all with the same answer. A null id is
    smaller than every other. Other columns are not read; an empty table gives no
    rows. Owners follow the row count (and are at least as many as shuffle
    partitions), so an owner's share stays bounded at any size.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    owners = max(shuffle_width(spark), -(-docs.count() // OWNER_ROWS))
    arrow_id = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"{id_col}: bigint, int or string is needed, not {kind}")
    schema = f"sender int, owner int, rank int, twice boolean, id {kind}, sha string, code binary"
    sent = stage(source.select("id", F.sha2("text", 256).alias("sha")).mapInArrow(_sender(owners, arrow_id), schema), "dedup-sent")
    rows, codes = sent.filter(F.col("code").isNull()), sent.filter(F.col("code").isNotNull())
    answers = codes.select("sender", "owner", "code").groupBy("owner").applyInPandas(_answer, "sender int, owner int, bitmap binary")
    narrow = rows.select("sender", "owner", "rank", "twice", _print_of("sha").alias("print"))
    suspects = narrow.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(_suspects, "print long")
    suspects = stage(suspects.distinct(), "dedup-suspects")
    texts = source.withColumn("sha", F.sha2("text", 256)).withColumn("print", _print_of("sha"))
    groups = _passing(texts, _filter_bits(suspects)).groupBy("sha", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stage(groups.filter("group_size > 1").drop("text"), "dedup-groups")
    if groups.groupBy("sha").count().filter("count > 1").take(1):
        raise ValueError("two different texts with one SHA-256")
    return attach(rows.select("id", "sha"), groups, ["sha"], "group_size", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one."""
    groups = duplicate_groups(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"), "kept", "group_size")
    rows = stage(groups.filter("group_size > 1").groupBy("_id", "_sha", "kept").agg(F.count("*").alias("_rows")), "dedup-decided")
    named = docs[id_col].eqNullSafe(F.col("_id")) & (F.sha2(text_of(text_col), 256) == F.col("_sha"))
    # Rows that are neither dropped nor a repeat of both id and text pass untouched.
    single = docs.join(rows.filter("NOT kept OR _rows > 1").drop("kept", "_rows"), named, "left_anti")
    repeats = rows.filter("kept AND _rows > 1").drop("kept", "_rows")
    if not repeats.take(1):
        return single
    return single.unionByName(docs.join(repeats, named, "left_semi").dropDuplicates([id_col, text_col]))

"""Ranked lexical search: every query item against all documents, by presence masks.

One pass over the documents keeps, of each, its length and the counts of the terms that
some item asks for. Lengths and document frequencies are summed; then every task goes through
its documents in blocks. In a block, bitmaps of the terms give each document the mask of an
item's terms that it holds. Documents of one mask share a maximum score: the weight of every
term in the mask times the block's highest part for it. Distinct masks are scored from the
highest maximum down until the next maximum is below the k-th score the task knows for the item, so
nothing that could enter the answer is left out. Each task hands on its k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from remitlens.llm.common import stage, term_array, terms_of

#: Items are answered in blocks of about so many (item, term) pairs, the most that is sent to tasks at once.
BLOCK_TERMS = 1 << 17
#: Cells (terms x documents) of the tables that a task keeps of one block of documents.
BLOCK_CELLS = 1 << 23
#: Words counted at once.
_WORDS = 1 << 20


def _counted(vocabulary: dict[bytes, int]):
    """Rows (id, text) to rows (id, n, terms, tfs) of documents with terms: term numbers and counts as packed int32."""
    size = len(vocabulary)

    def emit(ids: list, numbers: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in numbers], np.int64)
        flat = np.concatenate(numbers)
        cells = np.repeat(np.arange(len(ids)), lengths)[flat >= 0] * size + flat[flat >= 0]
        cells, counts = np.unique(cells, return_counts=True)
        cuts = np.searchsorted(cells, np.arange(1, len(ids)) * size)
        pack = lambda x: pa.array([y.tobytes() for y in np.split(x.astype("<i4"), cuts)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(lengths), pack(cells % max(size, 1)), pack(counts)], names=["id", "n", "terms", "tfs"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for part in parts:
            kind, ids, numbers, words = part.schema.field(0).type, [], [], 0
            for name, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                ids.append(name)
                numbers.append(np.fromiter((get(t, -1) for t in terms), np.int64, len(terms)))
                words += len(terms)
                if words >= _WORDS:
                    yield emit(ids, numbers, kind)
                    ids, numbers, words = [], [], 0
            if ids:
                yield emit(ids, numbers, kind)

    return batches


def _frequencies(size: int):
    """Packed term numbers to one row (term, df) per task and term."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for part in parts:
            terms = np.frombuffer(b"".join(part.column(0).to_pylist()), "<i4")
            df += np.bincount(terms, minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])

    return batches


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct presence masks (rows of bits) of the columns of ``present``, and each column's mask number."""
    terms, documents = present.shape
    packed = np.zeros((documents, -(-terms // 64) * 8), np.uint8)
    packed[:, : -(-terms // 8)] = np.packbits(present, axis=0).T
    keys = packed.view(np.uint64)[:, 0] if packed.shape[1] == 8 else packed.view(f"V{packed.shape[1]}")[:, 0]
    distinct, number = np.unique(keys, return_inverse=True)
    return np.unpackbits(distinct.view(np.uint8).reshape(len(distinct), -1), axis=1, count=terms), number


class _Best:
    """The k best (score, id) of an item: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        """A score that a newcomer must reach."""
        return -self.rows[-1][0] if len(self.rows) >= self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(-s, i is None, i) for s, i in zip(scores.tolist(), ids)]
        self.rows.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))
        del self.rows[self.k :]


def _search(items: list[np.ndarray], weights: np.ndarray, n_documents: int, n_terms: int, k: int):
    """Rows (id, n, terms, tfs) to the task's k best rows (item, id, score) of every item."""
    size = len(weights)

    def block(ids: list, n: np.ndarray, terms: list[bytes], tfs: list[bytes], best: list[_Best]) -> None:
        documents = np.repeat(np.arange(len(ids)), [len(t) // 4 for t in terms])
        term = np.frombuffer(b"".join(terms), "<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
        m = 100 - 50 + (50 * n * n_documents) // n_terms
        part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[documents])
        present, parts, most = np.zeros((size, len(ids)), bool), np.zeros((size, len(ids)), np.int32), np.zeros(size, np.int64)
        present[term, documents], parts[term, documents] = True, part
        np.maximum.at(most, term, part)
        for own, top in zip(items, best):
            masks, number = _masks(present[own])
            # Rounded up, so that a maximum is never below a score of its mask.
            maxima = masks @ (weights[own] * most[own]).astype(float) * (1 + 1e-9)
            bound = maxima[number]
            order = np.flatnonzero(bound >= top.floor())
            order = order[np.argsort(-bound[order], kind="stable")]
            at, step = 0, 4 * k
            while at < len(order) and bound[order[at]] >= top.floor():
                some = order[at : at + step]
                scores = weights[own] @ parts[np.ix_(own, some)].astype(np.int64)
                good = scores >= top.floor()
                top.add(scores[good], [ids[i] for i in some[good].tolist()])
                at, step = at + step, 2 * step

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = [_Best(k) for _ in items], None
        step = max(1, BLOCK_CELLS // size)
        for part in parts:
            kind = part.schema.field(0).type
            for at in range(0, part.num_rows, step):
                some = part.slice(at, step)
                block(some.column(0).to_pylist(), some.column(1).to_numpy(zero_copy_only=False).astype(np.int64), some.column(2).to_pylist(), some.column(3).to_pylist(), best)
        found = [(i, r[2], -r[0]) for i, top in enumerate(best) for r in top.rows]
        if found:
            item, name, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(name, kind), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return batches


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: item_col, rank (from 1), id_col, score (above 0).

    N counts the documents with a term, L their terms with repeats, n a document's. A term
    weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document's score is the sum over the item's
    distinct terms of w (10^9 tf div (1000 tf + 20 m)) with m = 50 + (50 n N div L). Equal scores go by
    ascending id, null ids last. Every row of ``docs`` is a document of its own, whatever its id; texts that
    are null or have no term match nothing. The rows of one item id are one item; items without
    terms give no rows, nor do empty tables. Other columns are not read. ``block_terms`` shapes the
    work, never the result: each block of items is one pass over the documents.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(term_array(F.col(item_text_col)))).alias("term"))
    asked = stage(asked.distinct(), "lexical-items")
    blocks = -(-asked.count() // block_terms)
    result = spark.createDataFrame([], f"item {item_kind}, rank int, id {kind}, score long")
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).collect()
        if rows:
            found = _answer(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, k, kind, item_kind)
            result = found if blocks == 1 else result.unionByName(found)
    return result.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _answer(docs: DataFrame, rows: list, k: int, kind: str, item_kind: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    terms: dict = {}
    for item, term in sorted(((r.item, r.term) for r in rows), key=lambda x: x[1]):
        terms.setdefault(item, []).append(vocabulary.setdefault(term.encode(), len(vocabulary)))
    known = spark.sparkContext.broadcast(vocabulary)
    counted = docs.filter(F.col("text").isNotNull()).mapInArrow(lambda parts: _counted(known.value)(parts), f"id {kind}, n long, terms binary, tfs binary")
    counted = stage(counted, "lexical-documents")
    n_documents, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    names = list(terms)
    plan = spark.sparkContext.broadcast(([np.array(terms[i], np.int64) for i in names], weights))
    local = counted.mapInArrow(lambda parts: _search(*plan.value, n_documents, n_terms or 1, k)(parts), f"number int, id {kind}, score long")
    # Two rounds, so that no task gathers the best rows of all tasks.
    groups = math.isqrt(max(1, counted.rdd.getNumPartitions()))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    some = local.withColumn("group", F.spark_partition_id() % groups).withColumn("rank", F.row_number().over(Window.partitionBy("number", "group").orderBy(*order)))
    best = some.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(names)), f"number int, item {item_kind}")
    return best.join(F.broadcast(named), "number").select("item", F.col("rank").cast("int").alias("rank"), "id", "score")

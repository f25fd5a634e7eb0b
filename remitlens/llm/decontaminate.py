"""Benchmark decontamination: a broadcast set of hashed test n-grams, exact checks at every hit.

Every word of the test items gets a number. A window is the run of numbers of ``size``
consecutive item words (all words of a shorter item). The windows' 64-bit polynomial hashes are
broadcast as a sorted list behind a table of bits. Tasks number the words of their documents,
words of no item being breaks, hash the window at every position and compare the numbers themselves
wherever the hash is known, so a hit is exact. Hits mark words, and words mark spans of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import stage, term_array, terms_of

WINDOW = 10
#: Test words are sent to tasks in blocks of about so many; each block is a pass over the documents.
BLOCK_WORDS = 1 << 20
_TABLE_BITS = 22
#: Words looked at at once.
_WORDS = 1 << 20
_TERM_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class WindowSet:
    """The distinct windows of a block of items, each with the items it stands in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        """``items``: (name, words) pairs; pairs of one name are one item."""
        self.numbers: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        holders: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                holders.setdefault(tuple(ids[i : i + size]), set()).add(at[name])
        self.multiplier = 0x9E3779B97F4A7C15
        while not self._index(holders):
            self.multiplier = (self.multiplier * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    def _index(self, holders: dict) -> bool:
        """Lists the windows by length; False if two different ones have one hash."""
        self.lengths: dict[int, tuple] = {}
        for length in sorted({len(w) for w in holders}):
            windows = [w for w in holders if len(w) == length]
            ids = np.array(windows, np.int64)
            hashes = self.hashes(ids.ravel(), length)[::length]
            order = np.argsort(hashes)
            hashes = hashes[order]
            if (hashes[1:] == hashes[:-1]).any():
                return False
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.lengths[length] = (table, hashes, ids[order], [sorted(holders[windows[i]]) for i in order])
        return True

    def hashes(self, ids: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` numbers from each position on."""
        values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(29)
        out = np.zeros(max(0, len(ids) - length + 1), np.uint64)
        for i in range(length):
            out = out * np.uint64(self.multiplier) + values[i : i + len(out)]
        out ^= out >> np.uint64(31)
        return out * np.uint64(0x94D049BB133111EB)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(position, length, item numbers) of every window that occurs in ``ids``; -1 stands for a foreign word."""
        foreign = np.concatenate(([0], np.cumsum(ids < 0)))
        for length, (table, known, windows, items) in self.lengths.items():
            if len(ids) < length:
                continue
            h = self.hashes(ids, length)
            spots = np.flatnonzero(table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] & (foreign[length:] == foreign[:-length]))
            at = np.minimum(np.searchsorted(known, h[spots]), len(known) - 1)
            same = (ids[spots[:, None] + np.arange(length)] == windows[at]).all(axis=1)
            for spot, window in zip(spots[same].tolist(), at[same].tolist()):
                yield spot, length, items[window]


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of every run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _scanner(windows: WindowSet, names: list[str]):
    """Rows (row, text, n_words, spans, items) with the hits of one block of items added; columns ``names`` go out.

    spans are (first, last) word numbers of runs of hit words; items are item names.
    """

    def emit(part: pa.RecordBatch, at: int, numbers: list[np.ndarray], found: dict[int, tuple[list, set]]) -> pa.RecordBatch:
        some = part.slice(at, len(numbers)).select(names)
        spans = [[tuple(s.values()) for s in old] for old in some.column("spans").to_pylist()]
        items = some.column("items").to_pylist()
        for i, (hits, held) in found.items():
            marked = np.zeros(len(numbers[i]), bool)
            for first, last in spans[i] + hits:
                marked[first : last + 1] = True
            spans[i], items[i] = _runs(marked), sorted({*items[i], *held})
        columns = {
            "spans": pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], part.schema.field("spans").type),
            "items": pa.array(items, part.schema.field("items").type),
            "n_words": pa.array([len(x) for x in numbers], pa.int64()),
        }
        return pa.RecordBatch.from_arrays([columns.get(n, some.column(n)) for n in some.schema.names], names=some.schema.names)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = windows.numbers.get
        for part in parts:
            texts = part.column("text").cast(pa.binary())
            at = 0
            while at < len(texts):
                numbers, words = [], 0
                while at + len(numbers) < len(texts) and words < _WORDS:
                    terms = terms_of(texts[at + len(numbers)].as_py() or b"")
                    numbers.append(np.fromiter((get(t, -1) for t in terms), np.int64, len(terms)))
                    words += len(terms) + 1
                # A foreign word after every document, so that no window crosses its end.
                starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in numbers])))
                flat = np.full(starts[-1], -1, np.int64)
                for start, ids in zip(starts.tolist(), numbers):
                    flat[start : start + len(ids)] = ids
                found: dict[int, tuple[list, set]] = {}
                for spot, length, holders in windows.hits(flat):
                    i = int(np.searchsorted(starts, spot, side="right")) - 1
                    hits, held = found.setdefault(i, ([], set()))
                    hits.append((spot - int(starts[i]), spot - int(starts[i]) + length - 1))
                    held.update(windows.names[j] for j in holders)
                yield emit(part, at, numbers, found)
                at += len(numbers)

    return batches


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    keep: tuple[str, ...] | None = None, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every row of ``docs``, in the columns ``keep`` (all, if None), with the test windows that occur in it.

    Adds n_words (words of the text), spans (runs of hit words: first and last word number, from 0),
    n_hit (hit words), items (names of the items with an occurring window, sorted as strings) and
    contaminated (n_hit > 0); columns of those names are replaced. Words are runs of ASCII letters and
    digits and of characters beyond ASCII, A-Z lower-cased. A null text has no words. Rows of one item id
    are one item with the windows of each; a null item id is named "null"; items without words
    have no windows. Empty tables are fine on either side. ``block_words`` shapes the work, never the
    result.
    """
    spark = docs.sparkSession
    new = ("n_words", "spans", "items", "n_hit", "contaminated")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    words = stage(items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), term_array(F.col(item_text_col)).alias("words")).filter(F.size("words") > 0).distinct(), "windows-items")
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    # The other columns travel packed away as one, so that no name of theirs clashes.
    rows = docs.select(F.struct(F.lit(0).alias("_pad"), *[c for c in kept if c != text_col]).alias("row"), F.col(text_col).alias("text"))
    spans, none = "cast(array() as array<struct<first: int, last: int>>)", "cast(array() as array<string>)"
    rows = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr(spans), "items": F.expr(none)})
    blocks = max(1, -(-total // block_words))
    for number in range(blocks):
        own = words.filter(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == number).collect()
        known = spark.sparkContext.broadcast(WindowSet([(r.name, [w.encode() for w in r.words]) for r in own], window))
        last = number + 1 == blocks
        names = [c for c in rows.columns if c != "text" or not last or text_col in kept]
        scan = rows.mapInArrow(lambda parts, known=known, names=names: _scanner(known.value, names)(parts), rows.select(*names).schema)
        rows = scan if last else stage(scan, "windows-found")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    carried = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept]
    return rows.select(*carried, "n_words", "spans", "items", n_hit.alias("n_hit"), (n_hit > 0).alias("contaminated"))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from a span's first word to its last."""
    places = [m.span() for m in _TERM_RUN.finditer(text)]
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at : places[first][0]])
        at = places[last][1]
    return b"".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without what they share with the items.

    remove="documents" leaves contaminated rows out. remove="spans" keeps every row and
    cuts the hit words, with what stands between them, out of its text; other text stays as it
    is, and rows without hits are untouched. Options are those of ``find_contamination``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: {remove!r} is neither 'spans' nor 'documents'")
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(F.lit(0).alias("_pad"), *others).alias("row"), F.col(text_col).alias("text"))
    found = find_contamination(packed, items, text_col="text", **options)
    restored = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select(*restored)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            for i, spans in enumerate(part.column("spans").to_pylist()):
                if spans:
                    texts[i] = _cut(texts[i].encode(), [(s["first"], s["last"]) for s in spans]).decode()
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    rows = found.select("row", "text", "spans")
    return rows.mapInArrow(batches, rows.select("row", "text").schema).select(*restored)

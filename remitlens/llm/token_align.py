"""Cross-tokenizer alignment: links of two tokenizers' tokens, counted over the corpus by minimal perfect hashing.

The first pass encodes every text with both tokenizers and keeps the ids. What follows re-aligns
documents from the ids alone, since an id gives its token's length in bytes: the ends of both
sides' tokens cut a text into pieces, each piece is one link, and ends on both sides close a group.

Counting. Tasks list the distinct id pairs of their documents; Spark makes them distinct over the corpus
and deals them to buckets, and a task per bucket builds bit arrays that give every pair a number of
its own below the number of pairs. Every task then counts its links in a dense vector by that number,
and the vectors' segments are summed as a tree. In the last pass documents are re-aligned
and their links looked up; a number is valid only where its stored pair is the one asked for.
A vector never has more than ``shard_pairs`` entries: more pairs are dealt to shards by hash,
counted and looked up one shard after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import stage, text_of
from remitlens.llm.sentencepiece_scan import MARK, Model
from remitlens.llm.token_files import BATCH_CHARS, WordEncoder, _Slots

#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 300_000
SHARD_PAIRS, BUCKET_PAIRS, SEGMENT = 1 << 22, 1 << 16, 1 << 16
#: Vectors that one task of the tree adds; counting tasks for each core.
FAN, TASKS_PER_CORE = 16, 4
#: Bits for each pair of a bucket that still has no number.
_SPARE = 1.6
#: Bytes of text aligned together; pairs that a task holds before it hands them on.
_CHUNK, _HELD = 1 << 20, 1 << 21


def byte_level_tokens(tokenizer) -> list[bytes]:
    """Bytes of every token of a byte-level vocabulary, by id."""
    # Printable Latin-1 characters stand for their own byte, the others for the characters from 256 on.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    out = [b""] * (max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """Bytes of every piece of a SentencePiece model, by id."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class _IdLists:
    """Id lists by number, end to end."""

    def __init__(self):
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, flat))

    def joined(self, slots: np.ndarray) -> np.ndarray:
        """The lists of some numbers, one behind the other."""
        start = self.starts[slots]
        size = self.starts[slots + 1] - start
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]


class Tokenizers:
    """Both tokenizers of a worker, with the bytes of their tokens.

    In a regular text, white space is single spaces and newlines between words. There no token of either side crosses the
    place before a space or a newline, so each distinct word is encoded once while it is remembered, with its space or newline.
    Other texts, models that lack these cuts, and texts with a word that a side does not spell are encoded whole.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        # Not the worker's shared encoder: special tokens' strings are plain text here.
        self.coder = WordEncoder(a_path)
        self.coder.tokenizer.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = byte_level_tokens(self.coder.tokenizer), piece_tokens(self.model)
        self.bare = bare_model(b_path) if self.coder.by_word else None
        self._clear()

    def _clear(self) -> None:
        self.slots, self.sides, self.fitting = _Slots(), (_IdLists(), _IdLists()), np.zeros(0, bool)

    def _spelled(self, a: list[int], b: list[int], whole: bytes) -> bool:
        """Whether both sides' bytes are the given ones."""
        return b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))

    def _learn(self) -> None:
        new, self.slots.new = self.slots.new, []
        if not new:
            return
        words = [w if w[:1] == "\n" else " " + w for w in new]
        a, b = [e.ids for e in self.coder.tokenizer.encode_batch_fast(words, add_special_tokens=False)], self.bare.encode(words, num_threads=1)
        for side, found in zip(self.sides, (a, b)):
            side.add(found)
        fits = [self._spelled(x, y, w.encode()) for x, y, w in zip(a, b, words)]
        self.fitting = np.concatenate((self.fitting, np.array(fits, bool)))

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        # The tokenizer's pattern cuts between a letter and a space, so the text follows a first token x.
        a = self.coder._whole("x " + text) if self.coder.by_word else self.coder.encode(["x " + text])[0]
        a, b = a[1:], self.model.encode([text], num_threads=1)[0]
        return (a, np.array(b, np.uint32)) if text and self._spelled(a.tolist(), b, b" " + text.encode()) else (a[:0], a[:0])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text on both sides; none where a side's bytes are not those of a space and the text."""
        if len(self.slots) > CACHE_WORDS:
            self._clear()
        placed = []
        for text in texts:
            if self.bare and text and " ".join(text.split()) == text.replace("\n", " ") and MARK not in text:
                words = text.replace("\n", " \n").split(" ")
                placed.append(np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words)))
            else:
                placed.append(None)
        self._learn()
        for text, slots in zip(texts, placed):
            if slots is None or not self.fitting[slots].all():
                yield self._whole(text)
            else:
                yield self.sides[0].joined(slots), self.sides[1].joined(slots)


def bare_model(path: str):
    """The SentencePiece model without the space it adds, if it can be given word by word: a byte-pair model that keeps its
    text as it is, with no piece that holds a word mark or a newline beside another character before it; else None."""
    try:
        model = Model(path)
    except ValueError:
        return None
    cut = model.merges and model.prefix and not any("\n" in p and len(p) > 1 for p in model.pieces)
    return model.bare if cut else None


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _tokenizers:
        _tokenizers[a_path, b_path] = Tokenizers(a_path, b_path)
    return _tokenizers[a_path, b_path]


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _encoded(a_path: str, b_path: str):
    """Rows (id, text) to rows (id, a, b) with packed ids."""

    def emit(both: Tokenizers, names: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
        a, b = zip(*both.encode(texts))
        pack = lambda x, n: pa.array([i.astype(_width(n)).tobytes() for i in x], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pack(a, len(both.a_bytes)), pack(b, len(both.b_bytes))], names=["id", "a", "b"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for part in parts:
            kind, names, texts, size = part.schema.field(0).type, [], [], 0
            for name, text in zip(part.column(0).to_pylist(), part.column(1)):
                names.append(name)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield emit(both, names, texts, kind)
                    names, texts, size = [], [], 0
            if names:
                yield emit(both, names, texts, kind)

    return batches


class Aligned:
    """Links and groups of consecutive documents, from their ids on both sides."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        # Both sides of a document have the same bytes, so one scale of bytes serves the chunk.
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        marks = np.zeros((2, (int(a_ends[-1]) if len(a_ends) else 0) + 1), bool)
        marks[0, a_ends], marks[1, b_ends] = True, True
        ends = np.flatnonzero(marks[0] | marks[1])
        self.is_a, self.is_b = marks[0, ends], marks[1, ends]
        self.link_a = self.a[np.cumsum(self.is_a) - self.is_a]
        self.link_b = self.b[np.cumsum(self.is_b) - self.is_b]
        self.closes = self.is_a & self.is_b
        last = np.concatenate(([0], a_ends))[np.cumsum(self.n_a)]
        #: Links before each document and after the last.
        self.bounds = np.concatenate(([0], np.searchsorted(ends, last, side="right")))

    def per_document(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per link over each document."""
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return np.diff(sums[self.bounds])

    def groups(self) -> list[str]:
        """Each document's groups: ids of both sides, ``a1,a2|b1;a3|b2,b3``."""
        group = np.cumsum(self.closes) - self.closes
        a_group, b_group, n = group[self.is_a], group[self.is_b], int(self.closes.sum())
        a_upto, b_upto = np.cumsum(np.bincount(a_group, minlength=n)), np.cumsum(np.bincount(b_group, minlength=n))
        # A cell of 8 bytes for each token: its digits, and in the last byte what follows it.
        cells = np.zeros((len(self.a) + len(self.b), 8), np.uint8)
        a_place = np.arange(len(self.a)) + (b_upto - np.bincount(b_group, minlength=n))[a_group]
        b_place = np.arange(len(self.b)) + a_upto[b_group]
        for ids, place, closing, upto in ((self.a, a_place, "|", a_upto), (self.b, b_place, ";", b_upto)):
            digits = _digits(int(ids.max()) + 1 if len(ids) else 0)
            cells[place] = digits[ids]
            cells[place, 7] = ord(",")
            cells[place[upto - 1], 7] = ord(closing)
        stops = np.cumsum(self.n_a + self.n_b)
        return [cells[stop - size : stop].tobytes().translate(None, b"\0").decode()[:-1] for stop, size in zip(stops.tolist(), (self.n_a + self.n_b).tolist())]


_digit_tables: list[np.ndarray] = []


def _digits(size: int) -> np.ndarray:
    """Decimal digits of the numbers below ``size`` (at most 7 digits) as rows of 8 bytes, padded with zero bytes."""
    if not _digit_tables or len(_digit_tables[0]) < size:
        n = max(size, 1 << 16)
        _digit_tables[:] = [np.array([str(i) for i in range(n)], "S8").view(np.uint8).reshape(n, 8)]
    return _digit_tables[0]


def _chunks(part: pa.RecordBatch, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Iterator[tuple[int, int, Aligned]]:
    """(first row, rows, alignment) of the documents of a batch, in chunks."""
    a, b, begin = [], [], 0
    size = 0
    for i, (x, y) in enumerate(zip(part.column("a"), part.column("b"))):
        a.append(np.frombuffer(x.as_py(), _width(len(a_sizes))))
        b.append(np.frombuffer(y.as_py(), _width(len(b_sizes))))
        size += 4 * len(a[-1])
        if size >= _CHUNK or i + 1 == part.num_rows:
            yield begin, len(a), Aligned(a, b, a_sizes, b_sizes)
            a, b, begin, size = [], [], i + 1, 0


def _mix(keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mix of each key."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(keys: np.ndarray) -> np.ndarray:
    """The non-negative hash by which pairs are dealt to shards and buckets."""
    return (_mix(keys) >> np.uint64(1)).astype(np.int64)


def _pairs(sizes: tuple[np.ndarray, np.ndarray]):
    """Rows (a, b) to the distinct pairs of the task: rows (key, hash)."""
    base = len(sizes[1])

    def rows(keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(spread(keys))], names=["key", "hash"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for part in parts:
            for _, _, found in _chunks(part, *sizes):
                held = np.union1d(held, found.link_a * base + found.link_b)
                if len(held) > _HELD:
                    yield rows(held)
                    held = held[:0]
        if len(held):
            yield rows(held)

    return batches


def _bucket_bits(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Levels of bits: a key's number is the rank of the bit it alone sets at its first level without a rival."""
    sizes, bits, level = [], [], 0
    while len(keys):
        size = (int(_SPARE * len(keys)) // 64 + 1) * 64
        at = (_mix(keys, level + 1) % np.uint64(size)).astype(np.int64)
        single = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(single)
        keys, level = keys[~single[at]], level + 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def _build(table: pa.Table) -> pa.Table:
    sizes, bits = _bucket_bits(table.column("key").to_numpy())
    payload = np.packbits(bits, bitorder="little").tobytes()
    return pa.table(
        {"shard": table.column("shard").slice(0, 1), "bucket": table.column("bucket").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([payload], pa.binary())}
    )


class PairIndex:
    """A minimal perfect hash of one shard's pairs, with the pairs in the order of their numbers."""

    def __init__(self, buckets: list[tuple[int, list[int], bytes]], n_buckets: int, shards: int, keys: np.ndarray):
        self.shards, self.n_buckets, n_levels = shards, n_buckets, max((len(s) for _, s, _ in buckets), default=0)
        self.sizes, self.starts = np.zeros((n_levels + 1, n_buckets), np.int64), np.zeros((n_levels, n_buckets), np.int64)
        place = 0
        for bucket, sizes, _ in buckets:
            self.sizes[: len(sizes), bucket] = sizes
            self.starts[: len(sizes), bucket] = place + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            place += sum(sizes)
        self.words = np.frombuffer(b"".join(bits for _, _, bits in buckets), "<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.keys = np.full(len(keys), -1, np.int64)
        self.keys[self._numbers(keys)] = keys

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """A number for each key, right for the index's own keys; -1 for some others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        bucket = (spread(keys) // self.shards) % self.n_buckets
        for level in range(len(self.starts)):
            size = self.sizes[level][bucket]
            # A bucket without this level has no key left.
            if not size.all():
                left, bucket, size = left[size > 0], bucket[size > 0], size[size > 0]
            at = self.starts[level][bucket] + (_mix(keys[left], level + 1) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = rank[hit]
            left, bucket = left[~hit], bucket[~hit]
            if not len(left):
                break
        return out

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key that the index holds; -1 for every other."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._numbers(keys)
        out[self.keys[out] != keys] = -1
        return out


def _vectors(index: PairIndex, sizes: tuple[np.ndarray, np.ndarray]):
    """Rows (a, b) to the task's dense count vector: rows (segment, part, counts) of the segments with counts."""
    base = len(sizes[1])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(-(-len(index.keys) // SEGMENT) * SEGMENT, np.int64)
        for part in parts:
            for _, _, found in _chunks(part, *sizes):
                keys, n = np.unique(found.link_a * base + found.link_b, return_counts=True)
                numbers = index.numbers(keys)
                counts[numbers[numbers >= 0]] += n[numbers >= 0]
        for segment, own in enumerate(counts.reshape(-1, SEGMENT)):
            if own.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([own.astype("<i8").tobytes()], pa.binary())],
                    names=["segment", "part", "counts"],
                )

    return batches


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("counts"))
    return pa.table({"segment": table.column("segment").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def tree_sum(vectors: DataFrame, parts: int) -> DataFrame:
    """Sum of each segment's vectors, FAN of them in a task at a time."""
    while parts > 1:
        vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("segment", "part").applyInArrow(_added, "segment int, part int, counts binary")
        parts = -(-parts // FAN)
    return vectors


def _looked_up(index: PairIndex, counts: np.ndarray, highest: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], last: bool):
    """Rows (id, a, b, n_best, count_sum) with one shard's links added; the last shard gives the result's rows."""
    base = len(sizes[1])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin, n, found in _chunks(part, *sizes):
                some = part.slice(begin, n)
                numbers = index.numbers(found.link_a * base + found.link_b)
                count = np.where(numbers >= 0, counts[numbers], 0)
                sums = {"n_best": (numbers >= 0) & (count == highest[found.link_b]), "count_sum": count}
                sums = {k: pa.array(some.column(k).to_numpy(zero_copy_only=False) + found.per_document(v)) for k, v in sums.items()}
                if not last:
                    yield pa.RecordBatch.from_arrays([sums.get(c, some.column(c)) for c in some.schema.names], names=some.schema.names)
                    continue
                links = np.diff(found.bounds)
                columns = {
                    "id": some.column("id"), "n_a": pa.array(found.n_a), "n_b": pa.array(found.n_b), "n_groups": pa.array(found.per_document(found.closes)),
                    "n_links": pa.array(links), **sums, "groups": pa.array(found.groups(), pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return batches


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """Every row of ``docs`` with the alignment of two tokenizers' tokens.

    ``a_path`` is a byte-level tokenizers file, given a space and the text, ``b_path`` a
    SentencePiece model, which adds the space. Special tokens' strings are plain text. Returns id_col,
    n_a and n_b (tokens), n_groups (pieces between places where tokens of both sides end), n_links (pairs of
    tokens with bytes in common), n_best (links whose id pair is linked as often in the corpus as any
    of its B id), count_sum (the corpus counts of the links' id pairs, added up) and groups
    (``a1,a2|b1;a3|b2,b3``). A null or empty text, or one that a side does not spell byte by byte,
    has no tokens: zeros and an empty string. Every row is a text of its own, whatever its id; ids
    may be null or repeat. Other columns are not read; an empty table gives no rows. ``shard_pairs``
    shapes the work, never the result.
    """
    spark = docs.sparkSession
    both = Tokenizers(a_path, b_path)
    sizes = tuple(np.array([len(x) for x in side], np.int64) for side in (both.a_bytes, both.b_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ids = stage(source.mapInArrow(_encoded(a_path, b_path), f"id {kind}, a binary, b binary"), "align-ids")
    sides = ids.select("a", "b")
    pairs = stage(sides.mapInArrow(_pairs(sizes), "key long, hash long").distinct(), "align-pairs")
    total = pairs.count()
    # Nine tenths leave room for the uneven shares of a hash.
    shards = max(1, -(-total * 10 // (shard_pairs * 9)))
    n_buckets = max(1, -(-total // (shards * BUCKET_PAIRS)))
    dealt = pairs.selectExpr("key", f"cast(hash % {shards} as int) as shard", f"cast((hash div {shards}) % {n_buckets} as int) as bucket")
    built = stage(dealt.groupBy("shard", "bucket").applyInArrow(_build, "shard int, bucket int, sizes array<int>, bits binary"), "align-buckets")

    def index_of(shard: int) -> PairIndex:
        rows = sorted((r.bucket, list(r.sizes), bytes(r.bits)) for r in built.filter(F.col("shard") == shard).collect())
        return PairIndex(rows, n_buckets, shards, dealt.filter(F.col("shard") == shard).select("key").toArrow().column("key").to_numpy())

    def counts_of(summed: DataFrame, index: PairIndex) -> np.ndarray:
        counts = np.zeros(-(-len(index.keys) // SEGMENT) * SEGMENT + 1, np.int64)
        for r in summed.select("segment", "counts").toLocalIterator():
            counts[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.counts, "<i8")
        return counts

    highest, tables = np.zeros(len(sizes[1]), np.int64), []
    tasks = min(sides.rdd.getNumPartitions(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    for shard in range(shards):
        index = index_of(shard)
        known = spark.sparkContext.broadcast(index)
        vectors = sides.coalesce(max(1, tasks)).mapInArrow(lambda parts, known=known: _vectors(known.value, sizes)(parts), "segment int, part int, counts binary")
        tables.append(stage(tree_sum(vectors, tasks), "align-counts"))
        counts = counts_of(tables[-1], index)
        np.maximum.at(highest, index.keys % len(sizes[1]), counts[: len(index.keys)])
    rows = ids.select("id", "a", "b", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    result = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    for shard in range(shards):
        if shards > 1:
            index = index_of(shard)
            counts = counts_of(tables[shard], index)
        known, last = spark.sparkContext.broadcast((index, counts, highest)), shard + 1 == shards
        rows = rows.mapInArrow(lambda parts, known=known, last=last: _looked_up(*known.value, sizes, last)(parts), result if last else rows.schema)
        rows = rows if last else stage(rows, "align-looked-up")
    return rows.withColumnRenamed("id", id_col)

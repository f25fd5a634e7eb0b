"""Token ids in fixed-width bit-packed files.

File format. A folder of Parquet files, one row per block, in the order of documents:
shard (number of the file's range of ids), block (number inside the shard), first_id
(ids of the shard before the block), n_ids, bits, payload, and the document
offsets of the block: docs (their ids) and ends (ids of the block up to and with the
document). The payload holds every id in ``bits`` bits, the minimum for the vocabulary,
least significant bit first, padded to whole bytes. A block begins at a document and closes at the
first document end at or after BLOCK_IDS ids; any id is found by its block's first_id
and unpacked without reading others. Rows are written by Spark's own committed
writer, so a lost executor leaves neither gaps nor repeats, in any store Spark reaches.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from remitlens.llm.common import staging_root, text_of
from remitlens.session import shuffle_width

BLOCK_IDS = 1 << 16
END_ID = 0
#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 700_000

FILE_SCHEMA = "shard int, block int, first_id long, n_ids long, bits int, payload binary, docs array<long>, ends array<long>"


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop-1 of a payload, touching only their bytes."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}")[start:stop].astype(np.uint32)
    first, last = start * bits // 8, -(-stop * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8)[first:last], bitorder="little")[start * bits - first * 8 :]
    rows = flat[: (stop - start) * bits].reshape(-1, bits)
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, :bits] = rows
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


_BORDER = re.compile(r"(?<=\S)(?= \S)")


def words_of(text: str) -> list[str]:
    """Cut a text before every single space between non-spaces; the pieces join to the text.

    A byte-level tokenizer's own word pattern takes such a space together with what
    follows it, so no token and no special token crosses these cuts.
    """
    return _BORDER.split(text)


class _Slots(dict):
    """Numbers for keys; a key seen for the first time gets the next one and is listed in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        slot = self[key] = len(self)
        self.new.append(key)
        return slot


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once while it is remembered.

    In a regular text, white space is single spaces and newlines between words. There a newline is a
    token of its own too, and pieces are cut before every space and newline. A
    piece is remembered without its space, with its newline.
    """

    def __init__(self, path: str):
        # Spark's tasks are the threads; the library reads this when it first encodes.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pre = self.tokenizer.pre_tokenizer
        # Only a byte-level pattern without a prefix space and no normaliser has these cuts.
        self.by_word = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)  # starts[i] .. starts[i + 1]: ids of piece i

    def _learn(self) -> None:
        new, self.slots.new = self.slots.new, []
        if not new:
            return
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([w if w[:1] == "\n" else " " + w for w in new], add_special_tokens=False)]
        n, sizes = len(self.slots) - len(new), np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = int(self.starts[n])
        need = total + int(sizes.sum())
        while need > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(new) + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.ids[total:need] = np.fromiter(chain.from_iterable(encoded), np.uint32, need - total)
        self.starts[n + 1 : n + len(new) + 1] = total + np.cumsum(sizes)

    def _whole(self, text: str) -> np.ndarray:
        """Ids of an irregular text: its pieces are encoded in one call and not remembered."""
        pieces = self.tokenizer.encode_batch_fast(words_of(text), add_special_tokens=False)
        return np.fromiter(chain.from_iterable(p.ids for p in pieces), np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every whole text."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.slots) > CACHE_WORDS:
            self._clear()
        placed = []
        for text in texts:
            if text and len(text.split()) == text.count(" ") + text.count("\n") + 1:
                pieces = ("\n" + text).replace("\n", " \n")[1:].split(" ")
                placed.append(np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces)))
            else:
                placed.append(None)
        self._learn()
        out = []
        for text, slot in zip(texts, placed):
            if slot is None:
                out.append(self._whole(text))
                continue
            start = self.starts[slot]
            size = self.starts[slot + 1] - start
            ends = np.cumsum(size)
            # The first id is that of the newline put before the text.
            out.append(self.ids[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)][1:])
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; Python workers are reused between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


#: Characters that are encoded together.
BATCH_CHARS = 2_000_000


def _coded(coder: WordEncoder, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text, encoded in groups of about BATCH_CHARS."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if size > BATCH_CHARS:
            yield from coder.encode(held)
            held, size = [], 0
    yield from coder.encode(held)


def _blocks(path: str, end_id: int, block_ids: int):
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("payload", pa.binary()),
         ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        bits = width_of(max(coder.vocabulary, end_id + 1))
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            ends = np.cumsum([len(h) for h in held])
            row = [[shard], [block], [first], [len(ids)], [bits], [pack(ids, bits)], [docs], [ends]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        stop = np.array([end_id], np.uint32)
        for part in parts:
            names, texts = part.column(0).to_pylist(), part.column(1)
            for name, coded in zip(names, _coded(coder, texts)):
                ids = np.concatenate((coded, stop))
                docs.append(name)
                held.append(ids)
                size += len(ids)
                if size >= block_ids:
                    yield close()
                    docs, held, block, first, size = [], [], block + 1, first + size, 0
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS, shards: int | None = None) -> None:
    """Encode every whole text and write the ids to ``path`` in ascending order of id.

    Documents are dealt by ranges of their id to ``shards`` shards (the shuffle width
    unless given) and sorted inside each; ``end_id`` follows every document. Null texts
    count as empty; a null id comes first; rows that repeat an id lie side by
    side in order of their text. An empty table writes no blocks.
    """
    shards = shards or shuffle_width(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    ordered = source.repartitionByRange(shards, "id")
    ordered.sortWithinPartitions("id", "text").mapInArrow(_blocks(tokenizer, end_id, block_ids), FILE_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token folder."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def _documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for row in part.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            ends = np.array(row["ends"], np.int64)
            begins = ends - np.diff(ends, prepend=0)
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
            columns = [row["docs"], row["first_id"] + row["before"] + begins, ends - begins, sums, [row["shard"]] * len(ends), [row["block"]] * len(ends)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"])


def token_index(blocks: DataFrame) -> DataFrame:
    """What the files hold of each document: doc_id, start, n_tokens, ids_crc32, shard, block.

    Blocks know their place inside their shard; the ids of earlier shards are added from
    one total per shard, a table as long as the number of files.
    """
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    placed = blocks.join(F.broadcast(before), "shard").select("shard", "block", "first_id", "n_ids", "bits", "before", "payload", "docs", "ends")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, block int")


def read_ids(blocks: DataFrame, shard: int, start: int, stop: int) -> np.ndarray:
    """Random access: ids start .. stop-1 of a shard, from the blocks that hold them."""
    wanted = blocks.filter((F.col("shard") == shard) & (F.col("first_id") < stop) & (F.col("first_id") + F.col("n_ids") > start))
    rows = wanted.select("first_id", "n_ids", "bits", "payload").orderBy("first_id").collect()
    parts = [unpack(r.payload, r.bits, max(0, start - r.first_id), min(r.n_ids, stop - r.first_id)) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a fresh token folder in the session's shared folder and index what it holds."""
    path = f"{staging_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return token_index(read_tokens(docs.sparkSession, path))

"""SentencePiece encoding and decoding, with giant documents as a max-plus scan.

A segmentation is a path through the boundaries between the characters of the
normalised text; an edge is a vocabulary piece (or one character spelled in byte
pieces). In max-plus terms, a stretch of text is a matrix: the best score of a path from
every state at its left border to every state at its right border. A state is the
piece that reaches or crosses the border, with the number of characters it reaches beyond.

* A unigram model scores an edge with its piece's score.
* A byte-pair model's result is the one path all whose neighbouring pieces keep their
  border when the two are encoded together; an edge weighs 0 if so and
  minus infinity if not.

No piece has a word mark behind another character, so at the beginning of a word only
one state exists, and a chunk's matrix is (states to first word) x (words) x (last word
to states): words between are encoded by the library, only the two cut words need the lattice.

Documents of more than ``chunk_chars`` characters are cut at fixed positions, whatever
stands there. Every chunk computes its matrix on its own; the matrices of a document
are combined in order (max-plus products are associative; they are small and hold no text), which
tells every chunk its two border states; then each chunk emits its ids by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import stage, text_of
from remitlens.session import shuffle_width

MARK = "▁"
CHUNK_CHARS = 16_384
NONE = float("-inf")

#: (characters beyond the border, piece): a piece that starts before a border and ends at or behind it.
State = tuple[int, str]
START: State = (0, "")


class Model:
    """A SentencePiece model file with what the lattice needs.

    Only models that spell unknown characters in bytes, keep white space as it is and
    have no character map are taken, and none whose pieces hold a word mark behind another character.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            raw = file.read()
        spec = proto.ModelProto.FromString(raw)
        rules = spec.normalizer_spec
        if not spec.trainer_spec.byte_fallback or rules.remove_extra_whitespaces or rules.precompiled_charsmap or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model needs byte fallback and an identity normaliser")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.prefix = MARK if rules.add_dummy_prefix else ""
        rules.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.merges = spec.trainer_spec.model_type == proto.TrainerSpec.BPE
        kinds = proto.ModelProto.SentencePiece
        self.pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("a piece holds a word mark behind another character")
        self.scores = [p.score for p in spec.pieces]
        self.unknown = min(self.scores[i] for i in self.pieces.values()) - 10.0
        self.longest = max(map(len, self.pieces))
        self.joins = lru_cache(1 << 18)(self._joins)

    def ids(self, piece: str) -> list[int]:
        """Ids of a piece, or of the bytes of a character without one."""
        if piece in self.pieces:
            return [self.pieces[piece]]
        return [self.bare.piece_to_id(f"<0x{b:02X}>") for b in piece.encode("utf-8")]

    def _joins(self, left: str, right: str) -> bool:
        """Whether a byte-pair encoder keeps the border between two pieces."""
        return self.bare.encode(left + right) == self.ids(left) + self.ids(right)

    def weight(self, left: str, right: str) -> float:
        """Weight of an edge ``right`` behind an edge ``left`` (empty at a border that always holds)."""
        if not self.merges:
            return self.scores[self.pieces[right]] if right in self.pieces else self.unknown
        return 0.0 if not left or self.joins(left, right) else NONE

    def edges(self, text: str, at: int) -> Iterator[str]:
        """Pieces that start at a position: the character itself, and every longer vocabulary piece."""
        yield text[at]
        for size in range(2, min(self.longest, len(text) - at) + 1):
            if text[at : at + size] in self.pieces:
                yield text[at : at + size]

    def states(self, text: str, border: int) -> list[State]:
        """All states of a border inside ``text``; one at its ends and at the beginning of a word."""
        if border in (0, len(text)) or is_word_start(text, border):
            return [START]
        found = []
        for at in range(max(0, border - self.longest), border):
            found += [(at + len(p) - border, p) for p in self.edges(text, at) if at + len(p) >= border]
        return found

    def paths(self, text: str, entry: State, start: int, border: int, single: bool) -> dict[State, tuple[float, list[int]]]:
        """Best path from an entry state at ``start`` to every state of ``border``: score and ids.

        ``single``: the border has one state. A unigram needs only the best node of a
        position, a byte-pair model one node per piece that ends there.
        """
        over, piece = entry
        nodes: dict[int, dict[str, tuple[float, tuple | None]]] = {start + over: {piece: (0.0, None)}}
        exits: dict[State, tuple[float, tuple]] = {}
        for at in range(start + over, border):
            for last, (score, trail) in nodes.pop(at, {}).items():
                for edge in self.edges(text, at):
                    weight = self.weight(last, edge)
                    if weight == NONE:
                        continue
                    stop, value = at + len(edge), (score + weight, (edge, trail))
                    if stop >= border:
                        if stop > border and single:
                            continue
                        state = START if single else (stop - border, edge)
                        if state not in exits or value[0] > exits[state][0]:
                            exits[state] = value
                    else:
                        name = edge if self.merges else ""
                        held = nodes.setdefault(stop, {})
                        if name not in held or value[0] > held[name][0]:
                            held[name] = value
        if start + over >= border:
            state = START if single else (start + over - border, piece)
            return {state: (0.0, [])}
        return {state: (score, self._trail(trail)) for state, (score, trail) in exits.items()}

    def _trail(self, trail: tuple | None) -> list[int]:
        edges = []
        while trail:
            edge, trail = trail
            edges.append(edge)
        return [i for edge in reversed(edges) for i in self.ids(edge)]


def is_word_start(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] == MARK and text[at - 1] != MARK


def label(state: State) -> str:
    return f"{state[0]} {state[1]}"


def chunk_matrix(model: Model, text: str, begin: int, end: int) -> dict:
    """The matrix of the chunk begin .. end of ``text`` with the ids behind every entry.

    ``text`` reaches ``model.longest`` characters beyond the chunk on both sides, less only at the document's ends.
    Ids of the path from entry i to exit j are heads[i] + middle + tails[j] where a word begins in the chunk,
    else heads[i * number of exits + j].
    """
    entries, exits = model.states(text, begin), model.states(text, end)
    one_exit = exits == [START]
    starts = [m.end() for m in re.finditer(f"[^{MARK}](?={MARK})", text[max(0, begin - 1) : end + 1])]
    starts = [x for x in (s + max(0, begin - 1) for s in starts) if begin <= x <= end]
    if begin == 0:
        starts.insert(0, 0)
    if end == len(text):
        starts.append(end)
    if not starts:
        table = [model.paths(text, e, begin, end, one_exit) for e in entries]
        cells = [row.get(x, (NONE, [])) for row in table for x in exits]
        return {"entries": entries, "exits": exits, "scores": [c[0] for c in cells], "heads": [c[1] for c in cells], "middle": None, "tails": None}
    first, last = starts[0], starts[-1]
    heads = [model.paths(text, e, begin, first, True).get(START, (NONE, [])) for e in entries]
    tail = model.paths(text, START, last, end, one_exit)
    tails = [tail.get(x, (NONE, [])) for x in exits]
    middle = model.bare.encode(text[first:last]) if last > first else []
    between = 0.0 if model.merges else float(sum(model.scores[i] for i in middle))
    scores = [h[0] + between + t[0] for h in heads for t in tails]
    return {"entries": entries, "exits": exits, "scores": scores, "heads": [h[1] for h in heads], "middle": middle, "tails": [t[1] for t in tails]}


@lru_cache(4)
def model_of(path: str) -> Model:
    return Model(path)


def _chunks(path: str, chunk_chars: int):
    """Giant documents to chunks with the characters around them; a row's key is its place in the scan."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, key = model_of(path), TaskContext.get().partitionId() << 33
        for part in parts:
            for at in range(part.num_rows):
                text = model.prefix + part.column(1)[at].as_py().replace(" ", MARK)
                for number, begin in enumerate(range(0, len(text), chunk_chars)):
                    low, high = max(0, begin - model.longest), min(len(text), begin + chunk_chars + model.longest)
                    row = [[key], [number], [text[low:high]], [begin - low], [min(len(text), begin + chunk_chars) - low]]
                    ends = [pa.array([low == 0]), pa.array([high == len(text)])]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(at, 1), *(pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))), *ends],
                        names=["id", "row", "chunk", "text", "begin", "end", "opens", "closes"],
                    )
                key += 1

    return run


_MATRIX = "entries array<string>, exits array<string>, scores array<double>, heads array<array<int>>, middle array<int>, tails array<array<int>>"


def _matrices(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        ints = pa.list_(pa.int32())
        kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(ints), ints, pa.list_(ints)]
        for part in parts:
            for row in part.to_pylist():
                found = chunk_matrix(model, row["text"], row["begin"], row["end"])
                found["entries"], found["exits"] = [*map(label, found["entries"])], [*map(label, found["exits"])]
                keys = [part.schema.field(n).type for n in ("id", "row", "chunk")]
                arrays = [pa.array([row[n]], t) for n, t in zip(("id", "row", "chunk"), keys)] + [pa.array([v], t) for v, t in zip(found.values(), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "row", "chunk", *found])

    return run


def combine(matrices: list[tuple[list[str], list[str], np.ndarray]]) -> list[tuple[int, int]]:
    """Max-plus product of a document's matrices in order, then the entry and exit number of every one."""
    best: dict[str, float] = {label(START): 0.0}
    trails = []
    for entries, exits, scores in matrices:
        reach = np.array([best.get(e, NONE) for e in entries])[:, None] + scores.reshape(len(entries), len(exits))
        trails.append((entries, exits, reach.argmax(axis=0)))
        best = dict(zip(exits, reach.max(axis=0).tolist()))
    if best.get(label(START), NONE) == NONE:
        raise ValueError("no path through the document")
    out, state = [], label(START)
    for entries, exits, source in reversed(trails):
        leave = exits.index(state)
        enter = int(source[leave])
        out.append((enter, leave))
        state = entries[enter]
    return out[::-1]


def _resolved(rows):
    import pandas as pd

    rows = rows.sort_values("chunk")
    pairs = combine([(list(e), list(x), np.asarray(s)) for e, x, s in zip(rows["entries"], rows["exits"], rows["scores"])])
    return pd.DataFrame({"row": rows["row"], "chunk": rows["chunk"], "enter": [p[0] for p in pairs], "leave": [p[1] for p in pairs]})


def _whole(path: str):
    """Documents of ordinary length: one chunk, encoded by the library."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                found = model.whole.encode(piece.column(1).to_pylist(), num_threads=1)
                ends = np.cumsum([0, *map(len, found)])
                flat = np.fromiter((i for ids in found for i in ids), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["id", "ids"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Piece ids of every row's whole text: id_col, ids.

    The ids are the library's own encoding of the text. Null counts as empty; an empty text has
    no ids. Rows that repeat an id or a text are encoded each. Other columns are not
    read; an empty table gives no rows. ``chunk_chars`` never changes the ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    giant = F.length("text") > chunk_chars
    short = source.filter(~giant).mapInArrow(_whole(model_path), f"id {kind}, ids array<int>")
    cut = source.filter(giant).mapInArrow(_chunks(model_path, chunk_chars), f"id {kind}, row long, chunk int, text string, begin int, end int, opens boolean, closes boolean")
    cut = stage(cut, "pieces-chunks")
    spread = cut.repartition(F.xxhash64("row", "chunk"))
    matrices = stage(spread.mapInArrow(_matrices(model_path), f"id {kind}, row long, chunk int, {_MATRIX}"), "pieces-matrices")
    # Matrices are few bytes but much work: dealt to all tasks whatever their size.
    narrow = matrices.select("row", "chunk", "entries", "exits", "scores").repartition(shuffle_width(docs.sparkSession), "row")
    resolved = narrow.groupBy("row").applyInPandas(_resolved, "row long, chunk int, enter int, leave int")
    met = matrices.join(resolved, ["row", "chunk"])
    ids = F.when(F.col("middle").isNull(), F.get("heads", F.col("enter") * F.size("exits") + F.col("leave"))).otherwise(
        F.concat(F.get("heads", "enter"), F.coalesce("middle", F.array().cast("array<int>")), F.get("tails", "leave"))
    )
    emitted = met.select("id", "row", F.struct("chunk", ids.alias("ids")).alias("piece"))
    joined = emitted.groupBy("id", "row").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    long = joined.select("id", F.flatten(F.transform("pieces", lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts of id lists: id_col, ``keep``, text, n_pieces, ids_crc32 (crc32 of the ids as little-endian 32-bit integers).

    A null list counts as empty. Rows are decoded one by one. As in the library, a word
    mark (U+2581) that stood in a text comes back as a space.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for part in parts:
            texts, counts, sums = [], [], []
            for ids in part.column(part.num_columns - 1):
                numbers = ids.values.to_numpy().astype("<i4")
                texts.append(model.whole.decode(numbers.tolist()))
                counts.append(len(numbers))
                sums.append(zlib.crc32(numbers.tobytes()))
            arrays = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], "text", "n_pieces", "ids_crc32"])

    lists = encoded.select(id_col, *keep, F.coalesce(ids_col, F.array().cast("array<int>")).alias("_ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema.fields[:-1])
    return lists.mapInArrow(batches, f"{kinds}, text string, n_pieces long, ids_crc32 long")

"""Token files and the SentencePiece scan against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from remitlens.llm.sentencepiece_scan import MARK, Model, chunk_matrix, combine, decode, encode, label
from remitlens.llm.token_files import WordEncoder, pack, read_ids, read_tokens, token_index, unpack, width_of, write_tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, shard int, ids string"
ODD = [
    "a  b", "a \n b", " a", " ", "<|endoftext|> x<|endoftext|> y", "a\t b  \n\n c d ", "'s 't ll's  'LL 12 3.4 é ñ ", "　 a 　b", "", None, "日本 語 ", "a\x1c b\x1c c",
    "\x85 a\xa0b", "a\nb c", "\na", "a\n", "x\n<|endoftext|>\ny", "same words same words\nsame words", "🙂🙃 " * 50, "the cat " * 20_000,
]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 20, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    packed = pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (unpack(packed, bits, 0, 1001) == ids).all() and (unpack(packed, bits, 77, 501) == ids[77:501]).all()
    assert len(unpack(packed, bits, 5, 5)) == 0


def test_width_is_minimal():
    assert [width_of(n) for n in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def test_word_encoder_equals_the_library():
    texts = [t or "" for t in ODD]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    coder = WordEncoder(BPE)
    assert [i.tolist() for i in coder.encode(texts)] == want
    assert [i.tolist() for i in coder.encode(texts[::-1])] == want[::-1]


@pytest.mark.parametrize("shards,block", [(1, 1 << 16), (5, 50)])
def test_token_files(spark, tmp_path, shards, block):
    data = [(i * 3 % 20, t, 7, "x") for i, t in enumerate(ODD)] + [(None, "no id", 1, None), (3, ODD[1], 7, "x"), (3, "other text", 7, "x")]
    docs, path = spark.createDataFrame(data, SCHEMA).repartition(4), str(tmp_path / "tokens")
    write_tokens(docs, path, BPE, block_ids=block, shards=shards)
    blocks = read_tokens(spark, path)
    got = sorted(map(tuple, token_index(blocks).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    tokenizer, want, start = Tokenizer.from_file(BPE), [], 0
    flat: list[int] = []
    for name, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((start, name, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        flat += ids
    assert got == want
    if shards == 1:
        assert read_ids(blocks, 0, 100, 4000).tolist() == flat[100:4000]
    empty = str(tmp_path / "empty")
    write_tokens(docs.filter("false"), empty, BPE)
    assert token_index(read_tokens(spark, empty)).count() == 0


def chunked(model, text, size):
    whole, matrices = model.prefix + text.replace(" ", MARK), []
    for begin in range(0, len(whole), size):
        low, high = max(0, begin - model.longest), min(len(whole), begin + size + model.longest)
        matrices.append(chunk_matrix(model, whole[low:high], begin - low, min(len(whole), begin + size) - low))
    pairs = combine([([*map(label, m["entries"])], [*map(label, m["exits"])], np.array(m["scores"])) for m in matrices])
    out = []
    for m, (i, j) in zip(matrices, pairs):
        out += m["heads"][i * len(m["exits"]) + j] if m["middle"] is None else m["heads"][i] + m["middle"] + m["tails"][j]
    return out


HARD = [
    "a" * 300, "    " * 40, "x    y     z" * 20, "日本語テキスト" * 40, "🙂🙃 a▁b \n\t q" * 30, "1234567890" * 30, "  lead" * 9, "https://www.example.com/abc/def?x=1&y=2" * 10,
    "internationalizationnationalization" * 20, "Und die Straße, où l'été – ¿qué? – naïve coöperation. " * 9,
]


def test_scan_equals_the_library_for_byte_pairs():
    model = Model(PIECES)
    rng = random.Random(3)
    mixed = ["".join(rng.choice("ab  thein▁é日.\n") for _ in range(400)) for _ in range(10)]
    for text in HARD + mixed:
        for size in (17, 64, 250):
            assert chunked(model, text, size) == model.whole.encode(text), (text[:40], size)


def unigram_file(path):
    """The same vocabulary as a unigram model with scores without ties."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto.FromString(open(PIECES, "rb").read())
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    rng = random.Random(0)
    for p in spec.pieces:
        if p.type == proto.ModelProto.SentencePiece.NORMAL:
            p.score = -4.0 - rng.random() * 8 / len(p.piece)
    path.write_bytes(spec.SerializeToString())
    return str(path)


def test_scan_equals_the_library_for_unigrams(tmp_path):
    model = Model(unigram_file(tmp_path / "u.model"))
    assert not model.merges
    same = sum(chunked(model, t, size) == model.whole.encode(t) for t in HARD for size in (17, 64))
    total = sum(model.scores[i] for t in HARD for i in model.whole.encode(t))
    ours = sum(model.scores[i] for t in HARD for i in chunked(model, t, 64))
    # Texts that repeat a phrase have paths of equal score; the score itself is the library's.
    assert same >= 16 and abs(total - ours) < 1e-3 * abs(total)


def test_encode_and_decode_tables(spark):
    data = [(i, t, 7, "x") for i, t in enumerate(ODD + HARD)] + [(None, "no id " * 900, 1, None), (3, HARD[1], 7, "x"), (3, HARD[7] * 40, 7, "x"), (3, HARD[7] * 40, 7, "x")]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((repr(i), sp.encode(t or "")) for i, t, *_ in data)
    for size in (16_384, 700):
        encoded = encode(docs, PIECES, chunk_chars=size)
        assert sorted((repr(r.doc_id), r.ids) for r in encoded.collect()) == want
    back = decode(encoded, PIECES, keep=("ids",)).collect()
    plain = lambda t: (t or "").replace(MARK, " ")
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(i), sp.decode(sp.encode(t or ""))) for i, t, *_ in data)
    assert sum(r.text in {plain(t) for _, t, *_ in data} for r in back) >= len(data) - 2
    assert all(r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) for r in back)
    assert encode(docs.filter("false"), PIECES).count() == 0

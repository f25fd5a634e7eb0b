"""Lexical search, decontamination and token alignment against brute force."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from remitlens.llm.common import terms_of
from remitlens.llm.decontaminate import WindowSet, decontaminate, find_contamination
from remitlens.llm.lexical import rank_documents
from remitlens.llm.token_align import PairIndex, Tokenizers, _bucket_bits, align_tokens, spread

DOCS = "doc_id long, text string, rank int, n_words string, spans int, id string"
ITEMS = "item_id long, text string, score int, row int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def prose(seed, n, kinds=60):
    r = np.random.default_rng(seed)
    return " ".join(f"{'wé'[int(i) % 2]}{int(i)}{'.' if i % 7 == 0 else ''}" for i in np.minimum(r.zipf(1.4, n), kinds))


def test_terms_are_the_pattern():
    text = "AbÉ-c9\x7f_d e\tFÀ g|h{i}"
    assert [t.decode() for t in terms_of(text.encode())] == words(text) == ["abÉ", "c9", "d e", "fÀ g", "h", "i"]


def brute_ranks(docs, items, k):
    counted = [(d, Counter(words(t))) for d, t in docs if words(t)]
    big_n, big_l = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def texts():
    docs = [(i, prose(i, 5 + i % 60)) for i in range(160)]
    docs += [(500 + i, docs[3][1]) for i in range(90)]  # a third of all rows is one text
    docs += [(900, None), (901, ""), (902, " .,\n"), (903, "w1 w2 " * 20_000), (3, docs[3][1]), (3, "w1"), (None, docs[5][1]), (None, "w2 w4")]
    docs += [(905, "Say <|endoftext|> and </s> plainly"), (906, "\n\n lead  and   trail \n"), (907, "a▁b and \U0001f600 \x00\x01"), (908, "é" * 3000)]
    return docs


@pytest.fixture(scope="module")
def tests():
    items = [(i, prose(i * 3, 12 + i % 30)) for i in range(25)]
    items += [(30, None), (31, ""), (32, "--"), (33, "W1"), (34, "nowhere found"), (35, " ".join(f"w{i}" for i in range(1, 200))), (36, "w1 w3 wé é2"), (None, "w9 é8 w7"), (5, "w1 w1"), (5, "w1 w1")]
    return items


def frame(spark, texts):
    return spark.createDataFrame([(d, t, 1, "x", 2, "y") for d, t in texts], DOCS).repartition(7)


def item_frame(spark, tests):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in tests], ITEMS)


@pytest.mark.parametrize("k,block", [(5, 1 << 17), (50, 1 << 17), (50, 40)])
def test_ranks_equal_brute_force(spark, texts, tests, k, block, monkeypatch):
    got = rank_documents(frame(spark, texts), item_frame(spark, tests), k=k, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute_ranks(texts, tests, k), key=order)


def test_ranks_of_empty_tables(spark, texts, tests):
    docs, items = frame(spark, texts), item_frame(spark, tests)
    assert rank_documents(docs.filter("false"), items).count() == 0
    assert rank_documents(docs, items.filter("false")).count() == 0
    assert rank_documents(docs.filter("text is null"), items).count() == 0


def brute_hits(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, marked, held = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if names := windows.get(tuple(w[at : at + n])):
                    marked.update(range(at, at + n))
                    held |= names
        out.append((d, len(w), len(marked), tuple(sorted(held)), bool(marked)))
    return out


@pytest.fixture(scope="module")
def leaky(texts, tests):
    inside = [(2000 + i, prose(99 + i, 30) + " " + " ".join(tests[i][1].split()[2:14]).replace("w", "W") + "! tail") for i in range(12)]
    edge = [(3000, tests[7][1]), (3001, " ".join(tests[7][1].split()[:9])), (3002, (tests[7][1] + " \n") * 200), (3003, " ".join(tests[7][1].split()[:10]))]
    return texts + inside + edge


@pytest.mark.parametrize("size,block", [(10, 1 << 20), (4, 60), (1, 1 << 20)])
def test_hits_equal_brute_force(spark, leaky, tests, size, block):
    got = find_contamination(frame(spark, leaky), item_frame(spark, tests), window=size, block_words=block)
    rows = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(brute_hits(leaky, tests, size), key=repr)
    assert got.columns == ["doc_id", "text", "rank", "id", "n_words", "spans", "items", "n_hit", "contaminated"]


def test_spans_and_documents_are_removed(spark, leaky, tests):
    long = [(i, t) for i, t in tests if len(words(t)) >= 10]
    docs, items = frame(spark, leaky), item_frame(spark, long)
    verdicts = {(d, t): hit for (d, t), (_, _, _, _, hit) in zip(leaky, brute_hits(leaky, long, 10))}
    clean = decontaminate(docs, items, "documents")
    assert clean.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(repr(x) for x in leaky if not verdicts[x])
    rows = decontaminate(docs, items, "spans").collect()
    cut, first = {r.doc_id: r.text for r in rows}, dict(leaky)
    assert len(rows) == len(leaky) and sum(verdicts.values()) > 10 and {r.n_words for r in rows} == {"x"}
    assert cut[3000] == "" and cut[3001] == first[3001] and cut[900] is None
    assert cut[2000].startswith(prose(99, 30)) and cut[2000].endswith("! tail") and len(cut[2000]) < len(first[2000])
    with pytest.raises(ValueError):
        decontaminate(docs, items, "words")


def test_hits_of_empty_tables(spark, leaky, tests):
    docs, items = frame(spark, leaky), item_frame(spark, tests)
    assert find_contamination(docs.filter("false"), items).count() == 0
    none = find_contamination(docs, items.filter("false"), keep=("doc_id",))
    assert none.columns == ["doc_id", "n_words", "spans", "items", "n_hit", "contaminated"]
    assert none.count() == len(leaky) and none.filter("contaminated or n_hit > 0 or size(items) > 0").count() == 0


def test_colliding_windows_get_another_multiplier(monkeypatch):
    calls, plain = [], WindowSet.hashes

    def once(self, ids, length):
        calls.append(1)
        return np.zeros(max(0, len(ids) - length + 1), np.uint64) if len(calls) == 1 else plain(self, ids, length)

    monkeypatch.setattr(WindowSet, "hashes", once)
    known = WindowSet([("a", [b"x", b"y", b"z"])], 2)
    assert len(calls) == 2 and [h[:2] for h in known.hits(np.array([0, 1, -1, 1, 2]))] == [(0, 2), (3, 2)]


def test_pair_numbers_are_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 30_000))
    shards, n_buckets, rows = 1, 7, []
    for bucket in range(n_buckets):
        sizes, bits = _bucket_bits(keys[spread(keys) // shards % n_buckets == bucket])
        rows.append((bucket, sizes, np.packbits(bits, bitorder="little").tobytes()))
    index = PairIndex(rows, n_buckets, shards, keys)
    assert sorted(index.numbers(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.random.default_rng(4).integers(0, 1 << 40, 30_000), keys)
    assert (index.numbers(others) == -1).all()
    assert (PairIndex([], 1, 1, keys[:0]).numbers(keys) == -1).all()


def brute_alignment(docs):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    aligned = []
    for d, t in docs:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        pa = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        pb = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
        if not t or b"".join(pa) != (" " + t).encode() or b"".join(pb) != (" " + t).encode():
            aligned.append((d, [], [], [], [], []))
            continue
        sa, sb = spans(pa), spans(pb)
        links = []
        j = 0
        for i, (s, e) in enumerate(sa):
            while sb[j][1] <= s:
                j += 1
            q = j
            while q < len(sb) and sb[q][0] < e:
                links.append((a[i], b[q]))
                q += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, before = [], 0
        for c in cuts:
            groups.append(([a[i] for i, (_, e) in enumerate(sa) if before < e <= c], [b[i] for i, (_, e) in enumerate(sb) if before < e <= c]) if len(sa) < 3000 else None)
            before = c
        aligned.append((d, a, b, links, cuts, groups))
    counts = Counter(x for r in aligned for x in r[3])
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for d, a, b, links, cuts, groups in aligned:
        text = None if None in groups else ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(cuts), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), text))
    return out


@pytest.mark.parametrize("shard", [1 << 22, 400])
def test_alignment_equals_brute_force(spark, texts, shard):
    real = [(7000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    docs = texts + real
    got = align_tokens(frame(spark, docs), A, B, shard_pairs=shard)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = {repr(r[:7]): r[7] for r in brute_alignment(docs)}
    rows = got.collect()
    assert sorted(repr(tuple(r)[:7]) for r in rows) == sorted(repr(r[:7]) for r in brute_alignment(docs))
    assert all(want[repr(tuple(r)[:7])] in (None, r.groups) for r in rows)
    assert sum(r.n_a > 0 for r in rows) > 200 and {r.groups for r in rows if not r.n_a} == {""}


def test_alignment_of_empty_tables(spark, texts):
    docs = frame(spark, texts)
    assert align_tokens(docs.filter("false"), A, B).count() == 0
    rows = align_tokens(docs.filter("text is null or text = ''"), A, B).collect()
    assert len(rows) == 2 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows)


def test_words_of_regular_texts_are_encoded_once():
    """The ids are those of whole texts on both sides, though a word that comes again is not encoded again."""
    rng = np.random.default_rng(8)
    marks = ["a", "thing", "▁", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x85", "<|endoftext|>", "<0x41>", "</s>", "é", "日本", "\x00", "'s", "12", "..."]
    odd = ["".join(rng.choice(marks, rng.integers(1, 25))) for _ in range(300)] + [" ".join(rng.choice(marks, 12)) for _ in range(100)]
    plain = [" ".join(rng.choice(["some", "words", "that", "come", "again.\nAnd"], 200)) for _ in range(20)]
    both, seen = Tokenizers(A, B), []
    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    encode = both.bare.encode
    both.bare = type("Counting", (), {"encode": staticmethod(lambda texts, **k: seen.extend(texts) or encode(texts, **k))})
    for text, (a, b) in zip(odd + plain, both.encode(odd + plain)):
        want = (tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        spelled = [b"".join(names[i] for i in ids) for names, ids in zip((both.a_bytes, both.b_bytes), want)]
        assert (a.tolist(), b.tolist()) == (want if spelled == 2 * [(" " + text).encode()] else ([], []))
    seen.clear()
    assert sum(len(a) >= 200 for a, _ in both.encode(plain)) == 20 and not seen

"""Duplicate operators against brute force: exact, near, lines; mixing."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from remitlens.llm.components import components
from remitlens.llm.exact_dedup import deduplicated, duplicate_groups, golomb_decode, golomb_encode
from remitlens.llm.line_dedup import deduplicate_lines
from remitlens.llm.mixing import mix, permuted
from remitlens.llm.simhash import links_within_two, near_duplicates

SCHEMA = "doc_id long, text string, source string, id long, sha string, at int"


def rows(texts, sources=None):
    return [(i, t, (sources or ["a"])[i % len(sources or ["a"])], 7, "x", 3) for i, t in enumerate(texts)]


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j) for i, j in zip(r.integers(0, 10, n), r.integers(0, 40, n)))


@pytest.fixture(scope="module")
def texts():
    base = [prose(s, 120) for s in range(25)]
    near = [b + " tail" for b in base[:10]] + [b.upper() for b in base[10:14]]
    return [*base, *near, *base[:5], *([base[3]] * 40), None, "", " \t\n", "one", "one two", "ONE  two", "word " * 30_000]


def fingerprint(text, k=3):
    words = bytes((text or "").encode()).lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, texts):
    got = {r.doc_id: r for r in near_duplicates(table(spark, rows(texts))).collect()}
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)
    assert near_duplicates(table(spark, [])).count() == 0


def test_links_within_two_bits(spark):
    r = np.random.default_rng(1)
    seeds = r.integers(-(2**63), 2**63, 40)
    flips = [s ^ (1 << int(a)) ^ (1 << int(b)) for s in map(int, seeds) for a, b in r.integers(0, 63, (12, 2))]
    values = sorted({int(v) for v in [*seeds, *flips, 0, -1, 1, 3, 7, -(2**63), 2**63 - 1]})
    got = {(x.a, x.b) for x in links_within_two(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and len(want) > 500


def test_listed_points_are_not_broadcast(spark):
    """The list of points is 33 times its fingerprints, which alone would be small enough to broadcast."""
    prints = spark.createDataFrame([(x,) for x in (0, 1, 7)], "fp long")
    links = links_within_two(prints)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in links.collect()} == {(0, 1), (1, 7)}


def test_components_follow_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


@pytest.mark.parametrize("n,high", [(0, 10), (1, 5), (1000, 1001), (3000, 2**48)])
def test_golomb_round_trip(n, high):
    v = np.unique(np.random.default_rng(n).integers(0, high, n))
    assert (golomb_decode(golomb_encode(v)) == v).all()


def test_exact_groups_match_brute_force(spark, texts):
    data = rows(texts) + [(3, texts[3], "b", 1, "y", 1), (None, texts[3], "b", 1, "y", 1), (None, "lonely", None, None, None, None)]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    members = {}
    for r in data:
        members.setdefault(digest(r[1]), []).append(r[0])
    want = []
    for r in data:
        ids = members[digest(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, digest(r[1])))
    for parts in (1, 7):
        got = duplicate_groups(table(spark, data).repartition(parts)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = deduplicated(table(spark, data))
    assert kept.columns == SCHEMA.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")
    assert sorted(digest(r.text) for r in kept.collect()) == sorted(members)
    assert duplicate_groups(table(spark, [])).count() == 0


def brute_lines(data):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    first, out = {}, []
    order = lambda i: 2**63 if i is None else i
    for r in data:
        for line in (r[1] or "").split("\n"):
            first[key(line)] = min(order(r[0]), first.get(key(line), 2**64))
    for r in data:
        lines = (r[1] or "").split("\n")
        kept = [s for s in lines if len(key(s)) < 10 or first[key(s)] == order(r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def test_lines_match_brute_force(spark):
    shared = ["A shared line of text", "another shared line é", "  A Shared LINE of text\t", "short", "", "x" * 10, "ÉÉÉÉÉÉÉÉÉÉ", "éééééééééé"]
    r = np.random.default_rng(5)
    texts = ["\n".join([*(shared[i] for i in r.integers(0, len(shared), 6)), f"own line number {n}", "a shared line of text"]) for n in range(60)]
    texts += [None, "", "\n\n", " " * 50_000 + "x", "a shared line of text\n" * 3000]
    data = rows(texts) + [(7, texts[9], "b", 1, "y", 1), (None, texts[2], "b", 1, "y", 1), rows(texts)[5]]
    for batches, fanout in ((1, 2), (6, 3), (9, 2)):
        got = deduplicate_lines(table(spark, data), batches=batches, fanout=fanout)
        assert set(SCHEMA.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")) < set(got.columns)
        assert sorted(repr((x.doc_id, x.n_lines, x.n_dropped, x.kept_text)) for x in got.collect()) == brute_lines(data)
    assert deduplicate_lines(table(spark, [])).count() == 0


def targets(sizes):
    """The contract's rule, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        unit = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else unit * weight[s] for s in order}
        capped |= over


def test_mix_meets_targets(spark):
    r = np.random.default_rng(2)
    names = ["big"] * 6 + ["b", "c", "é", None, "Z"]
    data = [(i, " ".join(["w"] * int(r.integers(0, 400))), names[i % len(names)], 7, "x", 3) for i in range(600)]
    data += [(900, None, "empty", 1, "", 1), (901, "tiny bit", "tiny", 1, "", 1), (901, "tiny bit", "tiny", 1, "", 1), (None, "a b c", "b", 1, "", 1)]
    got = mix(table(spark, data)).collect()
    assert len(got) == len(data)
    sizes, taken = {}, {}
    for d in data:
        sizes[d[2]] = sizes.get(d[2], 0) + len((d[1] or "").split())
    for g in got:
        assert 0 <= g.taken <= 3 * g["size"] and g.source_size == sizes[g.source]
        taken[g.source] = taken.get(g.source, 0) + g.taken
    for s, want in targets(sizes).items():
        assert abs(next(g.target for g in got if g.source == s) - want) < 1e-6
        assert abs(taken[s] - want) <= max(2, 64, 0.01 * want)
    again = mix(table(spark, data).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, again)))
    assert mix(table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 255, 1000, 4097])
def test_permuted_is_a_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(9))).collect()]
    assert sorted(got) == list(range(n))
    assert n < 17 or got != sorted(got)

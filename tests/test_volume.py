"""What operators write and send between tasks: figures that once grew faster than the input."""

import os

import numpy as np
from pyspark.sql import functions as F

from remitlens.operators import retrieval as rt
from remitlens.session import stage


def test_staged_tables_are_compressed_well(spark):
    assert all(f.endswith(".zstd.parquet") for f in (os.path.basename(x) for x in stage(spark.range(10), "codec").inputFiles()))


def test_lines_meet_orders_while_narrow(spark, tmp_path):
    """With joins that shuffle, the first shuffle of order lines holds nothing of parts and suppliers."""
    from remitlens.catalog.claims import claims_view

    tables = {
        "lineitem": "SELECT 1L l_orderkey, 1 l_linenumber, 1L l_partkey, 1L l_suppkey, 100.0D l_extendedprice, 'R' l_returnflag, 'F' l_linestatus, timestamp'2024-01-05' l_shipdate",
        "orders": "SELECT 1L o_orderkey, 1L o_custkey, timestamp'2024-01-01' o_orderdate",
        "customer": "SELECT 1L c_custkey, 'BUILDING' c_mktsegment",
        "part": "SELECT 1L p_partkey, 'PROMO' p_type, 'Brand#12' p_brand, 3 p_size",
        "supplier": "SELECT 1L s_suppkey, 1 s_nationkey, 10.0D s_acctbal",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    view = claims_view(spark, str(tmp_path))
    row = view.first()
    assert (row.claim_id, row.insurance_type, row._filing_days, row._prior_auth_obtained, row._necessity_documented) == ("1-1-1-1-10000", "medicaid", 4.0, True, False)
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    inner = max(plan.splitlines(), key=lambda x: len(x) - len(x.lstrip(" :+-")) if "l_orderkey" in x and "Join" in x else 0)
    assert "o_orderkey" in inner


def test_queries_are_sent_once_per_group_of_clusters(spark, monkeypatch):
    """Vectors without structure: every query must look at nearly every cluster, but travels to few groups."""
    staged = {}

    def kept(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(rt, "stage", kept)
    x = np.random.default_rng(5).standard_normal((600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = rt.nearest(df, df, id_col="id", vec_col="v", k=3, exclude_self=True, block=(64, 12)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = (unit @ unit.T).round(9)
    np.fill_diagonal(sim, -2)
    assert {(r.query_id, r["rank"], r.neighbour_id) for r in got} == {(q, r + 1, int(i)) for q in range(600) for r, i in enumerate(np.lexsort((np.arange(600), -sim[q]))[:3])}
    trips = staged["visits"].select(F.sum(F.size("_visits")), F.count("*"), F.max("_group")).first()
    assert trips[0] > 600 * 30 and trips[1] <= 600 * (trips[2] + 1) and trips[2] < 2 * rt.VISIT_GROUPS


def test_index_gives_the_payload_that_is_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2, "x") for i in range(6)], "id long, v array<double>, y int, t string")
    index = rt.build_index(df, id_col="id", vec_col="v", keep=3, payload=["y", "t"])
    assert rt.nearest(df, index, id_col="id", vec_col="v", k=2, payload=["y"]).columns[4:] == ["y"]
    assert rt.nearest(df, index, id_col="id", vec_col="v", k=2).columns[4:] == ["y", "t"]


def test_chunks_are_matched_without_vectors(spark, monkeypatch):
    """Scores equal brute force; what is written of a chunk is its norm."""
    from remitlens.operators import evidence as ev

    staged = {}

    def kept(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(ev, "stage", kept)
    texts = ["fee fee paid", "claim paid late late", "zzz", "claim fee"]
    rows = [(1, "claim fee", texts, texts[:1]), (2, "paid zzz", texts[1:], ["other words"]), (3, None, texts, None)]
    cases = spark.createDataFrame(rows, "case_id long, requirement_text string, full_record_chunks array<string>, submitted_chunks array<string>")
    got = {(r.case_id, r.side): (r.chunk, r.score) for r in ev.lexical_matches(cases).collect()}
    corpus = sorted({*texts, "claim fee", "paid zzz"})
    idf = {t: np.log((1 + len(corpus)) / (1 + sum(t in c.split() for c in corpus))) + 1 for c in corpus for t in c.split()}

    def vector(text):
        v = {t: text.split().count(t) * idf[t] for t in text.split() if t in idf}
        size = sum(w * w for w in v.values()) ** 0.5
        return {t: w / size for t, w in v.items()}

    def cosine(a, b):
        b = vector(b)
        return round(sum(w * b.get(t, 0.0) for t, w in vector(a).items()) / (1 + ev.SMALL) ** 2, 9)

    for case, asked, record, sent in rows[:2]:
        for side, chunks in (("record", record), ("submitted", sent)):
            scores = [cosine(asked, c) for c in chunks]
            best = max(range(len(chunks)), key=lambda i: (scores[i], -i))
            assert got[case, side][0] == chunks[best] and abs(got[case, side][1] - scores[best]) < 2e-9
    assert got[3, "record"] == (texts[0], 0.0) and (3, "submitted") not in got
    assert staged["norms"].columns == ["text_key", "norm"] and "vectors" not in staged


def test_replicate_numbers_are_drawn_once_per_filter(spark):
    from remitlens.operators.sampling import PRIME, bootstrap_weights

    plan = bootstrap_weights(spark.range(5), "id", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count(f"% {PRIME}") <= 20 for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter"))


def test_neighbours_are_named_without_joins(spark, monkeypatch):
    """Payload and ids travel with the rows that are compared; keys of rows are not written, and only repeated queries are joined."""
    staged = {}

    def kept(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(rt, "stage", kept)
    rows = [(i, [float(i), 1.0], f"p{i % 2}", i % 3) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, v array<double>, a string, y int")
    same = {"id_col": "id", "vec_col": "v", "k": 2, "anchor_col": "a", "anchor_weight": 5.0}
    index = rt.build_index(df, id_col="id", vec_col="v", keep=3, payload=["y"], anchor_col="a", anchor_weight=5.0)
    hits = rt.nearest(df, index, exclude_self=True, payload=["y"], **same)
    assert "Join" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert "_i1" not in staged["index"].columns and staged["home"].columns == ["_q1", "_q2", "_own", "_hits"]
    got = {(r.query_id, r["rank"]): (r.neighbour_id, r.y) for r in hits.collect()}
    assert len(got) == 24 and all(n % 2 == q % 2 and n != q and y == n % 3 for (q, _), (n, y) in got.items())
    # Two more ids for the vector of row 3: each id gets the same neighbours.
    asked = df.unionByName(spark.createDataFrame([(i, [3.0, 1.0], "p1", 0) for i in (100, 101)], df.schema))
    found = rt.nearest(asked, index, payload=["y"], **same).collect()
    lists = {q: sorted((r["rank"], r.neighbour_id, r.y) for r in found if r.query_id == q) for q in (3, 100, 101)}
    assert len(found) == 28 and lists[3] == lists[100] == lists[101] and lists[3][0] == (1, 3, 0)


def test_blocks_are_joined_for_keys_of_several_only(spark):
    """Without a key of several blocks nothing is joined to learn its blocks; a small part of a large index still is."""
    df = spark.createDataFrame([(i, [float(i), 1.0], f"p{i}") for i in range(40)], "id long, v array<double>, a string")
    index = rt.build_index(df, id_col="id", vec_col="v", keep=3, anchor_col="a", anchor_weight=5.0)
    asked = rt._shaped(df, "v", "a", None, "_q1", "_q2").withColumns({"_own": F.struct("id"), "_home": F.lit(0)})
    search = rt._block_search(index.geometry, 3, False, False)
    plans = [rt._block_join(q, index.placed, ["_anchor", "_home"], (8, 8), search)._jdf.queryExecution().optimizedPlan().toString() for q in (asked, asked.where("id < 3"))]
    assert "Join" not in plans[0] and "Join" in plans[1]


def test_reasons_come_from_the_evidence_list(spark):
    """As ``top_reasons`` has them, with one join of the neighbours instead of two."""
    from remitlens.operators import support as sp

    rows = [("a", 1, "x", 0.9, 1, "late"), ("a", 2, "y", 0.8, 1, "auth"), ("a", 3, "z", 0.7, 1, "auth"), ("a", 4, "w", 0.6, 1, None), ("a", 5, "v", 0.5, 0, "late")]
    rows += [("b", 1, "x", 0.9, 0, None)]
    rows += [("c", i + 1, f"n{i}", 0.5, 1, r) for i, r in enumerate(("d", "c", "b", "a", "d"))]
    hits = spark.createDataFrame([(*r, "p") for r in rows], "query_id string, rank int, neighbour_id string, similarity double, denied int, reason_code string, provider_id string")
    claims = spark.createDataFrame([(c, 0.4) for c in "abcd"], "claim_id string, prob double")
    made = sp.decision_support(claims, hits)
    want = {r.query_id: r.top_reasons for r in sp.top_reasons(hits).collect()}
    assert {r.claim_id: r.top_reasons for r in made.collect()} == {c: want.get(c) for c in "abcd"} and set(want) == {"a", "c"}
    assert made.schema["top_reasons"].dataType.simpleString() == "array<struct<reason:string,n:bigint>>"
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_visits_return_what_may_still_win(spark):
    """A cluster that is visited after the own one gives no rows that cost more than the worst already found; ties stay."""
    import pyarrow as pa

    x = [[0.0], [1.0], [2.0], [3.0]]
    index = pa.table({"_vec": x, "_anchor": [""] * 4, "_time": [0] * 4, "_first": [1, 2, 3, 4], "_members": [[{"id": i}] for i in (1, 2, 3, 4)], "_home": [0, 0, 1, 1]})
    asked = pa.table({"_q1": [1, 2, 3], "_q2": [1, 2, 3], "_own": [{"query_id": i} for i in (1, 2, 3)], "_vec": [[0.0]] * 3, "_anchor": [""] * 3, "_time": [0] * 3, "_visits": [[0, 1], [0, 1], [1]], "_tau": [1.0, None, 3.0]})
    search = rt._block_search(rt._Geometry("euclidean", 0.0), 3, False, False)
    got = {r["_q1"]: [(h["_cost"], h["_members"][0]["id"]) for h in r["_hits"]] for r in search(asked, index).to_pylist()}
    assert got == {1: [(0.0, 1), (1.0, 2)], 2: [(0.0, 1), (1.0, 2), (4.0, 3)]}

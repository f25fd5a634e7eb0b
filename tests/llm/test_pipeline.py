"""The pipeline's stages against brute force, each on its own input; the registered queries against DuckDB."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from oracle import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from remitlens.llm.mixing import mix
from remitlens.llm.quality import quality_scores
from remitlens.llm.queries import ORACLE_SQL, QUERIES
from test_dedup import brute_components, fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.fixture(scope="module")
def documents(spark, sf):
    """The documents with rows of every odd kind."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.filter("doc_id = 11").first().text
    odd = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, text, "en", None, 5), (9003, text, "en", None, 5), (9004, "word " * 30_000, "en", "src2", 1), (9005, text + " and", "en", "src3", 9)]
    other = docs.filter("doc_id = 12").first().text
    odd += [(None, other + " once more", "en", "src4", 9), (None, "A text without an id, good and plain as any other. " * 30, "en", "src4", 9), (9003, other + " again and again", "en", "src5", 9)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(5)


def test_stages_in_order(spark, sf, documents, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact dedup", "near dedup", "source mix", "sentence pieces"]
    stages = dict(corpus_pipeline.STAGES)

    accepted = staged(spark, tmp_path, stages["quality"](spark, documents, sf), "quality")
    assert accepted.columns == COLUMNS
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = quality_scores(corpus_pipeline.keyed(documents), labels, keep=("_row", "text")).collect()
    good = {(r.doc_id, r.text) for r in scores if r.predicted == 1}
    before = documents.collect()
    assert sorted(map(repr, accepted.collect())) == sorted(repr(r) for r in before if (r.doc_id, r.text) in good)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    assert all(any(i == d for d, _ in good) for i, q in marked.items() if q == 1)

    # Every stage gets all documents here, so that odd rows reach it.
    unique = staged(spark, tmp_path, stages["exact dedup"](spark, documents, sf), "exact")
    assert unique.columns == COLUMNS
    low = lambda i: -1 if i is None else i
    keep: dict = {}
    for r in before:
        keep[r.text or ""] = max(low(r.doc_id), keep.get(r.text or "", -1))
    after = unique.collect()
    assert sorted((low(r.doc_id), r.text or "") for r in after) == sorted((i, t) for t, i in keep.items())

    apart = staged(spark, tmp_path, stages["near dedup"](spark, unique, sf), "near")
    assert apart.columns == COLUMNS
    # Numbered by id, null last: the smallest number of a component is the row that stays.
    rows = sorted(after, key=lambda r: (r.doc_id is None, low(r.doc_id)))
    roots = set(brute_components({n: fingerprint(r.text) for n, r in enumerate(rows)}).values())
    named = {n: (rows[n].doc_id, rows[n].text) for n in roots}
    got = [(r.doc_id, r.text) for r in apart.collect()]
    assert sorted(got, key=repr) == sorted(named.values(), key=repr)
    assert any(d is None for d, _ in got)

    mixed = staged(spark, tmp_path, stages["source mix"](spark, apart, sf), "mix")
    assert mixed.columns == COLUMNS
    times: dict = {}
    for r in mixed.collect():
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    assert set(times) <= set(got)
    for r in mix(corpus_pipeline.keyed(apart), id_col="_row").join(corpus_pipeline.keyed(apart).select("_row", "doc_id", "text"), "_row").collect():
        share = r.taken / r["size"] if r["size"] else 1
        assert int(share) <= times.get((r.doc_id, r.text), 0) <= int(share) + 1 and times.get((r.doc_id, r.text), 0) <= 3

    tokens = stages["sentence pieces"](spark, mixed, sf).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((low(d), sp.encode(t or "")) for (d, t), n in times.items() for _ in range(n))
    assert sorted((low(r.doc_id), r.ids) for r in tokens) == want and all(r.n_pieces == len(r.ids) for r in tokens)
    digests = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in times}
    assert {r.decoded_sha256 for r in tokens} == digests


def test_stages_take_an_empty_table(spark, sf, documents):
    nothing = documents.filter("false")
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, nothing, sf).count() == 0


def test_run_keeps_what_the_stages_keep(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    known = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= known


def test_every_operator_is_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert [n for n in queries if n.startswith("op")] == [n for n in QUERIES] and "pipeline" in queries
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(sql) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name]) == []

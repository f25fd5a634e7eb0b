"""License scan, vector search, quality rules and page text."""

import numpy as np
import pytest

from remitlens.llm.ann import CrossPolytope, hadamard, nearest
from remitlens.llm.html_text import extract_pages, main_text
from remitlens.llm.license_scan import LICENSES, TemplateIndex, _WordHashes, gram_hashes, scan_licenses, scan_text, winnow
from remitlens.llm.quality import STATISTICS, RuleModel, fit_rules, held_out, quality_scores, statistics, text_statistics, tree_rules

DOCS = "doc_id long, text string, template string, score int"


def test_winnow_covers_every_window():
    for seed in range(20):
        h = np.random.default_rng(seed).integers(0, 6, 50).astype(np.uint64)
        want = {max(i for i in range(s, s + 3) if h[i] == h[s : s + 3].min()) for s in range(48)}
        assert set(winnow(h).tolist()) == want
    assert winnow(np.array([5, 2, 2], np.uint64)).tolist() == [2] and len(winnow(np.zeros(0, np.uint64))) == 0


def test_every_template_is_found_where_it_stands():
    index, known = TemplateIndex(LICENSES), _WordHashes()
    for name, template in LICENSES.items():
        text = f"Some prose before it.\n  {template.upper()}\nand more, {template.replace(' ', '  ')} twice " + template
        found = [m for m in scan_text(text, index, known) if m[0] == name]
        assert len(found) == 3 and all(m[4] == 1.0 for m in found)
        assert text[found[0][1] : found[0][2]].rstrip(".") == template.upper().rstrip(".")


def test_changed_templates_keep_their_coverage():
    index, known = TemplateIndex(LICENSES), _WordHashes()
    words = LICENSES["BSD-text"].split()
    changed = " ".join(words[:8] + ["very", "new"] + words[8:12] + words[14:])
    (match,) = [m for m in scan_text("é " * 40 + changed + " end", index, known) if m[0] == "BSD-text"]
    assert match[3] == len(words) - 2 and abs(match[4] - (len(words) - 2) / len(words)) < 1e-9
    assert not scan_text("Released under the law of gravity, said the MIT president", index, known)
    line = "Released under the MIT License. "
    assert len(scan_text(line * 3000, index, known)) == 3000


def test_license_table(spark):
    data = [(1, None, "x", 1), (2, "", "x", 1), (3, LICENSES["MIT"] + " x " * 200_000, "x", 1), (3, LICENSES["MIT"], "x", 1), (None, LICENSES["MIT"], "x", 1)]
    got = scan_licenses(spark.createDataFrame(data, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.template, r.span_start, r.coverage) for r in got) == [(0, "MIT", 0, 1.0), (3, "MIT", 0, 1.0), (3, "MIT", 0, 1.0)]
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        TemplateIndex({"short": "too few words"})
    assert len(gram_hashes(["a", "b"], _WordHashes())) == 0


def brute_nearest(data, queries, k):
    good = {i: np.array(v, float) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted({q for q, _ in queries if q in good}):
        scored = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("spread", [False, True])
def test_nearest_recall_and_copies(spark, spread):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:600] = x[7]  # a third of all rows is one vector
    if spread:
        x *= rng.uniform(0.2, 3.0, (900, 1)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [float("nan")] * 24), (2080, [float("inf")] + [1.0] * 23), (None, x[0].tolist()), (0, x[0].tolist())]
    table = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, score int")
    queries = [r for r in data if r[0] is not None and r[0] % 20 == 0]
    got = nearest(table, table.filter("vec_id % 20 = 0"), k=10).collect()
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want: dict = {}
    for q, rank, i, s in brute_nearest(data, queries, 10):
        want.setdefault(q, []).append((rank, i, s))
    assert set(found) == set(want)
    recall = np.mean([len({i for _, i, _ in found[q]} & {i for _, i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    for q, rows in found.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11)) and q not in {i for _, i, _ in rows}
        assert all(a[2] > b[2] - 1e-12 and (abs(a[2] - b[2]) > 1e-12 or a[1] < b[1]) for a, b in zip(rows, rows[1:]))
    full = nearest(table, table.filter("vec_id % 20 = 0"), k=10, probes=4096, tables=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in full) == [(q, r, i) for q, r, i, _ in brute_nearest(data, queries, 10)]
    assert nearest(table.filter("false"), table).count() == 0


def test_refined_cells_hold_their_own_vector():
    x = np.random.default_rng(1).standard_normal((50, 20))
    hashes = CrossPolytope(20, 2, 4, 0.0, 3)
    unit = hashes.lift(x, True)
    assert np.allclose(np.linalg.norm(hadamard(unit), axis=1), 1, atol=1e-5)
    for t in range(2):
        home = hashes.cells(unit, t, 1)[:, 0]
        probes = hashes.cells(unit, t, 12)
        assert (probes[:, 0] == home).all() and all(len(set(p)) == 12 for p in probes.tolist()) and probes.max() < 64 * 8


def good(i):
    r = np.random.default_rng(i)
    return " ".join("".join(r.choice(list("etaoinshrdlu"), r.integers(2, 9))) for _ in range(80)) + "."


def bad(i):
    return " ".join(w + "$$$" for w in good(i).split()) if i % 2 else "buy now " * 60


def test_quality_rules_learn_held_out_rows(spark):
    texts = [(i, (good(i) if i % 3 else bad(i)), "t", 1) for i in range(600)]
    texts += [(700, None, "t", 1), (701, "", "t", 1), (702, good(1) * 300, "t", 1), (5, good(5), "t", 1), (None, good(2), "t", 1)]
    docs = spark.createDataFrame(texts, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(5, None), (99_999, 1), (None, 0)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert 80 < len(tested) < 160 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in tested]) > 0.98
    again = quality_scores(docs.repartition(7), labels.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    none = quality_scores(docs, labels.filter("false")).collect()
    assert {round(r.score, 3) for r in none} == {0.5}
    assert quality_scores(docs.filter("false"), labels).count() == 0


def test_statistics_are_finite_and_shares(spark):
    for text in ("", " \n", "a", "é" * 9, "\U0001f600!!", "A B\nA B\nA B", "x" * 100_000):
        row = dict(zip(STATISTICS, text_statistics(text)))
        assert all(np.isfinite(v) for v in row.values())
        assert all(0 <= row[s] <= 1 for s in STATISTICS if s not in ("log_chars", "log_words", "word_length", "line_words"))
    assert statistics(spark.createDataFrame([(1, None, "x", 1)], DOCS)).count() == 1


def test_rules_follow_the_trees(spark):
    text = """RandomForestClassificationModel: uid=x, numTrees=1, numClasses=2, numFeatures=18
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 2 <= 0.25)
      Predict: 0.0
     Else (feature 2 > 0.25)
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 1.0
"""
    s = STATISTICS[2]
    assert tree_rules(text) == {((s, True, 0.5),), ((s, True, 0.25),), ((s, False, 0.25), (s, True, 0.5)), ((s, False, 0.5),)}
    model = RuleModel(0.0, ((2.0, ((s, True, 0.5),)),))
    rows = spark.createDataFrame([(0.4,), (0.6,)], f"{s} double").select(model.score().alias("p")).collect()
    assert abs(rows[0].p - 1 / (1 + np.exp(-2))) < 1e-12 and rows[1].p == 0.5
    assert held_out is not None and fit_rules is not None


NAV = "<nav><ul><li><a href='/x'>Menu one</a></li><li><a>Two</a></ul></nav>"
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body>{NAV}<div class='ad'>Buy this</div><article><h1>Head &amp; line</h1><p>One  two<br>three<p><b>Four</b>th</article><footer>&copy; me</footer>", "Head & line\nOne two three\nFourth"),
    ("<body><header>Site</header><div id='cookie-notice'>We use cookies</div><main><p>Short.</p><form><label>Mail</label></form><p>End.</p><div class=comments><p>First!</div></main><aside>Side</aside>", "Short.\nEnd."),
    ("<p>No markup around this long paragraph of text, which goes on.</p><ul><li><a>Link a</a><li><a>Link b</a></ul>", "No markup around this long paragraph of text, which goes on."),
    ("<article><header><h1>Own header</h1></header><p>a &lt; b &#8364; &nbsp; c</p><script>if (1 < 2) document.write('</p>')</script><!-- gone --></article>", "Own header\na < b € c"),
    ("", ""), ("just text", "just text"), ("<", "<"), ("<p", ""), ("a < b", "a < b"), ("<nav>only</nav>", ""), ("<article><p title='a > b'>quoted</p><div class=\"sidebar\">no</div>tail</article>", "quoted\ntail"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert main_text(html) == text


def test_page_table(spark):
    data = [(i, "u", h, "t", 1) for i, (h, _) in enumerate(PAGES)] + [(50, None, None, "t", 1), (0, "u", PAGES[0][0], "t", 1), (51, "u", "<a \"" * 100_000, "t", 1), (52, "u", "<div>" * 20_000 + "deep", "t", 1)]
    got = extract_pages(spark.createDataFrame(data, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r.page_id: r for r in got.collect()}
    assert {i: rows[i].text for i in range(len(PAGES))} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert rows[50].text == "" and rows[52].text == "deep" and all(r.n_chars == len(r.text) for r in rows.values())
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

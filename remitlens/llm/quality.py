"""Quality scores from a sparse rule ensemble.

1. Every text gets a row of statistics (shares of characters, words, repeats, lines).
2. Shallow trees are grown on labelled rows. Each path from a root to a node is a rule,
   a conjunction of thresholds on statistics.
3. A logistic model with an L1 penalty weighs the rules; most weights become zero.
4. The rules left are compiled to one Spark column expression: the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import stage, text_of

STATISTICS = [
    "log_chars", "log_words", "letters", "upper", "digits", "stops", "symbols", "pipes", "non_ascii", "word_length",
    "long_words", "distinct_words", "repeats", "top_word", "bare_words", "shouted_words", "line_words", "distinct_lines",
]
#: Labelled rows that the fit reads at most; they are chosen by the hash of their id.
FIT_ROWS = 20_000
TREES, DEPTH, PENALTY = 24, 3, 0.002


def _class(chars: bytes) -> np.ndarray:
    member = np.zeros(256)
    member[list(chars)] = 1
    return member


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SPACE = b" \t\n\x0b\x0c\r"
_STOPS = b".,;:!?'\"-()"
# A lead byte of a multi-byte character counts as the character, a continuation byte as nothing.
_BY_BYTE = np.stack(
    [
        _class(bytes(range(128)) + bytes(range(192, 256))), _class(_LETTERS + bytes(range(192, 256))), _class(_UPPER), _class(_LETTERS), _class(b"0123456789"), _class(_STOPS),
        _class(bytes(c for c in range(33, 127) if c not in _LETTERS + b"0123456789" + _STOPS)), _class(b"|"), _class(bytes(range(192, 256))), _class(_SPACE),
    ],
    axis=1,
)


def text_statistics(text: str) -> list[float]:
    """The STATISTICS of one whole text; all are finite, an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _BY_BYTE
    chars, letters, upper, ascii_letters, digits, stops, symbols, pipes, foreign, space = counts.tolist()
    words = raw.split()
    n, solid = max(1, len(words)), max(1.0, chars - space)
    unique: dict[bytes, int] = {}
    for w in words:
        unique[w] = unique.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(chars), np.log1p(len(words)), letters / solid, upper / max(1.0, ascii_letters), digits / solid, stops / solid, symbols / solid,
        pipes / solid, foreign / solid, solid / n, sum(len(w) * c for w, c in unique.items() if len(w) > 15) / max(1, len(raw)), len(unique) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, max(unique.values(), default=0) / n, sum(c for w, c in unique.items() if not w.strip(b"!?.,;:|*&%$#-0123456789")) / n,
        sum(c for w, c in unique.items() if len(w) > 1 and w.isupper()) / n, np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep`` and the STATISTICS of every row's whole text (null counts as empty)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(part.num_columns - 1)
            table = np.array([text_statistics(texts[i].as_py()) for i in range(len(texts))], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=[*part.schema.names[:-1], *STATISTICS])

    source = docs.select(F.col(id_col).alias("id"), *keep, text_of(text_col).alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(batches, ", ".join([*kinds, *(f"{s} double" for s in STATISTICS)]))


#: A condition (statistic, is_below, threshold); a rule holds where all its conditions do.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; score() compiles them to a column of probabilities."""

    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def score(self) -> Column:
        margin = F.lit(self.intercept)
        for weight, rule in self.rules:
            margin = margin + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def holds(rule: tuple[Condition, ...]) -> Column:
    tests = [F.col(s) <= v if below else F.col(s) > v for s, below, v in rule]
    first, *rest = tests
    for test in rest:
        first = first & test
    return first


def tree_rules(description: str) -> set[tuple[Condition, ...]]:
    """Every path of the trees in a Spark ML ensemble's debug string, thresholds of one statistic merged."""
    found: set[tuple[Condition, ...]] = set()
    path: list[Condition] = []
    for line in description.splitlines():
        match = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if match:
            # The string indents a tree's root by four and every level by one more.
            depth = len(match[1]) - 4
            path = [*path[:depth], (STATISTICS[int(match[3])], match[4] == "<=", float(match[5]))]
            bounds: dict[tuple[str, bool], float] = {}
            for s, below, v in path:
                bounds[s, below] = (min if below else max)(v, bounds.get((s, below), v))
            found.add(tuple(sorted((s, below, v) for (s, below), v in bounds.items())))
    return found


def fit_rules(labelled: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 7) -> RuleModel:
    """Fit on rows with the STATISTICS and a 0/1 ``label`` (other labels are ignored).

    At most about ``fit_rows`` rows are read, chosen by the hash of their id. With
    labels of one class only, or none, the model is a constant.
    """
    known = labelled.filter(F.col("label").isin(0, 1)).select("id", "label", *STATISTICS)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        odds = (counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)
        return RuleModel(float(np.log(odds)), ())
    share = int(min(1.0, fit_rows / sum(counts.values())) * (1 << 30))
    sample = known.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < share).withColumn("label", F.col("label").cast("double"))
    # A fixed order and number of partitions make reruns agree.
    sample = stage(sample.repartitionByRange(4, "id").sortWithinPartitions("id"), "quality-sample")
    assembled = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(sample)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="0.4", subsamplingRate=0.6, seed=seed).fit(assembled)
    rules = sorted(tree_rules(forest.toDebugString))
    if not rules:
        return RuleModel(float(np.log((counts[1] + 1) / (counts[0] + 1))), ())
    fired = sample.select("label", *(holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(fired).select("label", "features")
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(fired)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel(float(lasso.intercept), tuple((w, r) for w, r in zip(weights, rules) if w))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is divisible by 5 never teach the model."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, fit_rows: int = FIT_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every row of ``docs``: id_col, ``keep``, held_out, score, predicted (1 if score >= cut).

    ``labels`` has id_col and quality. A document with several labels counts with the
    largest; labels of unknown ids, null labels and null ids teach nothing. Null and
    empty texts are scored like any other. Without labels of both classes every score is
    the smoothed share of ones. Other columns are not read; an empty table gives no rows.
    """
    stats = stage(statistics(docs, id_col, text_col, keep), "quality-statistics")
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("label"))
    teaching = stats.filter(~held_out("id")).dropDuplicates(["id"]).join(known, "id")
    model = fit_rules(teaching, fit_rows)
    scored = stats.select(F.col("id").alias(id_col), *keep, held_out("id").alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))

"""Additive per-row attribution of linear and tree models as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.sources.tables import scratch_path

MAX_NODES = 2_000_000
#: Path features up to which a leaf's values are tabled once for all blocks.
TABLE_FEATURES = 5


def linear_attribution(df: DataFrame, id_col: str, columns: Sequence[str], weights: Sequence[float], means: Sequence[float]) -> DataFrame:
    """weight * (x - mean) per feature, long form; plain columns."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.lit(float(m)))).alias("value"))
            for c, w, m in zip(columns, weights, means)
        ]
    )
    return df.select(id_col, F.inline(cells))


@dataclass(frozen=True)
class Leaf:
    """A leaf as the list of distinct features on its path.

    ``spans``: feature -> (low, high], the values that reach the leaf.
    ``covers``: feature -> share of training rows that stay on the path at its splits.
    """

    value: float
    spans: dict
    covers: dict


def tree_leaves(spark, model) -> list[Leaf]:
    """Weighted leaves of a fitted Spark tree or tree ensemble.

    Nodes come from the model's own saved table. Their number is set by the model
    (trees x 2^depth), not by the data.
    """
    path = scratch_path(spark, "model")
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data")
    flat = nodes.select("treeID", "nodeData.*") if "treeID" in nodes.columns else nodes.select(F.lit(0).alias("treeID"), "*")
    rows = flat.take(MAX_NODES + 1)
    if len(rows) > MAX_NODES:
        raise ValueError("model too large to attribute")
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = type(model).__name__.startswith("GBT")
    # Boosting: log-odds are twice the margin. Forests: mean of leaf shares.
    scale = [2.0 * w for w in weights] if boosted else [w / sum(weights) for w in weights]
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r

    def value(r) -> float:
        if boosted:
            return r["prediction"]
        total = sum(r["impurityStats"])
        return r["impurityStats"][1] / total if total else 0.0

    out: list[Leaf] = []

    def walk(tree: dict, r, spans: dict, covers: dict, w: float) -> None:
        if r["leftChild"] < 0:
            out.append(Leaf(w * value(r), spans, covers))
            return
        if r["split"]["numCategories"] >= 0:
            raise ValueError(f"feature {r['split']['featureIndex']} is split by categories; only thresholds can be attributed")
        feature, at = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
        low, high = spans.get(feature, (-np.inf, np.inf))
        for child, span in ((r["leftChild"], (low, min(high, at))), (r["rightChild"], (max(low, at), high))):
            c = tree[child]
            share = c["rawCount"] / r["rawCount"] if r["rawCount"] else 0.0
            walk(tree, c, {**spans, feature: span}, {**covers, feature: covers.get(feature, 1.0) * share}, w)

    for t, tree in trees.items():
        walk(tree, tree[0], {}, {}, scale[t])
    return out


def _leaf_values(leaf: Leaf, present: np.ndarray) -> np.ndarray:
    """Shapley value of each path feature (columns) for rows that follow the path at the features ``present``.

    A leaf's game has one player per distinct path feature: present, it is worth
    whether the row follows the path; absent, the share of training rows that do.
    The value is multiplicative, so subset sums are coefficients of a polynomial.
    """
    n, d = present.shape
    share = list(leaf.covers.values())
    weight = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
    out = np.zeros((n, d))
    for j in range(d):
        poly = np.zeros((d, n))
        poly[0] = 1.0
        for m in range(d):
            if m == j:
                continue
            shifted = np.zeros_like(poly)
            shifted[1:] = poly[:-1] * present[:, m]
            poly = poly * share[m] + shifted
        out[:, j] = leaf.value * (weight[:, None] * poly).sum(axis=0) * (present[:, j] - share[j])
    return out


def _bits(patterns: np.ndarray, d: int) -> np.ndarray:
    return (patterns[:, None] >> np.arange(d)) & 1


def leaf_tables(leaves: Sequence[Leaf]) -> list[np.ndarray | None]:
    """Values of a leaf for each of its 2^d patterns of present features; none where d is above TABLE_FEATURES."""
    sizes = [len(leaf.spans) for leaf in leaves]
    return [np.ascontiguousarray(_leaf_values(leaf, _bits(np.arange(1 << d), d)).T) if 0 < d <= TABLE_FEATURES else None for leaf, d in zip(leaves, sizes)]


def _shapley_block(x: np.ndarray, leaves: Sequence[Leaf], tables: Sequence[np.ndarray | None] | None = None) -> np.ndarray:
    """Path-dependent Shapley values of a block of rows.

    Rows with the same pattern of present features have the same values at a leaf, so they are looked up: in the leaf's
    table, or among the patterns of this block. Leaves of all trees share their spans' tests.
    """
    columns, phi = np.ascontiguousarray(x.T), np.zeros((x.shape[1], len(x)))
    tests: dict[tuple, np.ndarray] = {}

    def inside(feature: int, span: tuple) -> np.ndarray:
        if (feature, *span) not in tests:
            tests[feature, *span] = ((columns[feature] > span[0]) & (columns[feature] <= span[1])).astype(np.int64)
        return tests[feature, *span]

    for leaf, table in zip(leaves, tables or leaf_tables(leaves)):
        pattern = np.zeros(len(x), np.int64)
        for m, (feature, span) in enumerate(leaf.spans.items()):
            pattern |= inside(feature, span) << m
        if table is None and leaf.spans:
            seen, pattern = np.unique(pattern, return_inverse=True)
            table = _leaf_values(leaf, _bits(seen, len(leaf.spans))).T
        for j, feature in enumerate(leaf.spans):
            phi[feature] += table[j].take(pattern)
    return phi.T


def base_value(leaves: Sequence[Leaf]) -> float:
    """Attribution of no feature at all: the cover-weighted mean output."""
    return float(sum(leaf.value * np.prod(list(leaf.covers.values()) or [1.0]) for leaf in leaves))


def tree_attribution(df: DataFrame, id_col: str, leaves: Sequence[Leaf], names: Sequence[str], features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row with an attribution column per feature (plus ``keep``)."""
    shared = df.sparkSession.sparkContext.broadcast((list(leaves), leaf_tables(leaves)))
    flat = df.select(id_col, *keep, vector_to_array(features).alias("_x"))
    kept = [f for f in flat.schema.fields if f.name != "_x"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` double" for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            phi = _shapley_block(np.stack(pdf["_x"].to_numpy()), *shared.value)
            values = pd.DataFrame(phi, columns=list(names), index=pdf.index)
            yield pd.concat([pdf.drop(columns="_x"), values], axis=1)

    return flat.mapInPandas(run, schema)


def long_attribution(wide: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names])
    return wide.select(id_col, F.inline(cells))

"""Exact top-k similarity search as a partitioned join, and features of the result.

Index rows are clustered around sampled pivots. A query first searches its own
cluster, which gives it a k-th best score; the triangle inequality then rules out
every cluster that cannot beat it, and only the rest are searched. Pair scores
exist only inside a task's matrix product, and a block's k best of a query leave it
as one row. Blocks are bounded on both sides, so a cluster holding a third of the
table is many tasks. A query goes to the clusters it must still visit in groups of
near ones: it is sent once per group, and the group's tasks search only the clusters
it asked for. Equal vectors are searched once. An index row travels with its ids and payload,
and a query with its id, so a block's result needs no join to be named.

Without anchors the Euclidean metric has boxes for clusters: cells of a tree of cuts,
and the distance to a cell's box is the bound. Coordinates that take few values, such as
one-hot blocks, rule out whole cells, which a ball around a pivot does not.

Vectors may carry an *anchor* (here: the provider): a virtual one-hot block of a
given weight. It is never materialised, so its vocabulary may be any size.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitlens.session import small_rows, stage

MAX_PIVOTS = 1024
SLACK = 1e-6
DIGITS = 9
INDEX_COLS = ["_vec", "_anchor", "_time", "_first", "_members"]
#: Rows, and numbers, of one side of a block that is visited; smaller indexes are cut into so many groups.
VISIT_ROWS = 1 << 16
VISIT_VALUES = 1 << 22
VISIT_GROUPS = 8
#: Cells that stand for one block of index rows; rows of a cell, and numbers in all, of the sample that cells are cut from.
CELLS_PER_BLOCK = 4
CELL_SAMPLE = 32
SAMPLE_VALUES = 1 << 20


def l2_normalize(vec) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    v = F.col(vec) if isinstance(vec, str) else vec
    v = F.transform(v, lambda x: x.cast("double"))
    return F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x * x,
        lambda total: F.transform(v, lambda x: x / F.when(total == 0, F.lit(1.0)).otherwise(F.sqrt(total))),
    )


def _keys(*cols: Column) -> tuple[Column, Column]:
    """128 digest bits of a row's search identity."""
    return F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)


class _Geometry:
    """Scores, pivot distances and bounds of one metric; plain NumPy on blocks."""

    def __init__(self, metric: str, weight: float):
        if metric not in ("cosine", "euclidean"):
            raise ValueError(f"unknown metric {metric!r}")
        self.metric, self.weight = metric, weight

    def norms(self, x: np.ndarray, anchored: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(axis=1) + self.weight**2 * anchored)
        return np.where(n == 0, 1.0, n)

    def cost(self, q, qa, i, ia) -> np.ndarray:
        """Smaller is better: minus the cosine, or the squared distance."""
        if self.metric == "euclidean":
            return np.maximum((q * q).sum(1)[:, None] + (i * i).sum(1)[None, :] - 2.0 * (q @ i.T), 0.0)
        dots = q @ i.T
        if self.weight:
            known = qa != ""
            dots = dots + self.weight**2 * ((qa[:, None] == ia[None, :]) & known[:, None])
        return -np.round(dots / (self.norms(q, qa != "")[:, None] * self.norms(i, ia != "")[None, :]), DIGITS)

    def best(self, q, qa, i, ia, fetch: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query and index positions of the ``fetch`` lowest costs per query, and those costs.

        The product form of the squared distance loses digits when norms are large against
        distances. It only makes a short list, around a common centre and with a
        margin above its rounding error; the list is scored again from the differences.
        """
        if self.metric != "euclidean":
            cost = self.cost(q, qa, i, ia)
            cost = cost if allowed is None else np.where(allowed, cost, np.inf)
            r, c = _top(cost, fetch)
            return r, c, cost[r, c]
        centre = i.mean(axis=0)
        a, b = q - centre, i - centre
        rough = self.cost(a, qa, b, ia)
        margin = 8 * q.shape[1] * np.finfo(float).eps * (np.sqrt((a * a).sum(1)) + np.sqrt((b * b).sum(1)).max()) ** 2
        if allowed is not None:
            rough = np.where(allowed, rough, np.inf)
        k = min(fetch, rough.shape[1])
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * margin + 2 * 10.0**-DIGITS
        r, c = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        exact = np.concatenate([((q[r[s : s + 65536]] - i[c[s : s + 65536]]) ** 2).sum(1) for s in range(0, len(r), 65536)] or [np.zeros(0)])
        exact = np.round(exact, DIGITS)
        order = np.lexsort((c, exact, r))
        r, c, exact = r[order], c[order], exact[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], c[keep], exact[keep]

    def to_pivots(self, x: np.ndarray, anchored: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distance (or angle) to each pivot, the pivot taken under the row's own anchor."""
        if self.metric == "euclidean":
            # From the differences, pivot by pivot: bounds need every digit.
            return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1)
        w2 = (self.weight**2 * anchored)[:, None]
        length = np.sqrt((pivots * pivots).sum(1)[None, :] + w2)
        cos = (x @ pivots.T + w2) / (self.norms(x, anchored)[:, None] * np.where(length == 0, 1.0, length))
        return np.arccos(np.clip(cos, -1.0, 1.0))

    def base_angles(self, x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return _Geometry("cosine", 0.0).to_pivots(x, np.zeros(len(x)), pivots)

    def base_share(self, x: np.ndarray, anchored: np.ndarray) -> np.ndarray:
        """Part of a row's length outside its anchor block."""
        return np.sqrt((x * x).sum(1)) / self.norms(x, anchored)

    def best_cost(self, distance: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Lowest cost any row within ``radius`` of a pivot can have."""
        gap = np.maximum(distance - radius - 1e-9 * distance, 0.0)
        return gap**2 if self.metric == "euclidean" else -np.cos(gap)


@dataclass
class _Cells:
    """Cells of near vectors: a tree of cuts, and the box around each cell's rows."""

    dim: np.ndarray  # coordinate of a node's cut, -1 at a leaf
    cut: np.ndarray  # values up to it go left
    left: np.ndarray  # node on the left; at a leaf its cell
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def grow(cls, sample: np.ndarray, most: int) -> tuple["_Cells", np.ndarray]:
        """At most ``most`` cells, the largest cut first, and the mean of each cell's sample."""
        nodes: list[list] = [[-1, 0.0, 0, 0]]
        open_, done = [(-len(sample), 0, np.arange(len(sample)))], []
        while open_:
            _, node, rows = heapq.heappop(open_)
            found = _cut(sample[rows]) if len(open_) + len(done) + 1 < most else None
            if found is None:
                done.append((node, rows))
                continue
            d, c = found
            goes = sample[rows, d] <= c
            nodes[node] = [d, c, len(nodes), len(nodes) + 1]
            for some in (rows[goes], rows[~goes]):
                heapq.heappush(open_, (-len(some), len(nodes), some))
                nodes.append([-1, 0.0, 0, 0])
        for cell, (node, _) in enumerate(done):
            nodes[node][2] = cell
        dim, cut, left, right = (np.array(x) for x in zip(*nodes))
        means = np.stack([sample[rows].mean(axis=0) for _, rows in done])
        return cls(dim, cut.astype(float), left, right, np.zeros_like(means), np.zeros_like(means)), means

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return self.left[node]
            at = node[inner]
            node[inner] = np.where(x[inner, self.dim[at]] <= self.cut[at], self.left[at], self.right[at])

    def best_cost(self, x: np.ndarray) -> np.ndarray:
        """Lowest squared distance any row of a cell can have; in parts that stay in a processor's cache."""
        out = np.zeros((len(x), len(self.low)))
        for a in range(0, len(x), 256):
            part, own = x[a : a + 256], out[a : a + 256]
            for j in range(x.shape[1]):
                value = part[:, j, None]
                gap = np.maximum(self.low[:, j] - value, value - self.high[:, j])
                np.maximum(gap, 0.0, out=gap)
                own += gap * gap
        # Products of the blocks and this sum round differently.
        return out * (1 - 1e-9)


def _cut(x: np.ndarray) -> tuple[int, float] | None:
    """The cut near some coordinate's median that takes most variance out of the rows; None for equal rows."""
    n = len(x)
    if n < 2:
        return None
    ordered = np.sort(x, axis=0)
    middle = ordered[n // 2]
    below, upto = (x < middle).sum(axis=0), (x <= middle).sum(axis=0)
    k = np.where((below > 0) & ((upto == n) | (np.abs(below - n / 2) <= np.abs(upto - n / 2))), below, upto)
    every = np.arange(x.shape[1])
    sums = np.cumsum(ordered, axis=0)
    left, whole = sums[np.maximum(k, 1) - 1, every], sums[-1]
    apart = np.where(k < n, (whole - left) / np.maximum(n - k, 1) - left / np.maximum(k, 1), 0.0)
    gain = k * (n - k) * apart * apart
    d = int(gain.argmax())
    if not gain[d] > 0:
        return None
    a, b = ordered[k[d] - 1, d], ordered[k[d], d]
    middle = a + (b - a) / 2
    return d, float(middle if middle < b else a)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, 1))


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The column as one array."""
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix; null vectors and vectors of several lengths are an error."""
    lists = _whole(column)
    sizes = pc.unique(pc.list_value_length(lists)).to_pylist()
    if not len(lists):
        return np.zeros((0, 1))
    if len(sizes) != 1 or sizes[0] is None:
        raise ValueError("vectors must not be null and must have one length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), sizes[0])


def _top(cost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the k lowest costs per row; ties by column order."""
    k = min(k, cost.shape[1])
    limit = np.partition(cost, k - 1, axis=1)[:, k - 1 : k]
    rows, cols = np.nonzero((cost <= limit) & np.isfinite(cost))
    order = np.lexsort((cols, cost[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(cost.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def _block_search(geometry: _Geometry, fetch: int, timed: bool, cross: bool):
    """Cogroup function: best ``fetch`` index rows of this block per query of this block, as one row with a list.

    Queries with a list ``_visits`` are compared with the index rows of those clusters only, and rows that cost more
    than the query's ``_tau`` are left out.
    """

    def pairs(part: dict, who: np.ndarray | slice, index: dict, rows: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        qa, ia = part["_anchor"][who], index["_anchor"][rows]
        allowed = None
        if timed:
            allowed = index["_time"][rows][None, :] < part["_time"][who][:, None]
        if cross:
            other = qa[:, None] != ia[None, :]
            allowed = other if allowed is None else allowed & other
        return geometry.best(part["_vec"][who], qa, index["_vec"][rows], ia, fetch, allowed)

    def visited(part: dict, lists: pa.Array, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asking = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        wanted = lists.flatten().to_numpy()
        found = []
        for cluster, rows in index["_clusters"].items():
            who = asking[wanted == cluster]
            if len(who):
                r, c, cost = pairs(part, who, index, rows)
                found.append((who[r], rows[c], cost))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        r, c, cost = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((c, cost, r))
        r, c, cost = r[order], c[order], cost[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < fetch
        return r[keep], c[keep], cost[keep]

    def held(table: pa.Table) -> dict:
        return {"_vec": _vectors(table["_vec"]), "_time": table["_time"].to_numpy(), "_anchor": table["_anchor"].to_pandas().to_numpy()}

    def search(queries: pa.Table, index: pa.Table) -> pa.Table:
        members = index.schema.field("_members").type
        hit = pa.struct([pa.field("_cost", pa.float64()), pa.field("_members", members)])
        kind = pa.schema([*(queries.schema.field(c) for c in ("_q1", "_q2", "_own")), pa.field("_hits", pa.list_(pa.field("element", hit)))])
        if not queries.num_rows or not index.num_rows:
            return kind.empty_table()
        index = index.take(pa.array(index["_first"].to_pandas().reset_index(drop=True).sort_values(kind="stable").index.to_numpy()))
        known, listed = held(index), _whole(index["_members"])
        if "_visits" in queries.column_names:
            homes = index["_home"].to_numpy()
            known["_clusters"] = {c: np.flatnonzero(homes == c) for c in np.unique(homes)}
        out = [kind.empty_table()]
        for a in range(0, queries.num_rows, 1024):
            part = queries.slice(a, 1024)
            asked = held(part)
            r, c, cost = visited(asked, _whole(part["_visits"]), known) if "_visits" in queries.column_names else pairs(asked, slice(None), known, slice(None))
            if "_tau" in queries.column_names:
                some = ~(cost > part["_tau"].to_numpy()[r])
                r, c, cost = r[some], c[some], cost[some]
            if len(r):
                cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                hits = pa.StructArray.from_arrays([pa.array(cost, pa.float64()), listed.take(pa.array(c))], fields=list(hit))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(r)), pa.int32()), hits, type=kind.field("_hits").type)
                own = part.select(["_q1", "_q2", "_own"]).take(pa.array(r[cuts]))
                out.append(pa.Table.from_arrays([*(_whole(own[c]) for c in own.column_names), lists], schema=kind))
        return pa.concat_tables(out)

    return search


def _types(queries: DataFrame, index: DataFrame) -> str:
    """Schema of what a block search returns."""
    own, members = (df.schema[c].dataType.simpleString() for df, c in ((queries, "_own"), (index, "_members")))
    return f"_q1 long, _q2 long, _own {own}, _hits array<struct<_cost:double,_members:{members}>>"


def _block_join(queries: DataFrame, index: DataFrame, keys: Sequence[str], block: tuple[int, int], search) -> DataFrame:
    """Search every (query block, index block) pair that shares ``keys``."""
    q_rows, i_rows = block
    nq = queries.groupBy(*keys).agg(F.ceil(F.count("*") / q_rows).cast("int").alias("_nq"))
    ni = index.groupBy(*keys).agg(F.ceil(F.count("*") / i_rows).cast("int").alias("_ni"), F.count("*").alias("_rows"))
    # Written first: when it is small, neither side is shuffled to learn its blocks.
    sizes = stage(nq.join(ni, list(keys)), "sizes")
    met = sizes.agg(F.sum("_rows")).first()[0] or 0
    if 2 * met >= index.count():
        # Most of the index is asked for: only keys of several blocks, few by their size, have to be known.
        sizes, how = sizes.where("_nq > 1 OR _ni > 1"), "left"
        alone = not sizes.take(1)
    else:
        how, alone = "inner", False

    def sized(df: DataFrame) -> DataFrame:
        if alone:
            return df.withColumns({"_nq": F.lit(1), "_ni": F.lit(1)})
        return df.join(sizes.drop("_rows"), list(keys), how).withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_nq", "_ni")})

    q = sized(queries).withColumn("_qb", F.pmod(F.col("_q1"), F.col("_nq"))).withColumn("_ib", F.explode(F.sequence(F.lit(0), F.col("_ni") - 1)))
    own = _keys(F.col("_anchor"), F.col("_time"), F.col("_vec"))[0]
    i = sized(index).withColumn("_ib", F.pmod(own, F.col("_ni"))).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
    by = [*keys, "_qb", "_ib"]
    q = q.select(*by, "_q1", "_q2", "_own", "_vec", *[c for c in ("_anchor", "_time", "_visits", "_tau") if c in queries.columns and c not in by])
    i = i.select(*by, *[c for c in (*INDEX_COLS, "_home") if c not in by])
    by = [F.col(c).cast("long").alias(c) if c in ("_qb", "_ib") else F.col(c) for c in by]
    return q.groupBy(*by).cogroup(i.groupBy(*by)).applyInArrow(search, _types(queries, index))


def _ids_first(hits: Column) -> Column:
    """Hits in the order of cost, then of their rows' smallest id."""
    first = lambda h: F.array_min(F.transform(h["_members"], lambda m: m["id"]))
    keyed = F.transform(hits, lambda h: F.struct(h["_cost"].alias("_cost"), first(h).alias("_first"), h["_members"].alias("_members")))
    return F.transform(F.array_sort(keyed), lambda h: F.struct(h["_cost"].alias("_cost"), h["_members"].alias("_members")))


def _best(hits: DataFrame, fetch: int) -> DataFrame:
    """One row per query with its ``fetch`` best index vectors, from one row per query and block."""
    merged = hits.groupBy("_q1", "_q2").agg(F.first("_own", ignorenulls=True).alias("_own"), F.flatten(F.collect_list("_hits")).alias("_hits"))
    return merged.select("_q1", "_q2", "_own", F.slice(_ids_first(F.col("_hits")), 1, fetch).alias("_hits"))


def _to_beat(fetch: int) -> Column:
    """Cost of the fetch-th row found so far, counting copies; null when fewer were found."""
    start = F.struct(F.lit(0).alias("found"), F.lit(None).cast("double").alias("cost"))
    return F.aggregate(
        "_hits",
        start,
        lambda acc, h: F.struct(
            (acc["found"] + F.size(h["_members"])).alias("found"),
            F.when((acc["found"] < fetch) & (acc["found"] + F.size(h["_members"]) >= fetch), h["_cost"]).otherwise(acc["cost"]).alias("cost"),
        ),
        lambda acc: acc["cost"],
    )


def _grouped(pivots: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Group number of every cluster: near clusters together, at most ``most`` rows in a group of several."""
    group, open_, n = np.zeros(len(pivots), np.int32), [np.arange(len(pivots))], 0
    while open_:
        some = open_.pop()
        if len(some) == 1 or sizes[some].sum() <= most:
            group[some], n = n, n + 1
            continue
        x = pivots[some]
        some = some[np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")]
        half = int(np.searchsorted(np.cumsum(sizes[some]), sizes[some].sum() / 2))
        cut = min(max(half, 1), len(some) - 1)
        open_ += [some[:cut], some[cut:]]
    return group


@dataclass
class VectorIndex:
    """A prepared index: deduplicated, clustered and written once, searched many times."""

    anchors: DataFrame  # (_anchor, _np): how many of the pivots an anchor's rows are spread over
    placed: DataFrame  # distinct vectors with their cluster and up to ``keep`` payload rows
    pivots: np.ndarray
    clusters: dict[int, tuple[float, float, float, int]]  # cluster -> (radius, base radius, base share, rows)
    metric: str
    weight: float
    anchored: bool
    timed: bool
    keep: int
    payload: list[str]
    block: tuple[int, int]
    cells: _Cells | None = None  # Euclidean without anchors: the tree behind the clusters

    @property
    def geometry(self) -> _Geometry:
        return _Geometry(self.metric, self.weight)

    def save(self, path: str) -> None:
        """Write vectors, payload and settings as tables under ``path``."""
        spark = self.placed.sparkSession
        self.anchors.write.mode("overwrite").parquet(f"{path}/anchors")
        self.placed.write.mode("overwrite").parquet(f"{path}/placed")
        head = {
            "pivots": self.pivots.tolist(), "clusters": [[k, *v] for k, v in self.clusters.items()], "metric": self.metric,
            "weight": self.weight, "anchored": self.anchored, "timed": self.timed, "keep": self.keep, "payload": self.payload, "block": list(self.block),
            "cells": self.cells and {k: v.tolist() for k, v in vars(self.cells).items()},
        }
        spark.createDataFrame([(json.dumps(head),)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VectorIndex":
        head = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
        head["pivots"] = np.array(head["pivots"], dtype=np.float64)
        head["clusters"] = {int(k): tuple(v) for k, *v in head["clusters"]}
        head["block"] = tuple(head["block"])
        if head.get("cells"):
            head["cells"] = _Cells(**{k: np.array(v) for k, v in head["cells"].items()})
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("anchors", "placed")}
        return cls(**tables, **head)


def _shaped(df: DataFrame, vec_col: str, anchor_col: str | None, time_col: str | None, k1: str, k2: str) -> DataFrame:
    """Add vector, anchor, day and the digest pair that identifies equal search rows."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))
    anchor = F.coalesce(F.col(anchor_col).cast("string"), F.lit("")) if anchor_col else F.lit("")
    day = F.unix_date(F.col(time_col).cast("date")).cast("long") if time_col else F.lit(0).cast("long")
    return df.withColumns({"_vec": vec, "_anchor": anchor, "_time": day}).withColumns(
        dict(zip((k1, k2), _keys(F.col("_anchor"), F.col("_time"), F.col("_vec"))))
    )


def _place(df: DataFrame, columns: Sequence[str], anchors: DataFrame, geometry: _Geometry, pivots: np.ndarray, cells: _Cells | None = None) -> DataFrame:
    """Assign every row to its cell, or to the nearest of its anchor's pivots, with what the bounds need to know.

    An anchor with few rows uses few pivots (the first ones), so that one very
    large anchor does not scatter the small ones.
    """

    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, known = _vectors(batch.column("_vec")), (batch.column("_anchor").to_pandas() != "").to_numpy().astype(float)
            if cells is not None:
                home, far = cells.home(x), np.zeros(len(x))
                base, share = far, far + 1.0
            else:
                far = geometry.to_pivots(x, known, pivots)
                far[np.arange(len(pivots))[None, :] >= batch.column("_np").to_numpy()[:, None]] = np.inf
                home = far.argmin(axis=1)
                row = np.arange(len(x))
                # A zero vector has no direction: its cluster can never be ruled out.
                zero = ~x.any(axis=1) & (geometry.metric == "cosine")
                far = np.where(zero, np.pi, far[row, home])
                base = np.where(zero, np.pi, geometry.base_angles(x, pivots)[row, home])
                share = geometry.base_share(x, known)
            kept = {c: batch.column(c) for c in (*columns, "_np")}
            placed = {"_home": pa.array(home.astype(np.int32)), "_far": pa.array(far), "_base": pa.array(base), "_share": pa.array(share)}
            yield pa.RecordBatch.from_pydict(kept | placed)

    # With one pivot every anchor has one.
    counted = df.join(anchors, "_anchor", "left").withColumn("_np", F.coalesce("_np", F.lit(1))) if len(pivots) > 1 else df.withColumn("_np", F.lit(1))
    counted = counted.select(*columns, "_np")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema.fields)
    return counted.mapInArrow(run, f"{kept}, _home int, _far double, _base double, _share double")


def build_index(
    index: DataFrame,
    *,
    id_col: str,
    vec_col: str,
    keep: int,
    metric: str = "cosine",
    anchor_col: str | None = None,
    anchor_weight: float = 0.0,
    time_col: str | None = None,
    payload: Sequence[str] = (),
    block: tuple[int, int] = (8192, 4096),
) -> VectorIndex:
    """Prepare index rows for searches of up to ``keep`` results (exclusions included).

    Equal vectors share one search row that lists its ``keep`` first members;
    surplus copies are cut before the shuffle, so a vector with very many copies
    costs no more than ``keep`` rows per task.
    """
    geometry = _Geometry(metric, anchor_weight if anchor_col else 0.0)
    shaped = _shaped(index, vec_col, anchor_col, time_col, "_i1", "_i2").select(
        "_i1", "_i2", "_vec", "_anchor", "_time", F.struct(F.col(id_col).alias("id"), *payload).alias("_member")
    )
    w = Window.partitionBy("_i1", "_i2").orderBy("_member.id")
    reps = stage(
        shaped.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= keep)
        .groupBy("_i1", "_i2")
        .agg(
            F.first("_vec").alias("_vec"), F.first("_anchor").alias("_anchor"), F.first("_time").alias("_time"),
            F.min("_member.id").alias("_first"), F.collect_list("_member").alias("_members"),
        )
        .select(*INDEX_COLS),
        "index",
    )
    spread_over = F.least(F.ceil(F.count("*") / block[1]), F.lit(MAX_PIVOTS)).cast("int")
    anchors = stage(reps.groupBy("_anchor").agg(spread_over.alias("_np")), "anchors")
    n_pivots = anchors.agg(F.max("_np")).first()[0] or 1
    boxed = metric == "euclidean" and not anchor_col and n_pivots > 1
    n_sampled, cells = n_pivots, None
    if boxed:
        # A cell too small to hold ``keep`` rows would give its queries nothing to beat.
        most = min(MAX_PIVOTS, n_pivots * min(CELLS_PER_BLOCK, max(1, block[1] // (4 * keep))))
        width = reps.select(F.size("_vec")).first()[0]
        n_sampled = max(n_pivots, min(most * CELL_SAMPLE, SAMPLE_VALUES // max(1, width)))
    sampled = small_rows(reps.orderBy(*_keys(F.col("_anchor"), F.col("_time"), F.col("_vec"))).select("_vec").limit(n_sampled), n_sampled, "pivots")
    pivots = np.array([r["_vec"] for r in sampled], dtype=np.float64)
    if boxed and np.isfinite(pivots).all():
        cells, pivots = _Cells.grow(pivots, most)
    else:
        pivots = pivots[:n_pivots]
    if len(pivots) <= 1 and not anchor_col:
        placed, clusters = reps.withColumn("_home", F.lit(0)), {}
    else:
        # With one pivot there is nothing to write: every row's cluster is the first.
        placed = _place(reps, ["_vec", "_anchor"], anchors, geometry, pivots, cells) if len(pivots) == 1 else stage(_place(reps, INDEX_COLS, anchors, geometry, pivots, cells), "placed")
        meta = placed.groupBy("_home").agg(F.max("_far").alias("far"), F.max("_base").alias("base"), F.max("_share").alias("share"), F.count("*").alias("n"))
        clusters = {r["_home"]: (r["far"], r["base"], r["share"], r["n"]) for r in small_rows(meta, MAX_PIVOTS, "clusters")}
        if cells is not None:
            sides = placed.select("_home", F.posexplode("_vec").alias("_pos", "_x")).groupBy("_home", "_pos").agg(F.min("_x").alias("low"), F.max("_x").alias("high"))
            boxes = sides.groupBy("_home").agg(F.array_sort(F.collect_list(F.struct("_pos", "low", "high"))).alias("sides"))
            for r in small_rows(boxes, MAX_PIVOTS, "boxes"):
                # A side with NaN, or without values, rules nothing out.
                cells.low[r["_home"]], cells.high[r["_home"]] = np.array([(s["low"], s["high"]) if s["high"] is not None and s["high"] == s["high"] else (-np.inf, np.inf) for s in r["sides"]]).T
        placed = reps.withColumn("_home", F.lit(0)) if len(pivots) == 1 else placed.select(*INDEX_COLS, "_home")
    return VectorIndex(anchors, placed, pivots, clusters, metric, geometry.weight, bool(anchor_col), bool(time_col), keep, list(payload), block, cells)


def nearest(
    queries: DataFrame,
    index: DataFrame | VectorIndex,
    *,
    id_col: str,
    vec_col: str,
    k: int,
    metric: str = "cosine",
    anchor_col: str | None = None,
    anchor_weight: float = 0.0,
    exclude_self: bool = False,
    exclude_col: str | None = None,
    before_col: str | None = None,
    payload: Sequence[str] = (),
    probes: int | None = None,
    block: tuple[int, int] = (8192, 4096),
) -> DataFrame:
    """The k nearest index rows of every query row.

    Returns (query_id, rank, neighbour_id, similarity, *payload); for the
    Euclidean metric the score column is ``distance`` (squared). Scores are
    rounded to nine digits and ties go to the smaller id, so results do not
    depend on blocking. Fewer than k rows come back when the index is smaller.

    ``index`` is a table, or a ``VectorIndex`` built (or loaded) before; the
    latter fixes metric, anchor weight and payload, of which ``payload`` may name the part that is wanted.

    exclude_self: a query never returns the index row with its own id.
    exclude_col: array of ids a query must not return.
    before_col: only rows whose date is strictly earlier than the query's.
    probes: search only that many nearest clusters (approximate, opt-in).
    """
    fetch = k + (1 if exclude_self else 0)
    if exclude_col:
        fetch += queries.agg(F.max(F.size(exclude_col))).first()[0] or 0
    if not isinstance(index, VectorIndex):
        index = build_index(
            index, id_col=id_col, vec_col=vec_col, keep=fetch, metric=metric, anchor_col=anchor_col, anchor_weight=anchor_weight,
            time_col=before_col, payload=payload, block=block,
        )
    if fetch > index.keep:
        raise ValueError(f"index keeps {index.keep} copies per vector, {fetch} needed")
    if bool(before_col) != index.timed or bool(anchor_col) != index.anchored:
        raise ValueError("query and index disagree on date or anchor")

    asked = _shaped(queries, vec_col, anchor_col, before_col, "_q1", "_q2")
    own = F.struct(F.col(id_col).alias("query_id"), *([F.col(exclude_col).alias("_exclude")] if exclude_col else []))
    asked = asked.select("_q1", "_q2", "_vec", "_anchor", "_time", own.alias("_own"))
    # A vector that is asked for once travels with its query's id; the ids of others are joined at the end.
    distinct = asked.groupBy("_q1", "_q2").agg(
        F.first("_vec").alias("_vec"), F.first("_anchor").alias("_anchor"), F.first("_time").alias("_time"), F.first("_own").alias("_own"), F.count("*").alias("_n")
    )
    distinct = stage(distinct.withColumn("_own", F.when(F.col("_n") == 1, F.col("_own"))).drop("_n"), "queries")
    carried = [c for c in index.payload if c in payload or not payload]
    member = lambda m: F.struct(m["id"].alias("id"), *[m[c].alias(c) for c in carried])
    if carried != index.payload:
        index = replace(index, placed=index.placed.withColumn("_members", F.transform("_members", member)))
    best = _search(distinct, index, fetch, probes)
    # At most ``fetch`` vectors of ``keep`` members each.
    every = F.flatten(F.transform("_hits", lambda h: F.transform(h["_members"], lambda m: F.struct(h["_cost"].alias("_cost"), m["id"].alias("_id"), m.alias("_member")))))
    lists = best.select("_q1", "_q2", "_own", F.slice(F.array_sort(every), 1, fetch).alias("_found"))
    own = lists.where(F.col("_own").isNotNull()).select("_own.*", "_found")
    if distinct.where(F.col("_own").isNull()).take(1):
        shared = lists.where(F.col("_own").isNull()).select("_q1", "_q2", "_found")
        own = own.unionByName(asked.select("_q1", "_q2", "_own").join(shared, ["_q1", "_q2"]).select("_own.*", "_found"))
    kept = F.col("_found")
    if exclude_self:
        kept = F.filter(kept, lambda s: s["_member"]["id"] != F.col("query_id"))
    if exclude_col:
        kept = F.filter(kept, lambda s: ~F.coalesce(F.array_contains("_exclude", s["_member"]["id"]), F.lit(False)))
    flat = own.select("query_id", F.posexplode(F.slice(kept, 1, k)).alias("_pos", "_hit"))
    if index.metric == "euclidean":
        score = F.col("_hit._cost").alias("distance")
    else:
        score = (F.lit(0.0) - F.col("_hit._cost")).alias("similarity")
    return flat.select(
        "query_id", (F.col("_pos") + 1).alias("rank"), F.col("_hit._member.id").alias("neighbour_id"), score,
        *[F.col(f"_hit._member.{c}").alias(c) for c in carried],
    )


def _search(queries: DataFrame, index: VectorIndex, fetch: int, probes: int | None) -> DataFrame:
    """Best ``fetch`` index vectors per query vector: home cluster, then whatever may still win."""
    geometry, pivots, i, cells = index.geometry, index.pivots, index.placed, index.cells
    search = _block_search(geometry, fetch, index.timed, False)
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], _types(queries, i))
    single = len(pivots) == 1 and not index.anchored
    if len(pivots) == 1:
        q = queries.withColumn("_home", F.lit(0)).withColumn("_np", F.lit(1))
    else:
        q = stage(_place(queries, ["_q1", "_q2", "_own", "_vec", "_anchor", "_time"], index.anchors, geometry, pivots, cells).drop("_far", "_base", "_share"), "placed")
    blocks = i.groupBy("_anchor", "_home").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    home = _block_join(q, i, ["_anchor", "_home"], index.block, search)
    # Clusters of one block have had each query once.
    home = home if blocks <= index.block[1] else _best(home, fetch)
    if single:
        return home
    home = stage(home, "home")

    n = len(pivots)
    full = np.array([c in index.clusters for c in range(n)])
    radius, base_radius, share, sizes = np.array([index.clusters.get(c, (0.0, 0.0, 0.0, 0)) for c in range(n)]).T
    most = min(VISIT_ROWS, VISIT_VALUES // max(1, pivots.shape[1]), -(-int(sizes.sum()) // VISIT_GROUPS))
    most = max(index.block[1], most)
    group = _grouped(pivots, sizes, most)
    tau = home.select("_q1", "_q2", _to_beat(fetch).alias("_tau"))
    waiting = q.select("_q1", "_q2", "_vec", "_anchor", "_time", "_home", "_np").join(tau, ["_q1", "_q2"], "left")

    def visits(batches: Iterator[pd.DataFrame], cross: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, known = _matrix(pdf["_vec"]), (pdf["_anchor"] != "").to_numpy().astype(float)
            limit = pdf["_tau"].fillna(np.inf)
            tau = limit.to_numpy()[:, None]
            boxed = cells is not None and probes is None
            distance = None if boxed else geometry.to_pivots(x, known, pivots)
            own = np.arange(n)[None, :] < (np.full(len(x), n) if cells is not None else pdf["_np"].to_numpy())[:, None]
            go = full[None, :] & (own | cross)
            go[np.arange(len(x)), pdf["_home"].to_numpy()] &= cross
            open_ = go.copy()
            if probes is not None:
                reach = np.argsort(np.where(full[None, :] & own, distance, np.inf), axis=1).argsort(axis=1)
                go &= reach < probes
            elif cross:
                angle = np.maximum(geometry.base_angles(x, pivots) - base_radius, 0.0)
                # Rows of different anchors meet only in their base parts.
                bound = -geometry.base_share(x, known)[:, None] * share * np.maximum(np.cos(angle), 0.0)
                go &= bound <= tau + SLACK
            elif boxed:
                go &= cells.best_cost(x) <= tau + SLACK
            else:
                go &= geometry.best_cost(distance, radius) <= tau + SLACK
            if probes is None and geometry.metric == "cosine":
                go |= open_ & ~x.any(axis=1)[:, None]
            r, c = np.nonzero(go)
            order = np.lexsort((c, group[c], r))
            r, c = r[order], c[order]
            cuts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (group[c[1:]] != group[c[:-1]])]) if len(r) else r
            lists = np.split(c.astype(np.int32), cuts[1:]) if len(r) else []
            yield pdf[["_q1", "_q2"]].assign(_tau=limit).iloc[r[cuts]].assign(_group=group[c[cuts]], _visits=pd.Series(lists, dtype=object).to_numpy())

    hits, more = home, False
    number = F.element_at(F.array(*[F.lit(int(g)) for g in group]), F.col("_home") + 1)
    i = i.withColumn("_group", number)
    for cross in ([False] if n > 1 else []) + ([True] if index.anchored and probes is None else []):
        # Only keys are written per visit; the vector joins them again.
        trip = stage(waiting.mapInPandas(lambda b, cross=cross: visits(b, cross), "_q1 long, _q2 long, _tau double, _group int, _visits array<int>"), "visits")
        if not trip.take(1):
            continue
        trip = trip.join(q.select("_q1", "_q2", "_own", "_vec", "_anchor", "_time"), ["_q1", "_q2"])
        search = _block_search(geometry, fetch, index.timed, cross)
        hits, more = hits.unionByName(_block_join(trip, i, ["_group"] if cross else ["_anchor", "_group"], (most, most), search)), True
    return _best(hits, fetch) if more else home


# --- features of the neighbourhood ---------------------------------------------

RETRIEVAL_FEATURES = [
    "retr_denial_rate",
    "retr_weighted_denial",
    "retr_mean_similarity",
    "retr_max_similarity",
    "retr_n_denied",
    "retr_billed_delta",
    "retr_sim_spread",
]


def neighbour_features(
    queries: DataFrame, neighbours: DataFrame, id_col: str = "claim_id", billed: str = "billed_amount", outcome: str = "denied"
) -> DataFrame:
    """Seven aggregates per query over its neighbours; all zero without neighbours.

    ``neighbours`` is the output of ``nearest`` with the outcome and, under the
    name ``billed``, the amount of the neighbour. Similarities count from zero up.
    """
    s = F.greatest(F.col("similarity"), F.lit(0.0))
    d = F.col(outcome).cast("double")
    agg = neighbours.groupBy("query_id").agg(
        F.avg(d).alias("retr_denial_rate"),
        (F.sum(s * d) / (F.sum(s) + 1e-8)).alias("retr_weighted_denial"),
        F.avg(s).alias("retr_mean_similarity"),
        F.max(s).alias("retr_max_similarity"),
        F.sum(d).alias("retr_n_denied"),
        F.avg(F.col(billed)).alias("_mean_billed"),
        (F.max(s) - F.avg(s)).alias("retr_sim_spread"),
    )
    own = queries.select(F.col(id_col), F.col(billed).alias("_own"))
    joined = own.join(agg, F.col(id_col) == F.col("query_id"), "left")
    delta = F.col("_own") / (F.col("_mean_billed") + 1e-8)
    return joined.withColumn("retr_billed_delta", delta).select(
        id_col, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in RETRIEVAL_FEATURES]
    )


def distance_features(queries: DataFrame, neighbours: DataFrame, id_col: str, category: str) -> DataFrame:
    """Mean and nearest distance, and whether the nearest row shares the category."""
    agg = neighbours.groupBy("query_id").agg(
        F.avg("distance").alias("rag_mean_distance"),
        F.min("distance").alias("rag_top1_distance"),
        F.min_by(category, "rank").alias("_nearest"),
    )
    own = queries.select(F.col(id_col), F.col(category).alias("_own"))
    return own.join(agg, F.col(id_col) == F.col("query_id"), "left").select(
        id_col, "rag_mean_distance", "rag_top1_distance", (F.col("_nearest") == F.col("_own")).cast("int").alias("rag_category_match")
    )

"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (three rounds of random signs and a fast
Hadamard transform) and hashed to the nearest of the 2 * d signed axes. Each of ``tables``
rotations gives one cell per vector; a query visits the ``probes`` cells of each table
whose axes are nearest to it. All vectors that share a visited cell are scored exactly.
Where a table of 2 * d cells would leave more than ``occupancy`` vectors a cell, a second
polytope over the first coordinates of another rotation refines it, by as many axes as needed.
Finer cells separate more neighbours, so every doubling of the axes adds half of ``probes`` to the visits.

Equal vectors are one class, so copies cost one entry. Cells are cut into blocks on both
sides, and a task holds one block of vectors and one of queries: a hot cell is many
tasks, and every pair of a query and a vector in a visited cell is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from remitlens.llm.common import attach, stage

TABLES, PROBES, OCCUPANCY = 16, 8, 2048
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Hadamard transform of the last axis, whose length is a power of two."""
    d, half = x.shape[-1], 1
    while half < d:
        pairs = x.reshape(*x.shape[:-1], d // (2 * half), 2, half)
        x = np.stack((pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]), -2).reshape(x.shape)
        half *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """The hash functions: ``tables`` rotations of ``dim`` coordinates, cells refined by ``fine`` more axes."""

    def __init__(self, dim: int, tables: int, fine: int, largest: float, seed: int):
        self.dim, self.tables, self.fine, self.largest = dim, tables, fine, largest
        # A power of two with room for the coordinate that lift() adds.
        self.width = 1 << (dim if largest else max(1, dim - 1)).bit_length()
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, 2, 3, self.width))

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors whose nearest neighbours are the largest inner products.

        Where norms differ, an indexed vector gets one more coordinate that fills it up to
        the largest norm; a query gets zero there.
        """
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        out = np.zeros((len(x), self.width), np.float32)
        if query or not self.largest:
            out[:, : self.dim] = x / norms
        else:
            out[:, : self.dim] = x / self.largest
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (norms[:, 0] / self.largest) ** 2))
        return out

    def axes(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """Signed coordinates after the rotation(s) of a table: one array, two with refined cells."""
        out = []
        for part in range(2 if self.fine else 1):
            x = unit
            for signs in self.signs[table, part]:
                x = hadamard(x * signs)
            x = x if part == 0 else x[:, : self.fine]
            out.append(np.concatenate((x, -x), axis=1))
        return out

    def cells(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` best cells of each vector, nearest first."""
        first, *second = self.axes(unit, table)
        m = min(probes, first.shape[1])
        best = np.argsort(-first, axis=1, kind="stable")[:, :m]
        if not second:
            return best
        fine = second[0]
        k = min(probes, fine.shape[1])
        best_fine = np.argsort(-fine, axis=1, kind="stable")[:, :k]
        sums = np.take_along_axis(first, best, 1)[:, :, None] + np.take_along_axis(fine, best_fine, 1)[:, None, :]
        codes = (best[:, :, None] * fine.shape[1] + best_fine[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(-sums.reshape(len(unit), -1), axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(codes, order, 1)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _hashed(hashes: CrossPolytope, probes: int):
    """Rows (class, vector) to rows (table, cell, class, vector) for every visited cell."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 2048):
                piece = part.slice(at, 2048)
                unit = hashes.lift(_matrix(piece.column(1), hashes.dim).astype(np.float64), probes > 1)
                for table in range(hashes.tables):
                    cells = hashes.cells(unit, table, probes)
                    row = np.repeat(np.arange(piece.num_rows), cells.shape[1])
                    names = pa.array(np.full(len(row), table, np.int32)), pa.array(cells.ravel().astype(np.int64))
                    yield pa.RecordBatch.from_arrays([*names, *(c.take(pa.array(row)) for c in piece.columns)], names=["tab", "cell", "class", "vector"])

    return run


def _scored(dim: int, keep: int):
    """A block of queries against a block of vectors: the ``keep`` best per query, ties by smaller class."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("class", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        names = vectors["class"].to_numpy()
        order = np.argsort(names, kind="stable")
        names, against = names[order], _matrix(vectors["vector"], dim)[order].astype(np.float64)
        scores = _matrix(queries["vector"], dim).astype(np.float64) @ against.T
        k = min(keep, len(names))
        # Sorting is stable and names ascend, so equal scores keep the smaller class first.
        if len(names) > 4 * k:
            floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            row, column = np.nonzero(scores >= floor)
        else:
            row, column = (x.ravel() for x in np.indices(scores.shape))
        value = scores[row, column]
        rank = np.lexsort((column, -value, row))
        row, column, value = row[rank], column[rank], value[rank]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column, value = row[place < k], column[place < k], value[place < k]
        return pa.Table.from_arrays([pa.array(queries["class"].to_numpy()[row]), pa.array(names[column]), pa.array(value)], schema=schema)

    return run


def visited(probes: int, fine: int) -> int:
    """Cells a query visits in each table when they are refined by ``fine`` axes."""
    return probes + -(-probes // 2) * fine.bit_length()


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, probes: int = PROBES, occupancy: int = OCCUPANCY, seed: int = 11,
) -> DataFrame:
    """The k rows of ``vectors`` of largest inner product found for every row of ``queries``.

    ``queries`` are rows of ``vectors`` (same columns); a row is never its own neighbour,
    its copies are. Returns query_id, rank (from 1), vec_id, score, ties to the smaller id.
    Null, empty and zero vectors and those with null or non-finite components take no part on
    either side, nor do rows without an id; a row repeated with its id counts once. All
    usable vectors must have one length. With fewer than k others all found are given;
    none of the tables finds what shares no visited cell with the query. Other columns are not
    read; empty tables give no rows.
    """
    clean = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    # Minus zero equals zero: adding zero makes equal vectors equal bytes.
    clean = clean.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(dict(vectors.dtypes)[vector_col][6:-1])))
    norm = F.sqrt(F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    clean = clean.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")})
    # Only the k + 1 smallest ids of a class of equal vectors can be among anyone's k nearest; the limit is taken before the shuffle too.
    first = Window.partitionBy("h1", "h2").orderBy("id")
    ranked = clean.dropDuplicates(["id"]).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    ranked = stage(ranked, "ann-members")
    leaders = stage(ranked.filter("place = 1").select(F.col("id").alias("class"), "h1", "h2", "vector", norm.alias("norm")), "ann-classes")
    facts = leaders.agg(F.count("*"), F.min("norm"), F.max("norm"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts[0]:
        return vectors.sparkSession.createDataFrame([], schema)
    count, shortest, longest, dim, widest = facts
    if dim != widest:
        raise ValueError(f"vectors of {dim} and of {widest} components in one table")
    cells, fine = 2 * (1 << max(1, dim - 1).bit_length()), 0
    while cells * max(1, 2 * fine) * occupancy < count and fine < dim:
        fine = max(1, 2 * fine)
    hashes = CrossPolytope(dim, tables, fine, longest if longest - shortest > 1e-6 * longest else 0.0, seed)
    members = ranked.select("id", "h1", "h2")
    asking = queries.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).dropDuplicates(["id"])
    asking = asking.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(dict(queries.dtypes)[vector_col][6:-1])))
    asking = asking.select("id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"), "vector")
    kinds = asking.groupBy("h1", "h2").agg(F.count("*").alias("n_queries"), F.first("vector").alias("vector"))
    kinds = stage(kinds.join(leaders.select("h1", "h2", "class"), ["h1", "h2"]), "ann-questions")
    entry = f"tab int, cell long, class long, vector {dict(vectors.dtypes)[vector_col]}"
    index = stage(leaders.select("class", "vector").mapInArrow(_hashed(hashes, 1), entry), "ann-index")
    visits = stage(kinds.select("class", "vector").mapInArrow(_hashed(hashes, max(2, visited(probes, fine))), entry), "ann-visits")
    held = index.groupBy("tab", "cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).alias("blocks"))
    asked = visits.groupBy("tab", "cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("parts"))
    plan = stage(held.join(asked, ["tab", "cell"]), "ann-plan")
    deal = lambda rows, own, other, mine, theirs: (
        rows.join(plan, ["tab", "cell"]).withColumn(mine, F.pmod(F.xxhash64("class"), own)).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        .select("tab", "cell", "b", "p", "class", "vector")
    )
    blocks = deal(index, F.col("blocks"), "parts", "b", "p").groupBy("tab", "cell", "b", "p")
    parts = deal(visits, F.col("parts"), "blocks", "p", "b").groupBy("tab", "cell", "b", "p")
    found = parts.cogroup(blocks).applyInArrow(_scored(dim, k + 1), "query long, class long, score double")
    found = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    found = stage(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place"), "ann-found")
    named = members.join(leaders.select("h1", "h2", "class"), ["h1", "h2"]).select("class", "id")
    rows = found.join(named, "class").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k + 1)
    lists = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("near"))
    lists = kinds.select("h1", "h2", "n_queries", F.col("class").alias("query")).join(lists, "query").drop("query")
    answers = attach(asking.select("id", "h1", "h2"), stage(lists, "ann-lists"), ["h1", "h2"], "n_queries")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    out = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))

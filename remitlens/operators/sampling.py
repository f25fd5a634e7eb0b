"""Splits, folds, samples and resamples, all reproducible from row keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.hashing import KEY_BITS, PRIME, hash_key, hash_uniform, residue_key
from remitlens.operators.ranking import rank_by_hash
from remitlens.session import small_rows

MAX_DAYS = 100_000
SMALL_SAMPLE = 10_000


@dataclass(frozen=True)
class TemporalCut:
    """Last training row in (date, digest, id) order; applying it is a plain filter."""

    date_col: str
    id_col: str
    seed: int
    day: date | None
    key: int
    row_id: str

    def is_train(self) -> Column:
        if self.day is None:
            return F.lit(False)
        d, k = F.to_date(self.date_col), hash_key(self.id_col, f"{self.seed}:cut")
        i = F.col(self.id_col).cast("string")
        at_cut = (k < self.key) | ((k == self.key) & (i <= F.lit(self.row_id)))
        return (d < F.lit(self.day)) | ((d == F.lit(self.day)) & at_cut)

    def apply(self, df: DataFrame, out: str = "split") -> DataFrame:
        return df.withColumn(out, F.when(self.is_train(), "train").otherwise("test"))


def fit_temporal_cut(
    df: DataFrame, date_col: str = "submission_date", id_col: str = "claim_id", test_frac: float = 0.25, seed: int = 42
) -> TemporalCut:
    """Find the row that ends the earliest ``1 - test_frac`` of the table; timestamps count by their day.

    Rows per day are a small table. Only the day the cut falls on needs an order
    among its rows: by digest, narrowed digit by digit, so a day holding most of
    the table costs a few counts and never a sort.
    """
    days = sorted(
        (r["day"], r["n"])
        for r in small_rows(df.groupBy(F.to_date(date_col).alias("day")).agg(F.count("*").alias("n")), MAX_DAYS, "distinct days")
    )
    left = int(sum(n for _, n in days) * (1 - test_frac))
    if left == 0:
        return TemporalCut(date_col, id_col, seed, None, 0, "")
    for day, n in days:
        if left <= n:
            break
        left -= n
    rows = df.where(F.to_date(date_col) == F.lit(day)).select(
        hash_key(id_col, f"{seed}:cut").alias("k"), F.col(id_col).cast("string").alias("i")
    )
    low, width, size = 0, 1 << KEY_BITS, n
    while size > SMALL_SAMPLE and width > 1:
        step = max(1, width >> 10)
        slot = F.floor((F.col("k") - F.lit(low)) / F.lit(step)).cast("int")
        inside = rows.where((F.col("k") >= low) & (F.col("k") < low + width))
        counts = sorted((r["s"], r["n"]) for r in small_rows(inside.groupBy(slot.alias("s")).agg(F.count("*").alias("n")), 2048, "digest slots"))
        for s, size in counts:
            if left <= size:
                low, width = low + s * step, step
                break
            left -= size
    tail = rows.where((F.col("k") >= low) & (F.col("k") < low + width)).orderBy("k", "i").limit(left)
    last = max(small_rows(tail, SMALL_SAMPLE, "rows at the cut"), key=lambda r: (r["k"], r["i"]))
    return TemporalCut(date_col, id_col, seed, day, last["k"], last["i"])


def stratified_folds(df: DataFrame, label: str, id_col: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: shuffled and balanced per class to within one row."""
    ranked = rank_by_hash(df, id_col, f"{seed}:fold", group=[label], out="_rank")
    return ranked.select(*df.columns, ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))


def subsample(df: DataFrame, n: int, id_col: str, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows without replacement (per stratum when ``by`` is given)."""
    ranked = rank_by_hash(df, id_col, f"{seed}:sample", group=by, out="_rank")
    return ranked.where(F.col("_rank") <= n).drop("_rank")


# Cumulative Poisson(1) probabilities.
POISSON_CDF = [
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.9999167588507119,
    0.9999897508033253,
    0.9999988747974149,
]


def replicate_multipliers(replicate: int, seed: int = 0) -> tuple[int, int]:
    """Two residues that make each replicate's hash its own."""
    a = (48271 * (replicate + 1) + 1640531527 * (seed + 1)) % PRIME
    c = (69621 * (replicate + 7) * (replicate + 3) + 40692 * (seed + 5)) % PRIME
    return a or 1, c


def _replicate_uniform(key: Column, a: Column, c: Column) -> Column:
    """Uniform number of a residue key: a fifth-power hash of ``a*key + c``."""
    p = F.lit(PRIME).cast("long")
    h = (a * key + c) % p
    h2 = (h * h) % p
    return (((h2 * h2) % p) * h) % p / F.lit(float(PRIME))


def _poisson(u: Column, edges: Sequence[float]) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + (u >= F.lit(edge)).cast("int")
    return out


def poisson_weight(key: Column, a: Column, c: Column) -> Column:
    """Poisson(1) weight from a residue key."""
    return _poisson(_replicate_uniform(key, a, c), POISSON_CDF)


def bootstrap_weights(df: DataFrame, id_col: str, replicates: int, seed: int = 0) -> DataFrame:
    """Long form (replicate, row, weight) with zero weights dropped; for few replicates.

    ``evaluate.bootstrap_auroc_lift`` draws the same weights inside its tasks.
    """
    pairs = [replicate_multipliers(b, seed) for b in range(replicates)]
    reps = F.array(
        *[
            F.struct(F.lit(b).alias("replicate"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c"))
            for b, (a, c) in enumerate(pairs)
        ]
    )
    return (
        df.withColumn("_k", residue_key(id_col, "boot"))
        .select(*df.columns, "_k", F.explode(reps).alias("_r"))
        # The filter needs one comparison: a predicate over the whole weight would draw its number for every edge.
        .withColumn("_u", _replicate_uniform(F.col("_k"), F.col("_r.a"), F.col("_r.c")))
        .where(F.col("_u") >= F.lit(POISSON_CDF[0]))
        .withColumn("weight", F.lit(1) + _poisson(F.col("_u"), POISSON_CDF[1:]))
        .select(*df.columns, F.col("_r.replicate").alias("replicate"), "weight")
    )


def smote(
    df: DataFrame,
    label: str,
    id_col: str,
    vec_col: str,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Bring the smaller class up to parity with interpolated rows.

    Each synthetic row is base + u * (neighbour - base) for one of the base's
    ``k`` nearest rows of its class. Output: original rows plus synthetic ones
    (``id#i`` ids), with ``is_synthetic``.
    """
    from remitlens.operators.retrieval import nearest

    counts = sorted(
        (r["n"], r[label]) for r in small_rows(df.groupBy(label).agg(F.count("*").alias("n")), 2, "label classes")
    )
    ids = F.col(id_col).cast("string")
    real = df.select(ids.alias(id_col), F.col(label), F.col(vec_col).cast("array<double>").alias(vec_col), F.lit(False).alias("is_synthetic"))
    if len(counts) < 2 or counts[0][0] == counts[1][0] or counts[0][0] < 2:
        return real
    (small_n, small_label), (big_n, _) = counts
    need = big_n - small_n
    minority = real.where(F.col(label) == F.lit(small_label)).drop("is_synthetic")
    pairs = nearest(
        minority, minority, id_col=id_col, vec_col=vec_col, k=min(k, small_n - 1), metric="euclidean",
        exclude_self=True, payload=[vec_col],
    ).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(vec_col).alias("v")))), lambda s: s["v"]).alias("_near")
    )
    ranked = rank_by_hash(minority, id_col, f"{seed}:smote", out="_rank")
    copies = F.lit(need // small_n) + (F.col("_rank") <= F.lit(need % small_n)).cast("int")
    made = (
        ranked.withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .join(pairs, F.col(id_col) == F.col("query_id"))
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("_new", F.concat_ws("#", F.col(id_col), F.col("_i")))
        .withColumn("_u", hash_uniform("_new", f"{seed}:gap"))
        .withColumn(
            "_pick", F.least(F.floor(hash_uniform("_new", f"{seed}:pick") * F.size("_near")), F.size("_near") - 1).cast("int")
        )
        .withColumn("_to", F.element_at("_near", F.col("_pick") + 1))
    )
    synthetic = made.select(
        F.col("_new").alias(id_col),
        F.col(label),
        F.zip_with(
            vec_col,
            F.zip_with(F.zip_with(vec_col, "_to", lambda x, y: y - x), F.array_repeat("_u", F.size(vec_col)), lambda gap, u: gap * u),
            lambda x, step: x + step,
        ).alias(vec_col),
        F.lit(True).alias("is_synthetic"),
    )
    return real.unionByName(synthetic)

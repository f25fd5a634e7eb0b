"""Fit-on-train feature encoding and category profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.constants import PROVIDER_WEIGHT
from remitlens.functions.scalar import filing_days
from remitlens.session import small_rows

NUMERIC = ["log_billed", "amount_ratio", "filing_days"]
MAX_VOCABULARY = 10_000


def numeric_columns() -> dict[str, Column]:
    return {
        "log_billed": F.log1p(F.col("billed_amount")),
        "amount_ratio": F.col("billed_amount") / F.col("_procedure_base_cost"),
        "filing_days": filing_days(),
    }


@dataclass(frozen=True)
class StructuredEncoder:
    """Standardised numerics and one-hot payer, procedure and diagnosis category."""

    mean: list[float]
    std: list[float]
    payers: list[str]
    cpts: list[str]
    categories: list[str]

    @property
    def feature_names(self) -> list[str]:
        return [
            *NUMERIC,
            *[f"payer={v}" for v in self.payers],
            *[f"cpt={v}" for v in self.cpts],
            *[f"dx={v}" for v in self.categories],
        ]

    def columns(self) -> list[Column]:
        """One double column per feature; an unseen value is all zeros."""
        numbers = [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(numeric_columns().values(), self.mean, self.std)]
        hot = [
            F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
            for c, vs in (("insurance_type", self.payers), ("cpt_code", self.cpts), ("dx_category", self.categories))
            for v in vs
        ]
        return numbers + hot

    def array(self) -> Column:
        return F.array(*self.columns())

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Add the feature vector. A row without a fee has no ratio: filter it first (``known_fee``)."""
        return df.withColumn(out, array_to_vector(self.array()))

    def embed(self, df: DataFrame, providers: DataFrame, vec: str = "embedding", anchor: str = "anchor") -> DataFrame:
        """Retrieval embedding in split form: base vector plus the provider as anchor.

        ``providers`` is the training vocabulary as a table (it may be large); a
        provider outside it has no anchor.
        """
        known = providers.select(F.col("provider_id").alias("_p")).distinct()
        return (
            df.join(known, F.col("provider_id") == F.col("_p"), "left")
            .withColumn(vec, self.array())
            .withColumn(anchor, F.col("_p"))
            .drop("_p")
        )

    def as_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(self)], "mean array<double>, std array<double>, payers array<string>, cpts array<string>, categories array<string>")

    @classmethod
    def from_table(cls, table: DataFrame) -> "StructuredEncoder":
        return cls(**table.first().asDict())


ANCHOR_WEIGHT = PROVIDER_WEIGHT


def known_fee(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose procedure has a fee, and the rejected rest."""
    ok = F.col("_procedure_base_cost").isNotNull()
    return df.where(ok), df.where(~ok)


def fit_encoder(train: DataFrame) -> StructuredEncoder:
    """Means, population deviations and sorted vocabularies of the training rows."""
    numbers = numeric_columns()
    stats = train.agg(
        *[F.avg(c).alias(f"m_{n}") for n, c in numbers.items()], *[F.stddev_pop(c).alias(f"s_{n}") for n, c in numbers.items()]
    ).first()
    # Three vocabularies, not their combinations: the encoder's width is their sum.
    vocab = [
        sorted(r[c] for r in small_rows(train.select(c).where(F.col(c).isNotNull()).distinct(), MAX_VOCABULARY, f"values of {c}"))
        for c in ("insurance_type", "cpt_code", "dx_category")
    ]
    return StructuredEncoder([stats[f"m_{n}"] for n in NUMERIC], [stats[f"s_{n}"] + 1e-8 for n in NUMERIC], *vocab)


def assemble(base: DataFrame, id_col: str, parts: Mapping[str, DataFrame], vectors: Sequence[str], out: str = "features") -> DataFrame:
    """Join vector columns held by other tables onto ``base`` by id and concatenate them."""
    from pyspark.ml.feature import VectorAssembler

    joined = base
    for part in parts.values():
        joined = joined.join(part, id_col)
    return VectorAssembler(inputCols=list(vectors), outputCol=out).transform(joined)


def vector_means(df: DataFrame, category: str, vec_col: str, out: str = "mean_vector") -> DataFrame:
    """Elementwise mean vector per category."""
    cells = df.select(category, F.posexplode(vec_col).alias("pos", "x")).groupBy(category, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(category).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(out))


def category_profile(claims: DataFrame, notes: DataFrame, category: str, columns: Sequence[str]) -> DataFrame:
    """Category means of note signals on every claim; zeros for a category without notes."""
    means = notes.groupBy(category).agg(*[F.avg(c).alias(f"cat_{c}") for c in columns])
    return claims.join(means, category, "left").withColumns({f"cat_{c}": F.coalesce(F.col(f"cat_{c}"), F.lit(0.0)) for c in columns})


def rank_importance(long: DataFrame, feature: str = "feature", value: str = "value", top: int = 12) -> DataFrame:
    """Features by mean absolute value; the ``top`` first."""
    return (
        long.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("mean_abs")).orderBy(F.desc("mean_abs"), feature).limit(top)
    )

"""Claim schema, record validation and the record projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.constants import INSURANCE_TYPES

CLAIM_SCHEMA = T.StructType(
    [
        T.StructField("claim_id", T.StringType(), False),
        T.StructField("provider_id", T.StringType(), False),
        T.StructField("patient_id", T.StringType(), True),
        T.StructField("icd10_code", T.StringType(), False),
        T.StructField("cpt_code", T.StringType(), False),
        T.StructField("insurance_type", T.StringType(), False),
        T.StructField("billed_amount", T.DoubleType(), False),
        T.StructField("service_date", T.DateType(), False),
        T.StructField("submission_date", T.DateType(), False),
        T.StructField("reason_code", T.StringType(), True),
        T.StructField("clinical_note", T.StringType(), True),
        T.StructField("denied", T.IntegerType(), True),
    ]
)
REQUIRED = [f.name for f in CLAIM_SCHEMA.fields if not f.nullable]
RECORD_FIELDS = [f.name for f in CLAIM_SCHEMA.fields if f.name != "clinical_note"]


def violations() -> Column:
    """Names of the broken rules of a claim row, in a fixed order; empty when valid."""
    rules: list[tuple[str, Column]] = [(f"missing_{c}", F.col(c).isNull()) for c in REQUIRED]
    rules += [
        ("unknown_insurance_type", ~F.col("insurance_type").isin(INSURANCE_TYPES)),
        ("negative_billed_amount", F.col("billed_amount") < 0),
        ("submission_before_service", F.col("submission_date") < F.col("service_date")),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def validate_claims(claims: DataFrame) -> DataFrame:
    """Add the ``violations`` list to every row."""
    return claims.withColumn("violations", violations())


def split_valid(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their violations."""
    checked = validate_claims(claims)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def to_record(claims: DataFrame) -> DataFrame:
    """Observable record fields in schema order; absent optional fields become null."""
    out = []
    for name in RECORD_FIELDS:
        if name == "denied":
            col = F.col("denied").cast("boolean") if "denied" in claims.columns else F.lit(None).cast("boolean")
        elif name in claims.columns:
            col = F.col(name).cast(CLAIM_SCHEMA[name].dataType)
        else:
            col = F.lit(None).cast(CLAIM_SCHEMA[name].dataType)
        out.append(col.alias(name))
    return claims.select(*out)

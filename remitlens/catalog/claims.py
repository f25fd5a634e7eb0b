"""The claims view over the test star schema, in Spark and as SQL text.

Payer, procedure, dates and latent drivers are derived from order lines, so every
number the operators compute on claims can be recomputed by another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.constants import FILING_WINDOW_DAYS, PREVALENCE_TARGET
from remitlens.functions.scalar import lookup
from remitlens.operators import rules
from remitlens.operators.sampling import TemporalCut, fit_temporal_cut
from remitlens.session import small_rows, spread, stage

SEGMENT_PAYER = {
    "AUTOMOBILE": "medicare",
    "BUILDING": "medicaid",
    "FURNITURE": "private",
    "HOUSEHOLD": "self_pay",
    "MACHINERY": "other",
}
AUTH_TYPES = ["PROMO", "LARGE"]
SEED = 42
MAX_PROCEDURES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores for text work."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def fee_schedule(lines: DataFrame) -> DataFrame:
    """Usual charge per procedure: a mergeable mean, no per-group collection."""
    return lines.groupBy("cpt_code").agg(F.round(F.avg("billed_amount"), 2).alias("_procedure_base_cost"))


def claims_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per order line; joins are left to Catalyst's size-based choice.

    Orders come first, while lines are narrow: their join is the one that shuffles lines soonest as tables grow.
    """
    line = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"
        )
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.to_date("l_shipdate").alias("l_shipdate"),
        (F.col("l_linestatus") == "F").alias("_prior_auth_obtained"), (F.col("l_returnflag") != "R").alias("_necessity_documented"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    order = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    joined = (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    days = F.abs(F.datediff("l_shipdate", "o_orderdate")) % 240
    payer = lookup("c_mktsegment", SEGMENT_PAYER)
    base = joined.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")
        ).alias("claim_id"),
        F.col("l_suppkey").cast("string").alias("provider_id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.col("p_brand").alias("icd10_code"),
        F.col("p_type").alias("cpt_code"),
        F.concat(F.lit("dx"), (brand % 5).cast("string")).alias("dx_category"),
        payer.alias("insurance_type"),
        F.col("l_extendedprice").alias("billed_amount"),
        F.col("l_shipdate").alias("service_date"),
        F.date_add("l_shipdate", days).alias("submission_date"),
        F.col("l_partkey").alias("_part_key"),
        days.cast("double").alias("_filing_days"),
        lookup(payer, FILING_WINDOW_DAYS).cast("double").alias("_filing_window"),
        F.col("p_type").isin(AUTH_TYPES).alias("_prior_auth_required"),
        "_prior_auth_obtained",
        (F.col("s_nationkey") % 5 != 0).alias("_in_network"),
        (brand % 5 != F.col("p_size") % 5).alias("_necessity_ok"),
        "_necessity_documented",
        (F.lit(0.9) * (F.col("s_acctbal") - 4500) / 3150).alias("_provider_propensity"),
    )
    # The schedule is computed from its own two-column scan; its size is checked before it is broadcast.
    fees = fee_schedule(
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("p_type").alias("cpt_code"), F.col("l_extendedprice").alias("billed_amount"))
    )
    known = spark.createDataFrame(small_rows(fees, MAX_PROCEDURES, "procedures with a fee"), fees.schema)
    return base.join(F.broadcast(known), "cpt_code").withColumn("_amount_ratio", F.col("billed_amount") / F.col("_procedure_base_cost"))


_stores: dict[tuple, tuple] = {}


def claim_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float, TemporalCut]:
    """Scored claims (staged once per session), their intercept and their time cut."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        scored = stage(rules.base_risk(rules.driver_contributions(claims_view(spark, sf_dir))), "claims")
        intercept = rules.calibrate_intercepts(scored, [PREVALENCE_TARGET])[PREVALENCE_TARGET]
        _stores[key] = (scored, intercept, fit_temporal_cut(scored, seed=SEED))
    return _stores[key]


def scored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_store(spark, sf_dir)[0]


def labeled_claims(spark: SparkSession, sf_dir: str, noise: float = 0.0) -> DataFrame:
    scored, intercept, cut = claim_store(spark, sf_dir)
    return cut.apply(rules.label_claims(scored, intercept, noise, seed=SEED))


# --- the same view as SQL text ------------------------------------------------


def _case(col: str, mapping: dict, quote_values: bool) -> str:
    arms = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if quote_values else f"{v}") for k, v in mapping.items())
    return f"CASE {col} {arms} END"


def sql_key(expr: str, tag: str, digits: int = 13) -> str:
    return f"('0x' || substr(md5(concat({expr}, '|{tag}')), 1, {digits}))::BIGINT"


def sql_uniform(expr: str, tag: str) -> str:
    return f"({sql_key(expr, tag, 8)} / 4294967296.0::DOUBLE)"


from remitlens.constants import ANOMALY_RATIO, DRIVER_WEIGHTS, DRIVERS, PAYER_RESIDUAL, REASON_TEXT  # noqa: E402

CLAIMS_SQL = f"""
raw AS (
  SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS claim_id,
         CAST(l_suppkey AS VARCHAR) AS provider_id, CAST(o_custkey AS VARCHAR) AS patient_id,
         p_brand AS icd10_code, p_type AS cpt_code,
         concat('dx', CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 5) AS dx_category,
         {_case('c_mktsegment', SEGMENT_PAYER, True)} AS insurance_type,
         l_extendedprice AS billed_amount,
         CAST(l_shipdate AS DATE) AS service_date,
         abs(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) % 240 AS fd,
         p_type IN ('PROMO', 'LARGE') AS pa_req, l_linestatus = 'F' AS pa_got,
         s_nationkey % 5 <> 0 AS in_net,
         CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 5 <> p_size % 5 AS nec_ok,
         l_returnflag <> 'R' AS nec_doc,
         0.9::DOUBLE * (s_acctbal - 4500) / 3150 AS propensity, l_partkey AS part_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
fees AS (SELECT cpt_code, round(avg(billed_amount), 2) AS base_cost FROM raw GROUP BY cpt_code),
claims AS (
  SELECT raw.*, service_date + CAST(fd AS INT) AS submission_date, CAST(fd AS DOUBLE) AS filing_days, base_cost,
         CAST({_case('insurance_type', FILING_WINDOW_DAYS, False)} AS DOUBLE) AS filing_window,
         billed_amount / base_cost AS amount_ratio
  FROM raw JOIN fees USING (cpt_code)),
drivers AS (
  SELECT claims.*,
    {DRIVER_WEIGHTS['untimely_filing']}::DOUBLE * CAST(filing_days > filing_window AS DOUBLE) AS c_untimely_filing,
    {DRIVER_WEIGHTS['missing_prior_auth']}::DOUBLE * CAST(pa_req AND NOT pa_got AS DOUBLE) AS c_missing_prior_auth,
    {DRIVER_WEIGHTS['medical_necessity']}::DOUBLE * CAST(NOT nec_ok AS DOUBLE) AS c_medical_necessity,
    {DRIVER_WEIGHTS['undocumented_necessity']}::DOUBLE * CAST(NOT nec_doc AS DOUBLE) AS c_undocumented_necessity,
    {DRIVER_WEIGHTS['out_of_network']}::DOUBLE * CAST(NOT in_net AS DOUBLE) AS c_out_of_network,
    {DRIVER_WEIGHTS['billing_anomaly']}::DOUBLE * greatest(amount_ratio - {ANOMALY_RATIO}::DOUBLE, 0.0::DOUBLE) AS c_billing_anomaly
  FROM claims),
scored AS (
  SELECT drivers.*, {' + '.join(f'c_{d}' for d in DRIVERS)} + CAST({_case('insurance_type', PAYER_RESIDUAL, False)} AS DOUBLE) + propensity AS base_logodds
  FROM drivers)"""


def bisect_sql(targets: str) -> str:
    """Bisection as a recursive query; ``targets`` is a relation with a column ``t``."""
    return f"""
bis AS (
  SELECT t, 0 AS step, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0.0::DOUBLE AS mid,
         (SELECT avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-(base_logodds + 0.0::DOUBLE)))) FROM scored) AS prev FROM {targets}
  UNION ALL
  SELECT t, step + 1, nlo, nhi, (nlo + nhi) / 2,
         (SELECT avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-(s.base_logodds + (nlo + nhi) / 2)))) FROM scored s)
  FROM (SELECT t, step, CASE WHEN prev < t THEN mid ELSE lo END AS nlo, CASE WHEN prev < t THEN hi ELSE mid END AS nhi
        FROM bis WHERE abs(prev - t) >= 0.0001 AND step < 200)),
intercepts AS (SELECT t, arg_max(mid, step) AS b FROM bis GROUP BY t)"""


_REASON_ARMS = " ".join(f"WHEN c_{d} = top THEN '{REASON_TEXT[d]}'" for d in DRIVERS)

LABELED_SQL = f"""{CLAIMS_SQL},
targets AS (SELECT {PREVALENCE_TARGET}::DOUBLE AS t), {bisect_sql('targets')},
probs AS (
  SELECT scored.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(base_logodds + b))) AS true_denial_prob,
         greatest({', '.join(f'c_{d}' for d in DRIVERS)}) AS top
  FROM scored, intercepts),
clean AS (SELECT probs.*, CASE WHEN {sql_uniform('claim_id', f'{SEED}:label')} < true_denial_prob THEN 1 ELSE 0 END AS denied FROM probs),
labeled AS (
  SELECT clean.*, CASE WHEN denied = 1 THEN CASE WHEN top <= 0 THEN '{REASON_TEXT['baseline']}' {_REASON_ARMS} END END AS reason_code,
         CASE WHEN row_number() OVER (ORDER BY submission_date, {sql_key('claim_id', f'{SEED}:cut')}, claim_id)
              <= floor((SELECT count(*) FROM clean) * 0.75) THEN 'train' ELSE 'test' END AS split
  FROM clean)"""


def with_claims(select: str) -> str:
    return f"WITH {CLAIMS_SQL} {select}"


def with_scored(select: str, extra: str = "") -> str:
    return f"WITH {CLAIMS_SQL}{extra} {select}"


def with_labeled(select: str, extra: str = "") -> str:
    return f"WITH RECURSIVE {LABELED_SQL}{extra} {select}"

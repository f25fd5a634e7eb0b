"""Column functions: projections, predicates and text signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.constants import MEDICAL_NECESSITY_PHRASES, PRIOR_AUTH_PHRASES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def clip(c, low: float | None = None, high: float | None = None) -> Column:
    out = _col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(_col(c).isNotNull(), out)


def lookup(c, mapping: Mapping, default=None) -> Column:
    """Value of a small fixed mapping; unknown keys give ``default``."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, _col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def filing_days(submission="submission_date", service="service_date") -> Column:
    return F.datediff(_col(submission), _col(service)).cast("double")


def amount_ratio(billed, base_cost) -> Column:
    return _col(billed) / _col(base_cost)


def predict_at(p, threshold: float = 0.5) -> Column:
    return (_col(p) >= F.lit(threshold)).cast("int")


def risk_band(p) -> Column:
    return F.when(_col(p) >= 0.5, "HIGH").when(_col(p) >= 0.25, "ELEVATED").otherwise("LOW")


def drift_flag(psi) -> Column:
    return F.when(_col(psi) > 0.25, "major").when(_col(psi) > 0.10, "moderate").otherwise("negligible")


def code_category(code) -> Column:
    """Clinical bucket of a diagnosis code: by leading letter, else by its digits.

    A number and its digit sum agree modulo 3, so codes of any length are safe.
    """
    c = F.upper(F.trim(_col(code)))
    digits = F.regexp_replace(c, "[^0-9]", "")
    total = F.aggregate(
        F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(0), lambda acc, d: acc + d.cast("int")
    )
    return (
        F.when(c.startswith("I"), "Cardiovascular")
        .when(c.startswith("E"), "Endocrine")
        .when(c.startswith("J"), "Respiratory")
        .when(digits == "", "General")
        .when(total % 3 == 0, "Cardiovascular")
        .when(total % 3 == 1, "Endocrine")
        .otherwise("General")
    )


def contains_any(text, phrases: Sequence[str]) -> Column:
    """Whether the lowered text holds any of the phrases: one scan for the whole list."""
    return F.lower(_col(text)).rlike("|".join(rf"\Q{p}\E" for p in phrases))


def word_count(text) -> Column:
    """Whitespace-separated words; blank text has none."""
    t = F.regexp_replace(F.regexp_replace(_col(text), r"^\s+", ""), r"\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def note_signals(text) -> list[Column]:
    return [
        contains_any(text, MEDICAL_NECESSITY_PHRASES).cast("int").alias("has_medical_necessity"),
        contains_any(text, PRIOR_AUTH_PHRASES).cast("int").alias("has_prior_auth_mention"),
        word_count(text).alias("note_length"),
        contains_any(text, ["diagnosis", "diagnoses"]).cast("int").alias("has_diagnosis_mention"),
        contains_any(text, ["procedure", "operation"]).cast("int").alias("has_procedure_mention"),
    ]


def code_pair_text(procedure, diagnosis) -> Column:
    return F.concat_ws(" ", _col(procedure), _col(diagnosis))


def calendar_parts(date) -> list[Column]:
    """Month (1-12) and day of week (0 = Monday)."""
    return [F.month(_col(date)).alias("service_month"), F.weekday(_col(date)).alias("service_dayofweek")]


def response_probability(body) -> Column:
    """Probability in a model's JSON answer, clamped to [0, 1]; 0.5 when unreadable."""
    p = F.get_json_object(_col(body), "$.denial_probability").try_cast("double")
    return F.coalesce(clip(F.when(~F.isnan(p), p), 0.0, 1.0), F.lit(0.5))


def request_index(custom_id) -> Column:
    return F.regexp_extract(_col(custom_id), r"^note-(\d+)$", 1).cast("long")


#: Outcome-side columns of labelled claims that carry no leading underscore.
_HIDDEN = {"base_logodds", "true_denial_prob", "split"}


def observable_columns(df: DataFrame) -> list[str]:
    """Columns a model may see.

    Latent drivers carry a leading underscore; the rule's own driver terms (``c_``),
    score, probability and split are kept out too.
    """
    return [c for c in df.columns if not c.startswith(("_", "c_")) and c not in _HIDDEN]


_HALF = [k for k in range(5, 1000, 10) if float(f"{k / 1000:.2f}") > k / 1000]


def two_digits(x) -> Column:
    """A number between -1 and 1 with two decimals, rounded from its binary value.

    Only a number that reads k / 1000 with k ending in 5 can round differently in
    decimal; for those the side of the tie on which the double lies is known per k.
    """
    c = _col(x)
    k = F.round(F.abs(c) * 1000).cast("int")
    tie = (k % 10 == 5) & (F.abs(c) == k / F.lit(1000.0))
    cents = F.when(k.isin(_HALF), (k + 5) / F.lit(1000.0)).otherwise((k - 5) / F.lit(1000.0))
    return F.when(tie, F.format_string("%.2f", F.when(c < 0, -cents).otherwise(cents))).otherwise(F.format_string("%.2f", c))

"""Column helpers and skew-safe joins shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.session import stage, staging_root

__all__ = ["stage", "staging_root", "text_of", "word_count", "attach", "buckets_for", "terms_of", "term_array", "WHITE"]

#: The ASCII white space of the word and line rules: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def word_count(column: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null stays null."""
    return F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_TERM_BYTES).split()


def term_array(column: Column) -> Column:
    """The same terms as an array column; null stays null."""
    return F.regexp_extract_all(lower_ascii(column), F.lit(TERM), 0)


def buckets_for(df: DataFrame, rows_per_bucket: int) -> int:
    """A number of hash buckets that follows the table's row count."""
    return max(1, -(-df.count() // rows_per_bucket))


#: Groups of more than 1/HOT_SHARE of all members count as hot: at most HOT_SHARE of them can exist.
HOT_SHARE = 1000


def attach(members: DataFrame, groups: DataFrame, key: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join ``members`` to the one row of ``groups`` for their ``key`` (never null).

    ``size`` is the column of ``groups`` with the number of members of the key.
    Groups above 1/1000 of all members number at most 1000 by construction; those
    rows are broadcast, so a key held by a third of all rows never meets one task.
    The rest is an ordinary shuffled join of small groups.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * HOT_SHARE > total)
    cold = groups.filter(F.col(size) * HOT_SHARE <= total)
    columns = [c for c in groups.columns if c not in key]
    if not hot.take(1):
        return members.join(cold, key, how)
    flagged = members.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    done = flagged.filter(F.col("_hot")).drop("_hot")
    rest = flagged.filter(F.col("_hot").isNull()).drop("_hot", *columns)
    return done.select(*members.columns, *columns).unionByName(rest.join(cold, key, how).select(*members.columns, *columns))

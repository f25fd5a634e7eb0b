"""Token and term columns; all in-row, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.constants import STOP_WORDS

# A token is a run of at least two word characters (letters, digits, underscore).
TOKEN = r"[\p{L}\p{N}_]{2,}"
# A chunk of a note is a sentence: text up to and with its closing marks.
SENTENCE = r"[^.!?]+[.!?]*"


def stop_list(words: Sequence[str] | str) -> list[str]:
    """A stop list given as words, or by the name of one of Spark's own lists ("english", ...)."""
    if isinstance(words, str):
        from pyspark.ml.feature import StopWordsRemover

        return list(StopWordsRemover.loadDefaultStopWords(words))
    return list(words)


def tokens(text, stop_words: Sequence[str] | str = STOP_WORDS) -> Column:
    """Tokens of a text without stop words (a list, or the name of one)."""
    stop_words = stop_list(stop_words)
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def bigrams(words: Column) -> Column:
    """Neighbouring pairs of an already filtered token list."""
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<string>"))


def with_terms(
    df: DataFrame, text: str, ngrams: tuple[int, int] = (1, 1), stop_words: Sequence[str] | str = STOP_WORDS, out: str = "terms"
) -> DataFrame:
    """Add the uni- and/or bigrams of a text; bigrams are formed after stop words are gone.

    The token list is a column of its own, so a text is tokenised once.
    """
    if ngrams not in ((1, 1), (1, 2), (2, 2)):
        raise ValueError(f"unsupported n-gram range {ngrams}")
    if ngrams == (1, 1):
        return df.withColumn(out, tokens(text, stop_words))
    words = F.col("_words")
    found = bigrams(words) if ngrams == (2, 2) else F.concat(words, bigrams(words))
    return df.withColumn("_words", tokens(text, stop_words)).withColumn(out, found).drop("_words")


def flagged(found: Column) -> Column:
    """Sorted terms as (term, new): ``new`` is 1 on a term's first occurrence in the row."""
    ordered = F.sort_array(found)
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), ordered), 1, F.size(ordered))
    return F.zip_with(
        ordered, before, lambda t, p: F.struct(t.alias("term"), F.when(p.eqNullSafe(t), 0).otherwise(1).alias("new"))
    )


def sentences(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def text_key(text) -> Column:
    """Digest that stands for a text in joins."""
    return F.md5(F.col(text) if isinstance(text, str) else text)

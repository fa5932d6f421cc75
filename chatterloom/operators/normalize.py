"""Tokenised corpora: `tokens array<string>` next to the other columns of a row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.functions import text as T
from chatterloom.functions.wordlists import STOP_WORDS
from chatterloom.operators.evaluate import compute_once
from chatterloom.operators.lemmas import replace_tokens


def tokenize(df: DataFrame, column: str = "conversation") -> DataFrame:
    """Add `tokens`: every lower-cased word after placeholders are removed."""
    return compute_once(df, {"tokens": T.raw_tokens(F.col(column))})


def normalize_tokens(
    df: DataFrame, column: str = "conversation", stop_words: Iterable[str] = STOP_WORDS,
    lemmas: DataFrame | None = None, min_chars: int = 2, keep_empty: bool = False,
    key: Iterable[str] = ("conv_id",),
) -> DataFrame:
    """Add `tokens`, fit for topic models.

    In this order: lower case, no placeholders, words, no numbers, base forms (when a `lemmas`
    table is given), no short words, no stop words. Rows left without tokens, and null texts, are
    dropped unless `keep_empty`, which keeps them with an empty array.
    """
    tokens = T.tokens_without_numbers(F.col(column))
    if lemmas is not None:
        light = compute_once(df, {"tokens": tokens})
        return content_tokens(light, stop_words, lemmas, min_chars, keep_empty, key)
    return _with_content(df, tokens, stop_words, min_chars, keep_empty)


def content_tokens(
    light: DataFrame, stop_words: Iterable[str] = STOP_WORDS, lemmas: DataFrame | None = None,
    min_chars: int = 2, keep_empty: bool = False, key: Iterable[str] = ("conv_id",),
) -> DataFrame:
    """`normalize_tokens` for rows whose `tokens` are words without numbers already."""
    if lemmas is not None:
        light = replace_tokens(light, lemmas, key=key)
    return _with_content(light, F.col("tokens"), stop_words, min_chars, keep_empty)


def _with_content(
    df: DataFrame, tokens: Column, stop_words: Iterable[str], min_chars: int, keep_empty: bool
) -> DataFrame:
    tokens = T.keep_content(tokens, stop_words, min_chars)
    if keep_empty:
        tokens = F.coalesce(tokens, F.array().cast("array<string>"))
        return compute_once(df, {"tokens": tokens})
    return compute_once(df, {"tokens": tokens}, keep=lambda row: F.size(row["tokens"]) > 0)


def normalize_light(
    df: DataFrame, column: str = "conversation", lemmas: DataFrame | None = None,
    key: Iterable[str] = ("conv_id",),
) -> DataFrame:
    """The variant for embedding models: numbers go, short words and stop words stay."""
    return normalize_tokens(df, column, stop_words=(), lemmas=lemmas, min_chars=1, key=key)


def token_text(df: DataFrame) -> DataFrame:
    """Add `normalized`: the tokens as one spaced text."""
    return df.withColumn("normalized", F.array_join("tokens", " "))


def token_positions(df: DataFrame, key: Iterable[str] = ("conv_id",)) -> DataFrame:
    """Long form: one row `(key, pos, token)` per token."""
    return df.select(*key, F.posexplode("tokens").alias("pos", "token"))


def without_stop_words(positions: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Anti join of long-form tokens with the stop list."""
    words = sorted(set(stop_words))
    if len(words) > 10_000:
        raise ValueError("the stop list is sent to every executor; keep it below 10,000 words")
    stop = positions.sparkSession.createDataFrame([(word,) for word in words], "token string")
    return positions.join(F.broadcast(stop), "token", "left_anti")

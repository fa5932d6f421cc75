"""Text expressions. All take and return Columns and stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and underscore of any script; Java's own \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
#: A word that is not a number. A number is refused at each of its characters; a word that merely
#: starts with digits is not, because a letter or underscore follows them.
WORD_NOT_NUMBER = r"(?!\p{N}++(?![\p{L}_]))[\p{L}\p{N}_]++"
#: {{placeholder}} on one line. (?d) makes \n the only line end.
PLACEHOLDER = r"(?d)\{\{.*?\}\}"


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")


def words(text: Column) -> Column:
    """All word tokens of `text`, in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def raw_tokens(text: Column) -> Column:
    """Lower-cased words with placeholders removed: the first half of normalisation."""
    return words(strip_placeholders(F.lower(text)))


def tokens_without_numbers(text: Column) -> Column:
    """Raw tokens except those made of number characters only, found in one scan."""
    prepared = strip_placeholders(F.lower(text))
    return F.regexp_extract_all(prepared, F.lit(f"({WORD_NOT_NUMBER})"), F.lit(1))


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_texts(values: Iterable[str]) -> str:
    """A list of strings for SQL `IN`; a hashed set once planned.

    As one SQL text it reaches the JVM in a single call, where a list of literal columns takes a
    call for each.
    """
    return "(" + ", ".join(sql_text(value) for value in sorted(set(values))) + ")"


def keep_content(tokens: Column, stop_words: Iterable[str] = (), min_chars: int = 2) -> Column:
    """Drop tokens that are too short or on the stop list."""
    wanted = f"length(token) >= {int(min_chars)}"
    stop = set(stop_words)
    if stop:
        wanted += f" AND token NOT IN {sql_texts(stop)}"
    return F.call_function("filter", tokens, F.expr(f"token -> {wanted}"))


def capitalize_words(text: Column) -> Column:
    """Capitalise each word, lower-case its rest, single spaces between words."""
    def capitalized(word: Column) -> Column:
        # A letter without a capital of its own may become two, of which only one is large.
        head = F.upper(F.substring(word, 1, 1))
        return F.concat(
            F.substring(head, 1, 1), F.lower(F.substr(head, F.lit(2))),
            F.lower(F.substr(word, F.lit(2))),
        )

    parts = F.filter(F.split(text, r"\s+"), lambda word: word != "")
    return F.array_join(F.transform(parts, capitalized), " ")


def drop_quotes(text: Column) -> Column:
    return F.translate(text, "\"'", "")


def clean_label(text: Column) -> Column:
    """The form in which topic labels are stored: no quote marks, tidy spacing and case."""
    return capitalize_words(drop_quotes(text))


def bullet_join(items: Column) -> Column:
    return F.array_join(items, ", ")


def truncate(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def syllables(word: Column) -> Column:
    """Vowel runs, at least one per word."""
    return F.greatest(F.regexp_count(word, F.lit("[aeiouy]+")), F.lit(1))


def reading_grade(text: Column, tokens: Column) -> Column:
    """Flesch-Kincaid grade level of a text and its lower-cased words."""
    n_words = F.size(tokens).cast("double")
    n_sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    n_syllables = F.aggregate(tokens, F.lit(0), lambda total, word: total + syllables(word))
    return F.when(
        n_words > 0,
        F.lit(0.39) * n_words / n_sentences + F.lit(11.8) * n_syllables / n_words - F.lit(15.59),
    )

"""Base forms of nouns.

A form is reduced when an ending rule turns it into a word that the corpus itself contains, or when
a table of irregular forms names its base form. The learned table has one row per changed form and
is small beside the corpus, but it grows with the vocabulary, so applying it has two ways: forms up
to a fixed number are compiled into the expression, any further ones are joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.functions.text import sql_text, sql_texts
from chatterloom.functions.wordlists import NOUN_ENDINGS, STOP_WORDS
from chatterloom.operators.evaluate import compute_once
from chatterloom.operators.joins import fits, key_filter, lookup_join, perhaps_known, replaced_in_rows

#: Most frequent changed forms that are compiled into the expression, and the number of further ones
#: up to which they are broadcast instead of shuffled.
INLINE_FORMS = 50_000
BROADCAST_FORMS = 1_000_000


def _reduced(form: Column, ending: str, replacement: str) -> Column:
    return F.concat(
        F.substring(form, F.lit(1), F.length(form) - F.lit(len(ending))), F.lit(replacement)
    )


def learn_lemmas(
    corpus: DataFrame, irregular: DataFrame | None = None, keep: Iterable[str] = STOP_WORDS,
    min_chars: int = 2,
) -> DataFrame:
    """Learn `(form, lemma, cf)` from a corpus with `tokens`; `cf` is the form's frequency.

    Among the accepted reductions the shortest wins. Forms in `keep` are left alone. Rows of
    `irregular (form, lemma)` override the rules for the forms they name.
    """
    # Not the bare column: for that, a filter on it would be added and its text read twice.
    tokens = F.filter("tokens", lambda token: token != "")
    words = corpus.select(F.explode(tokens).alias("form")).groupBy("form").agg(
        F.count("*").alias("cf")
    )
    keep = set(keep)
    free = F.expr(f"form NOT IN {sql_texts(keep)}") if keep else F.lit(True)
    entry = "array<struct<lemma:string,form:string,cf:bigint>>"
    reductions = [
        F.when(F.endswith("form", F.lit(ending)), _reduced(F.col("form"), ending, new))
        for ending, new in NOUN_ENDINGS
    ]
    options = F.when(
        free,
        F.transform(
            F.filter(F.array(*reductions), lambda option: F.length(option) >= min_chars),
            lambda option: F.struct(option, F.col("form"), F.col("cf")),
        ).cast(entry),
    ).otherwise(F.array().cast(entry))
    # Every word meets the forms that reduce to it: a group holds one row per ending rule at most.
    itself = F.array(F.struct(F.col("form"), F.lit(None), F.lit(None))).cast(entry)
    accepted = (
        words.select(F.inline(F.concat(itself, options)))
        .groupBy("lemma")
        .agg(
            F.bool_or(F.col("form").isNull()).alias("is_word"),
            F.collect_list(
                F.when(F.col("form").isNotNull(), F.struct("form", "cf"))
            ).alias("forms"),
        )
        .where("is_word")
        .select("lemma", F.inline("forms"))
    )
    learned = (
        accepted.groupBy("form", "cf")
        .agg(F.min(F.struct(F.length("lemma").alias("chars"), "lemma")).alias("best"))
        .select("form", F.col("best.lemma").alias("lemma"), "cf")
    )
    if irregular is None:
        return learned
    listed = irregular.select("form", F.col("lemma").alias("listed"))
    return (
        words.join(listed, "form", "left")
        .join(learned.select("form", "lemma"), "form", "left")
        .select("form", F.coalesce("listed", "lemma").alias("lemma"), "cf")
        .where(F.col("lemma").isNotNull() & (F.col("lemma") != F.col("form")))
    )


def replace_tokens(
    df: DataFrame, lemmas: DataFrame, key: Iterable[str] = ("conv_id",),
    inline_forms: int = INLINE_FORMS,
) -> DataFrame:
    """Replace every token that is a `form` of `lemmas (form, lemma, cf)` by its lemma.

    Up to `inline_forms` are compiled into the expression, more are sent to all tasks while their texts are small,
    and beyond that a filter leaves few places for a join; only then is `key` used, which must identify a row.
    """
    top = lemmas.orderBy(F.desc("cf"), "form").limit(inline_forms + 1).collect()
    inline = {row["form"]: row["lemma"] for row in top[:inline_forms]}
    replaced = F.expr(f"transform(tokens, token -> {_inline_lemma(inline)})")
    if len(top) <= inline_forms:
        return compute_once(df, {"tokens": replaced})

    if fits(lemmas, "form", "lemma"):
        return replaced_in_rows(df, "tokens", lemmas, "form", "lemma")

    # Rarer forms are joined; the frequent ones, handled in place, never reach the join.
    key = list(key)
    frequent = F.expr(f"form IN {sql_texts(inline)}") if inline else F.lit(False)
    rest = lemmas.where(~frequent).select("form", "lemma")
    spots = df.select(*key, F.posexplode("tokens").alias("pos", "form")).where(~frequent)
    hits = lookup_join(
        perhaps_known(spots, *key_filter(rest, "form"), "form"), rest, ["form"], "inner", rows=BROADCAST_FORMS, spread_by=[*key, "pos"]
    )
    changes = hits.groupBy(*key).agg(F.collect_list(F.struct("pos", "lemma")).alias("changes"))
    both = compute_once(df, {"tokens": replaced}).join(changes, key, "left")
    merged = F.sort_array(_merged_positions("tokens", "changes", "lemma"))
    both = compute_once(both, {"_merged": merged})
    return compute_once(both, {"tokens": _latest_per_position("_merged")}).drop(
        "changes", "_merged"
    )


def _inline_lemma(inline: dict[str, str]) -> str:
    """SQL for the lemma of `token`: set lookups by kind of change, a few hash probes per token."""
    by_rule: dict[tuple[str, str], list[str]] = {}
    others: dict[str, str] = {}
    for form, lemma in inline.items():
        for ending, new in sorted(NOUN_ENDINGS, key=lambda rule: -len(rule[0])):
            if form.endswith(ending) and form[: len(form) - len(ending)] + new == lemma:
                by_rule.setdefault((ending, new), []).append(form)
                break
        else:
            others[form] = lemma

    cases = [
        f"WHEN token IN {sql_texts(forms)} THEN "
        f"concat(substring(token, 1, length(token) - {len(ending)}), '{new}')"
        for (ending, new), forms in sorted(by_rule.items())
    ]
    if others:
        pairs = ", ".join(sql_text(text) for item in sorted(others.items()) for text in item)
        cases.append(f"WHEN token IN {sql_texts(others)} THEN element_at(map({pairs}), token)")
    return f"CASE {' '.join(cases)} ELSE token END" if cases else "token"


def _merged_positions(tokens: str, changes: str, field: str) -> Column:
    """Entries `(pos, rank, value)`: all tokens with rank 0, all changes with rank 1."""
    old = F.transform(
        tokens,
        lambda token, i: F.struct(i.alias("pos"), F.lit(0).alias("rank"), token.alias("value")),
    )
    new = F.transform(
        changes,
        lambda change: F.struct(
            change["pos"].alias("pos"), F.lit(1).alias("rank"), change[field].alias("value")
        ),
    )
    return F.when(F.col(changes).isNull(), old).otherwise(F.concat(old, new))


def _latest_per_position(merged: str) -> Column:
    """Values of sorted entries, a change hiding the token at its position. One linear pass."""
    entries = F.col(merged)

    def is_last(entry: Column, i: Column) -> Column:
        following = F.get(entries, i + 1)
        return following.isNull() | (following["pos"] != entry["pos"])

    return F.transform(F.filter(entries, is_last), lambda entry: entry["value"])

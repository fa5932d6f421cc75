"""Quality rules kept as a ledger of failure bits, judged by versioned policies.

`ledger` reads every text once and stores, per document, the measurements and one bit per rule that
the document fails. A policy is a mask of bits, so judging by another version, or asking what a rule
costs, reads eight bytes per document and no text.

Defined results: a null or empty text has no words and fails FEW_WORDS; repeated rows are judged row
by row; rows with a null key keep it; an empty table gives an empty ledger. Other columns, whatever
their names, are ignored by `ledger` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import (
    as_bytes, read_table, rows_of, prepare, window_hashes, word_hashes, words,
)

#: Rules by bit. The first two form the base verdict.
RULES = ("few_words", "repeated_windows", "many_symbols", "odd_word_length", "repeated_lines")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": RULES,
}
CURRENT = "v1"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PERCENT = 30
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 25
MAX_DUP_LINES_PERCENT = 50
REPEAT_WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# One class per byte of UTF-8: continuation, white space, symbol, other first byte.
_CONTINUED, _SPACE, _SYMBOL, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _CONTINUED
_CLASS[list(b" \t\n\v\f\r")] = _SPACE
_CLASS[list(b"#*$%&|<>")] = _SYMBOL


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(rule) for rule in rules)


def repeated_words(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur at least twice."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[place] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[starts] += 1
    cover[starts + width] -= 1
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def measure(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or b""
    tokens = words(text)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=4)
    lines, seen, repeats = text.split(b"\n"), set(), 0
    worded = 0
    for line in lines:
        if line.strip():
            worded += 1
            repeats += line in seen
            seen.add(line)
    return (
        len(tokens), int(kinds[_SYMBOL] + kinds[_OTHER]), int(kinds[_SYMBOL]), worded, repeats,
        repeated_words(word_hashes(tokens)),
    )


def failures(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) -> int:
    """The bits of the rules that these measurements fail."""
    failed = (
        n_words < MIN_WORDS,
        100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words,
        100 * n_symbols > MAX_SYMBOLS_PERCENT * n_words,
        not MIN_WORD_CHARS * n_words <= word_chars <= MAX_WORD_CHARS * n_words,
        100 * n_dup_lines > MAX_DUP_LINES_PERCENT * n_lines,
    )
    return sum(1 << bit for bit, fails in enumerate(failed) if fails)


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, MEASURES..., fail_bits)`: one row per row of `df`, every rule evaluated once."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [measure(value) for value in as_bytes(batch.column(1))]
            columns = [pa.array(column, pa.int64()) for column in zip(*found)]
            bits = pa.array([failures(*row) for row in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, bits], names=["key", *MEASURES, "fail_bits"]
            )

    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{name} bigint" for name in (*MEASURES, "fail_bits"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)


def verdicts(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with `base_failed` and, under a policy, `kept`."""
    def fails(name: str):
        return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[name]))) != 0

    return entries.withColumn("base_failed", fails("base")).withColumn(
        "kept", ~F.col("base_failed") & ~fails(policy)
    )


def ablations(entries: DataFrame) -> DataFrame:
    """`(policy, rule, n_docs, n_fail, n_only, n_kept, n_kept_without)` for every policy and rule.

    Documents are first counted per pattern of bits, of which there are at most 2 ** len(RULES); the
    rest is bit arithmetic on those few rows.
    """
    spark = entries.sparkSession
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.createDataFrame(
        [
            (policy, rule, mask(rules), mask((rule,)))
            for policy, rules in POLICIES.items() for rule in rules
        ],
        "policy string, rule string, mask bigint, bit bigint",
    )
    bits = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    # One row per pattern meets one row per rule: both are bounded by the number of rules.
    joined = asked.withColumn("one", F.lit(1)).join(
        F.broadcast(patterns.withColumn("one", F.lit(1))), "one", "left"
    )
    return joined.groupBy("policy", "rule").agg(
        total(F.col("n").isNotNull()).alias("n_docs"),
        total(bits.bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        total(bits == F.col("bit")).alias("n_only"),
        total(bits == 0).alias("n_kept"),
        total((bits == 0) | (bits == F.col("bit"))).alias("n_kept_without"),
    )


def keep_good(df: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of `df` that a policy keeps, with all their columns, judged in one pass."""
    prepare(df.sparkSession)
    place, rejects = df.columns.index(text), mask(POLICIES[policy]) | mask(POLICIES["base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [failures(*measure(value)) for value in as_bytes(batch.column(place))]
            yield batch.filter(pa.array([not bits & rejects for bits in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return verdicts(ledger(read_table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "fail_bits", "n_lines",
    )


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {_WORDS} AS w
  FROM documents
),
lines AS (
  SELECT row_id, line, count(*) AS n
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id, line
),
line_sums AS (
  SELECT row_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) AS BIGINT) AS n_dup FROM lines
  GROUP BY row_id
),
win AS (
  SELECT row_id, i, array_to_string(w[i:i + 4], ' ') AS win
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
),
again AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS n FROM win)
  WHERE n > 1
),
cover AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat
  FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY row_id
),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN line_sums USING (row_id) LEFT JOIN cover USING (row_id)
),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CAST((n_words < {MIN_WORDS})::INT
    + 2 * (100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)::INT
    + 4 * (100 * n_symbols > {MAX_SYMBOLS_PERCENT} * n_words)::INT
    + 8 * (word_chars < {MIN_WORD_CHARS} * n_words OR word_chars > {MAX_WORD_CHARS} * n_words)::INT
    + 16 * (100 * n_dup_lines > {MAX_DUP_LINES_PERCENT} * n_lines)::INT AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND fail_bits = 0 AS kept, fail_bits, n_lines
FROM f
"""

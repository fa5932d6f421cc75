"""Spelling variants by pivotal grams: words at an edit distance of exactly one.

All bigrams have one order, the rarer first. The prefix of a word is its first PREFIX bigrams in this order;
its pivots are PIVOTS of these that do not overlap, chosen by dynamic programming so that their lists
are shortest. One edit spoils one pivot at most, so of two near words the one whose prefix ends earlier has
a pivot that the other has in its prefix, at the same place or one beside it. Pivots are therefore
joined with prefixes, and what meets is verified.

Where a pivot survives, the edit is on one side of it: the other side is the same in both words, and so
is one half of the side with the edit, cut in the middle of the pivot's word. The key of the index is therefore the
pivot with its place, the length of the word, the side and what must be the same. A common bigram is then no hot key,
and few candidates fail the verification.

Words are counted inside the tasks before they are shuffled; bigrams are at most the square of the alphabet
(90 characters), so their order may be sent to all tasks. Tables of words are not: they are joined by a sort, as
the engine takes the index for as small as the words that it is made of, and a staged table for as small as its file.

Defined results: a null or empty text has no words; a row without a key counts as one with an empty key; repeated
rows count each; words of equal count are ordered by code points. An empty table gives no words. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import collections
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import area_for, as_bytes, prepare, read_table, rows_of
from chatterloom.sources.staging import StagingArea

#: Edits, bigrams of a prefix and pivots: one edit touches two bigrams at most.
EDITS = 1
PREFIX, PIVOTS = 2 * EDITS + 1, EDITS + 1
#: Least code points and occurrences of a word.
MIN_CHARS, MIN_COUNT = 5, 3
#: How many times as common as a word its form is, at least.
FORM_RATIO = 2
#: One of so many pairs of document and run loses a code point.
DAMAGE = 97
#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 200_000
#: Code points of a word from which two words are compared in linear time.
LONG_CHARS = 64
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def damaged(run: str, start: int) -> str:
    """The run, without one code point if the checksum that begins with `start` says so."""
    value = zlib.crc32(run.encode(), start)
    if value % DAMAGE:
        return run
    at = value % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(word, n)` of the words of MIN_CHARS code points or more that occur MIN_COUNT times or more."""
    prepare(df.sparkSession)
    narrow = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))

    def told(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in rows_of(batches):
            for name, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if not raw:
                    continue
                start = zlib.crc32(f"{name or ''}:".encode())
                # Bytes are lower-cased as ASCII, that is A to Z only.
                for found, times in collections.Counter(_RUN.findall(raw.lower().decode())).items():
                    word = damaged(found, start)
                    if len(word) >= MIN_CHARS:
                        counts[word] = counts.get(word, 0) + times
                if len(counts) >= COUNTED_WORDS:
                    yield told(counts)
                    counts = {}
        yield told(counts)

    counted = narrow.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, str]]:
    """Bigram -> its place in the common order: the number of words' places that hold it, then itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: collections.Counter[str] = collections.Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update(map("".join, zip(word, word[1:])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["gram", "n"]
        )

    held = words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {row.gram: (row.n, row.gram) for row in held.collect()}


def prefix_of(word: str, ranks: dict[str, tuple[int, str]]) -> list[tuple[int, int]]:
    """`(place, cost)` of the first bigrams of a word in the common order, by place."""
    order = sorted((ranks[word[i:i + 2]], i) for i in range(len(word) - 1))
    return sorted((i, cost) for (cost, _), i in order[:PREFIX])


def pivots_of(prefix: list[tuple[int, int]], number: int = PIVOTS) -> list[int]:
    """Places of `number` bigrams that do not overlap, of least cost in sum.

    best[k] is the cheapest choice of k bigrams among those seen; `open_` is what a bigram may follow, that is
    the choices among bigrams that end before it.
    """
    none = (float("inf"), ())
    table: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] + [none] * number]
    for j, (place, cost) in enumerate(prefix):
        free = sum(1 for other, _ in prefix[:j] if other + 2 <= place)
        open_ = table[free]
        table.append([
            min(table[j][k], (open_[k - 1][0] + cost, (*open_[k - 1][1], place)) if k else none)
            for k in range(number + 1)
        ])
    return list(table[-1][number][1])


def surviving_keys(word: str, at: int, length: int) -> Iterator[str]:
    """What `word` shares with a word at distance one if the bigram at `at` survives in both.

    `length` is that of the pivot's word, in which all is cut: with its own length a word gives the keys of a
    pivot, with the others those by which a word that is longer or shorter by one is found.
    """
    longer = len(word) - length
    rest = length - at - 2
    if rest >= 0:  # the edit is on the right, places count from the left
        near = (rest + 1) // 2
        if len(word) >= at + 2 + near:
            yield f"1|{length}|{at}|{word[:at + 2 + near]}"
        if rest:
            yield f"2|{length}|{at}|{word[:at + 2]}|{word[len(word) - rest + near:]}"
    place = at - longer
    if place >= 0:  # the edit is on the left, places count from the right
        far = (place + 1) // 2
        yield f"3|{length}|{place}|{word[:far]}|{word[at:]}"
        if place:
            yield f"4|{length}|{place}|{word[far + longer:]}"


def _index(words: DataFrame, ranks: dict[str, tuple[int, str]], pivots: bool) -> DataFrame:
    """`(key, word, n)`: the keys of the pivots of each word, or those by which its prefix is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            keys, place = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                prefix = prefix_of(word, ranks)
                found: set[str] = set()
                for at in pivots_of(prefix) if pivots else [at for at, _ in prefix]:
                    lengths = (len(word),) if pivots else range(len(word) - EDITS, len(word) + EDITS + 1)
                    for length in lengths:
                        found.update(surviving_keys(word, at, length))
                keys += map(xxhash.xxh3_64_intdigest, found)
                place += [i] * len(found)
            rows = batch.take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.uint64()).view(pa.int64()), rows.column(0), rows.column(1)], names=["key", "word", "n"]
            )

    return words.mapInArrow(run, "key bigint, word string, n bigint")


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes the one the other."""
    same = len(os.path.commonprefix((a, b)))
    return a != b and a[same + (len(a) >= len(b)):] == b[same + (len(b) >= len(a)):]


def _truly_near(met: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            yield batch.filter(pa.array(map(one_apart, batch.column("word").to_pylist(), batch.column("other").to_pylist()), pa.bool_()))

    return met.mapInArrow(run, met.schema)


def near_words(words: DataFrame, area: StagingArea | None = None) -> DataFrame:
    """`(word, n, other, other_n)`: all pairs of words at distance one, each in both directions once."""
    area = area_for(words, area)
    prepare(words.sparkSession)
    ranks = gram_ranks(words)

    def met(held: DataFrame) -> DataFrame:
        prefixes = _index(held, ranks, False).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
        return _index(held, ranks, True).join(prefixes.hint("merge"), "key").where("word <> other").drop("key")

    # The built-in distance takes the square of the length, so very long words have a linear test.
    short = met(words.where(F.length("word") <= LONG_CHARS)).where(F.levenshtein("word", "other", EDITS) == EDITS)
    long = _truly_near(met(words.where(F.length("word") >= LONG_CHARS)))
    first = F.col("word") < F.col("other")
    pairs = area.stage(short.unionByName(long).select(
        F.least("word", "other").alias("word"), F.when(first, F.col("n")).otherwise(F.col("other_n")).alias("n"),
        F.greatest("word", "other").alias("other"), F.when(first, F.col("other_n")).otherwise(F.col("n")).alias("other_n"),
    ).distinct(), "pairs")
    return pairs.unionByName(pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    ))


def roots(forms: DataFrame, area: StagingArea) -> DataFrame:
    """`(word, root)` for every word of `forms` (word, form), following forms to the last.

    Each round doubles the way that is known. Counts at least double with each form, so there are few rounds.
    """
    current = area.stage(forms.select("word", F.col("form").alias("root")), "roots-0")
    number = 0
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = current.join(further.hint("merge"), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        number += 1
        current = area.stage(moved, f"roots-{number}")
        if current.where("moved").limit(1).count() == 0:
            return current.select("word", "root")
        current = current.drop("moved")


def spelling_forms(
    df: DataFrame, key: str = "doc_id", text: str = "text", area: StagingArea | None = None
) -> DataFrame:
    """`(word, n, n_near, form, form_n, root)` for every word of the texts."""
    area = area_for(df, area)
    words = area.stage(word_counts(df, key, text), "words")
    near = near_words(words, area).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), "other")).alias("best")
    )
    told = words.join(near.hint("merge"), "word", "left")
    commoner = -F.col("best.least") >= FORM_RATIO * F.col("n")
    told = area.stage(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(commoner, F.col("best.other")).alias("form"), F.when(commoner, -F.col("best.least")).alias("form_n"),
    ), "forms")
    ends = roots(told.where("form IS NOT NULL"), area)
    return told.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_forms(read_table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP13_SQL = f"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc
  FROM range(256) r(i)
),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
  ) GROUP BY doc_id, run
),
coded AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295, [CAST(instr('0123456789ABCDEF', b[1]) * 16 + instr('0123456789ABCDEF', b[2]) - 17 AS BIGINT)
      FOR b IN regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..')]),
    lambda c, b: xor(crc[xor(c, b) % 256 + 1], c // 256)), 4294967295) AS h
  FROM runs, t
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % {DAMAGE} = 0
      THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word
    FROM coded
  ) GROUP BY word HAVING length(word) >= {MIN_CHARS} AND sum(n) >= {MIN_COUNT}
),
cut AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near
  FROM pairs
),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= {FORM_RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {FORM_RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word AND place = 1
),
ways AS (
  SELECT word, word AS root FROM forms
  UNION ALL
  SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL
),
ends AS (SELECT ways.word, ways.root FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NULL)
SELECT forms.word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)
"""

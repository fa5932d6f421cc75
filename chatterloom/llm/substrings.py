"""Substring dedup by super-k-mer partitioning, with words for letters.

A window is WIDTH consecutive words of a text. Its minimiser is the least hash among the runs of SEED
words inside it, which depends on the words of the window alone. Consecutive windows with the same
minimiser form a super-k-mer, and equal windows, wherever they stand, have the same minimiser. So it is
enough to compare windows inside the bucket of a minimiser, and only where the minimiser occurs again.

1. Every text is cut into super-k-mers: narrow rows of minimiser, fingerprint, place and length.
2. Those whose minimiser occurs once in the corpus hold no repeated window and go no further. Equal ones
   are combined before the shuffle: each but the first, by key and place, is removed as a whole.
3. The first of each travels as one packed string to the bucket of its minimiser, where the windows are
   sorted by their words and each but the first of equals is removed.
4. A minimiser with more than HOT_VARIANTS different super-k-mers is no bucket: its windows are grouped
   one by one, combined before the shuffle, and joined with the first of equals.

So a passage, or near copies of one, in a third of all texts is no burden to any task: copies are one row per
task, and a bucket holds HOT_VARIANTS strings at most. Texts are shuffled only where something is read from
them or removed; a text that repeats nothing stays where it is.

Defined results: a null or empty text has no words; rows without a key keep their words and are compared
with none; rows that share a key are one document, in which equal places are no earlier than each other, so
that repeated rows lose the same words; if their texts differ, what is removed at a place is removed from
each of them. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import (
    area_for, as_bytes, bitmap_of, marked_by, perhaps_in, prepare, read_table, rows_of, window_hashes, word_hashes, words,
)
from chatterloom.sources.staging import StagingArea

#: Words of a window, and of the runs among which its minimiser is sought.
WIDTH, SEED = 20, 8
#: Different super-k-mers of one minimiser up to which they are compared in one bucket.
HOT_VARIANTS = 2_000
#: Packed strings that a task compares at once, in whole buckets.
BUCKET_ROWS = 4_096
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def super_kmers(hashes: np.ndarray, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """`(start, windows, minimiser, fingerprint, times)` of each super-k-mer of a text, from its word hashes.

    A super-k-mer of n windows starting at word s covers the words s to s + n + width - 2. `times` is 2 if the
    minimiser stands in it more than once, so that it may repeat a window itself, and 1 otherwise.
    """
    count = len(hashes) - width + 1
    if count < 1:
        return (np.zeros(0, np.int64),) * 5
    runs = window_hashes(hashes, seed)
    # The least of the runs in each window, in steps that double the reach.
    span, least, reach = width - seed + 1, runs, 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    windows = np.diff(np.append(start, count))
    times = np.ones(len(start), np.int64)
    ordered = np.sort(runs)
    double = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(double):
        for i in np.flatnonzero(np.isin(least[start], double)).tolist():
            reached = runs[start[i]:start[i] + windows[i] + span - 1]
            times[i] = min(2, np.count_nonzero(reached == least[start[i]]))
    # The fingerprint of a stretch of words: differences of running sums, made independent of the place.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(len(hashes)))))
    stretch = sums[start + windows + width - 1] - sums[start]
    stretch *= _inverse_powers(len(hashes))[start]
    stretch ^= windows.astype(np.uint64) * _FACTOR
    stretch = (stretch ^ (stretch >> np.uint64(31))) * _FACTOR
    return start, windows, least[start].view(np.int64), (stretch ^ (stretch >> np.uint64(29))).view(np.int64), times


def _power_table(factor: int):
    """A function giving the first n powers of an odd factor, modulo 2^64, kept for the longest text so far."""
    held = np.ones(1, np.uint64)

    def table(n: int) -> np.ndarray:
        nonlocal held
        while len(held) < n:
            top = np.uint64(pow(factor, len(held), 1 << 64))
            held = np.concatenate((held, held * top))
        return held[:n]

    return table


_BASE = 0xD6E8FEB86659FD93
_powers, _inverse_powers = _power_table(_BASE), _power_table(pow(_BASE, -1, 1 << 64))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def _cut(keyed: DataFrame, width: int, seed: int) -> DataFrame:
    kind = keyed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [super_kmers(word_hashes(words(text)), width, seed) for text in as_bytes(batch.column(1))]
            place = np.repeat(np.arange(batch.num_rows), [len(part[0]) for part in found])
            start, windows, least, fingerprint, times = (np.concatenate(parts) for parts in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least), pa.array(fingerprint), batch.column(0).take(pa.array(place, pa.int64())),
                    pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(times, pa.int32()),
                ],
                names=["least", "print", "key", "start", "windows", "times"],
            )

    return keyed.mapInArrow(run, f"least bigint, print bigint, key {kind}, start int, windows int, times int")


def _packed(texts: DataFrame, width: int) -> DataFrame:
    """`(least, key, start, packed)` of the super-k-mers listed in `parts` of each text."""
    kind = texts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            least, place, starts, packed = [], [], [], []
            for i, (text, parts) in enumerate(zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())):
                tokens = words(text)
                for part in parts:
                    least.append(part["least"])
                    place.append(i)
                    starts.append(part["start"])
                    packed.append(b" ".join(tokens[part["start"]:part["start"] + part["windows"] + width - 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least, pa.int64()), batch.column(0).take(pa.array(place, pa.int64())),
                    pa.array(starts, pa.int32()), pa.array(packed, pa.binary()),
                ],
                names=["least", "key", "start", "packed"],
            )

    return texts.mapInArrow(run, f"least bigint, key {kind}, start int, packed binary")


def later_windows(document: np.ndarray, start: np.ndarray, packed: list[bytes], width: int = WIDTH):
    """`(row, begin, end)`: stretches of words whose windows also start earlier in these packed strings.

    Rows are ordered by document and start. Windows are sorted by a hash of their words; those of one hash
    are compared word by word.
    """
    tokens: list[bytes] = []
    size = np.zeros(len(packed), np.int64)
    for i, text in enumerate(packed):
        held = text.split()
        size[i] = len(held)
        tokens += held
    number = {token: i for i, token in enumerate(dict.fromkeys(tokens))}
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    windows = np.maximum(size - width + 1, 0)
    row = np.repeat(np.arange(len(packed)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(size) - size, windows) + offset
    if not len(row):
        return row, row, row
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value = (value + ids[at + k].astype(np.uint64) + np.uint64(1)) * _FACTOR
        value ^= value >> np.uint64(32)
    position = start[row] + offset
    order = np.lexsort((position, document[row], value))
    same = value[order][1:] == value[order][:-1]
    pairs = np.flatnonzero(same)
    for k in range(width):
        if (ids[at[order[pairs + 1]] + k] != ids[at[order[pairs]] + k]).any():
            # Two different windows of one hash: sort by the words themselves.
            table = ids[at[:, None] + np.arange(width)]
            order = np.lexsort((position, document[row], *table.T))
            same = (table[order][1:] == table[order][:-1]).all(1)
            break
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    first = np.repeat(order[first], np.diff(np.append(first, len(order))))
    # Equal windows at the same place of rows that share a key are not earlier than each other.
    later = (document[row[order]] != document[row[first]]) | (position[order] != position[first])
    gone = np.zeros(len(row), bool)
    gone[order[later]] = True
    begins = gone & np.concatenate(([True], ~gone[:-1] | (row[1:] != row[:-1])))
    ends = gone & np.concatenate((~gone[1:] | (row[1:] != row[:-1]), [True]))
    return row[begins], position[begins], position[ends] + width


def _in_buckets(packed: DataFrame, width: int) -> DataFrame:
    """`(key, begin, end)`: what is removed from the strings, bucket by bucket."""
    kind = packed.schema["key"].dataType.simpleString()

    def compared(held: pa.Table) -> pa.RecordBatch:
        keys = held.column("key").combine_chunks()
        changes = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
        document = np.concatenate((np.zeros(1, np.int64), np.cumsum(changes)))
        # Documents are numbered in order within a bucket; equal windows are in one bucket.
        row, begin, end = later_windows(
            document, held.column("start").to_numpy().astype(np.int64), held.column("packed").to_pylist(), width
        )
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(row, pa.int64())), pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
            names=["key", "begin", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < BUCKET_ROWS:
                continue
            table = pa.Table.from_batches(held)
            least = table.column("least").to_numpy()
            whole = int(np.searchsorted(least, least[-1]))  # the last bucket may go on
            if whole:
                yield compared(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows -= whole
        if rows:
            yield compared(pa.Table.from_batches(held))

    return packed.repartition("least").sortWithinPartitions("least", "key", "start").mapInArrow(
        run, f"key {kind}, begin int, end int"
    )


def _one_by_one(packed: DataFrame, width: int) -> DataFrame:
    """`(key, begin, end)` for minimisers with too many strings for a bucket."""
    tokens = packed.select("key", "start", F.split(F.col("packed").cast("string"), " ", -1).alias("tokens"))
    tokens = tokens.where(F.size("tokens") >= width)
    windows = tokens.select("key", "start", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - width)).alias("offset"))
    placed = windows.select(
        "key", (F.col("start") + F.col("offset")).alias("begin"),
        F.array_join(F.slice("tokens", F.col("offset") + 1, width), " ").alias("window"),
    )
    first = placed.groupBy("window").agg(F.min(F.struct("key", "begin")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("window", "first")
    return placed.join(first, "window").where("key <> first.key OR begin <> first.begin").select(
        "key", "begin", (F.col("begin") + width).alias("end")
    )


def repeated_stretches(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED,
    area: StagingArea | None = None,
) -> DataFrame:
    """`(key, begin, end)`: stretches of words, from 0 and without the end, covered by windows that also start earlier."""
    area = area_for(df, area)
    prepare(df.sparkSession)
    keyed = _keyed(df, key, text)
    cut = area.stage(_cut(keyed, width, seed), "super-kmers")
    again = cut.groupBy("least").agg(F.sum("times").alias("times")).where("times > 1").select("least")
    again = area.stage(again, "minimisers")
    near = perhaps_in(cut, bitmap_of(again, "least"), "least")
    held = area.stage(near.join(again, "least").drop("times"), "held")
    first = F.min(F.struct("key", "start")).alias("first")
    strings = area.stage(
        held.groupBy("least", "print").agg(first, F.first("windows").alias("windows")).select(
            "least", "print", F.col("first.key").alias("key"), F.col("first.start").alias("start"), "windows"
        ), "strings",
    )
    parts = strings.groupBy("key").agg(F.collect_list(F.struct("least", "start", "windows")).alias("parts"))
    texts = perhaps_in(keyed, bitmap_of(parts, "key"), "key").join(parts, "key").select("key", "text", "parts")
    packed = area.stage(_packed(texts, width), "packed")
    hot = packed.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_VARIANTS).select("least")
    hot = area.stage(hot, "hot")
    from_buckets = _in_buckets(packed.join(hot, "least", "left_anti"), width)
    from_windows = _one_by_one(packed.join(hot, "least", "left_semi"), width)
    # Of equal super-k-mers all but the first go as a whole.
    copies = held.join(
        strings.select("least", "print", F.col("key").alias("first_key"), F.col("start").alias("first_start")), ["least", "print"]
    ).where("key <> first_key OR start <> first_start").select(
        "key", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (width - 1)).alias("end")
    )
    return from_buckets.unionByName(from_windows).unionByName(copies)


def without_substrings(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, area: StagingArea | None = None
) -> DataFrame:
    """`(key, n_words, n_removed, kept)` of every row; `kept` is what is left, joined by blanks, in UTF-8."""
    area = area_for(df, area)
    prepare(df.sparkSession)
    stretches = repeated_stretches(df, key, text, width, area=area)
    gone = area.stage(
        stretches.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("gone")), "gone"
    )
    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    marks = bitmap_of(gone, "key")
    marked = marked_by(narrow, marks, "touched", "key")
    joined = marked.where("touched").join(gone, "key", "left")
    others = marked.where("NOT touched").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n_words, n_removed, kept = [], [], []
            for raw, stretches in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                tokens = words(raw)
                left = tokens
                if stretches:
                    stays = np.zeros(len(tokens) + 1, np.int64)
                    begin, end = np.array([(s["begin"], s["end"]) for s in stretches], np.int64).T
                    np.add.at(stays, np.minimum(begin, len(tokens)), 1)
                    np.add.at(stays, np.minimum(end, len(tokens)), -1)
                    left = [tokens[i] for i in np.flatnonzero(np.cumsum(stays)[:-1] == 0)]
                n_words.append(len(tokens))
                n_removed.append(len(tokens) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["key", "n_words", "n_removed", "kept"],
            )

    return joined.unionByName(others).select("key", "text", "gone").mapInArrow(
        run, f"key {kind}, n_words bigint, n_removed bigint, kept binary"
    ).withColumnRenamed("key", key)


def op11_substrings(spark, sf_dir: str) -> DataFrame:
    found = without_substrings(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH} + 2)) AS s FROM d WHERE doc_id IS NOT NULL),
later AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + {WIDTH} - 1], ' ') ORDER BY doc_id, s) AS n
    FROM placed
  ) WHERE n > 1
),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM later, (SELECT unnest(range({WIDTH})) AS k)),
kept AS (
  SELECT d.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN d.word END, ' ' ORDER BY d.i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) d
  LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.i = d.i GROUP BY d.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

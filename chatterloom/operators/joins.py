"""Joins to lookup tables that stay safe when a key is hot or the table is large."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.sources.shipping import limit_batches, ship_package

#: Largest lookup table that is sent to every executor.
BROADCAST_ROWS = 100_000
#: Pieces into which the rows of one key are split beyond that.
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows, found without counting further."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
    rows: int = BROADCAST_ROWS, spread_by: Sequence[str] | None = None,
    known_rows: int | None = None,
) -> DataFrame:
    """Join `df` to a lookup table with one row per key.

    A table of at most `rows` rows is broadcast, so `df` is not shuffled. Whether it is, is counted,
    unless `known_rows` says how many rows it was limited to. A larger one is copied
    once per salt and `df` is spread over the salts by a hash of `spread_by` (all its columns
    when not given): no task receives all rows of a hot key. `how` is inner, left, left_semi or
    left_anti; all are exact with copied lookup rows because each left row meets one copy.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join {how!r}")
    on = list(on)
    small = is_small(table, rows) if known_rows is None else known_rows <= rows
    if small:
        return df.join(F.broadcast(table), on, how)
    salted = df.withColumn(
        "_salt", F.pmod(F.xxhash64(*(spread_by or df.columns)), F.lit(SALTS)).cast("int")
    )
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


# --- large sets of words, looked up inside rows ----------------------------------------------------

#: Bytes of a set of words that is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Bits of a filter per key, bits of one of its pieces, and most pieces: 64 MB.
FILTER_BITS, PIECE_BITS, FILTER_PIECES = 16, 1 << 15, 1 << 14


def fits(table: DataFrame, *columns: str, limit: int | None = None) -> bool:
    """Whether the texts of these columns, with their offsets, take no more than BROADCAST_BYTES in all."""
    sizes = sum((F.coalesce(F.octet_length(name), F.lit(0)) + 8 for name in columns), F.lit(0))
    return (table.agg(F.sum(sizes)).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit)


def key_filter(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """`(piece, bits)` and the number of pieces: a filter of hashed keys, sized by their number."""
    pieces = min(FILTER_PIECES, max(1, math.ceil(keys.count() * FILTER_BITS / PIECE_BITS)))
    place = F.pmod(F.xxhash64(column), F.lit(pieces * PIECE_BITS))
    bits = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    return bits, pieces


def perhaps_known(df: DataFrame, bits: DataFrame, pieces: int, column: str) -> DataFrame:
    """The rows whose hashed key is in the filter: all that have a known key, and few others."""
    place = F.pmod(F.xxhash64(column), F.lit(pieces * PIECE_BITS))
    position = F.bitmap_bit_position(place)
    byte = F.substring("bits", F.floor(position / 8).cast("int") + 1, F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int"))
    return df.withColumn("piece", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "piece").where(held == 1).select(*df.columns)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The entries of an array column end to end, and where each row begins; null rows have none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.append(0, np.cumsum(sizes)).astype(np.int32)


def replaced_in_rows(df: DataFrame, column: str, table: DataFrame, old: str, new: str) -> DataFrame:
    """Every entry of an array column that is an `old` of `table` replaced by its `new`, with the table sent to all tasks.

    Check with `fits` before. Rows are not shuffled.
    """
    ship_package(df.sparkSession)
    limit_batches(df.sparkSession)
    held = table.select(old, new).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((held.column(0).combine_chunks(), held.column(1).combine_chunks()))
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        olds, news = shared.value
        for batch in batches:
            lists = batch.column(place)
            flat, offsets = _flat(lists)
            changed = pc.coalesce(news.cast(flat.type).take(pc.index_in(flat, olds.cast(flat.type))), flat)
            rebuilt = pa.ListArray.from_arrays(pa.array(offsets), changed, mask=lists.is_null() if lists.null_count else None)
            columns = list(batch.columns)
            columns[place] = rebuilt.cast(lists.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def _coded_pairs(pairs: pa.Array, gap: str) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The words of pairs of two words joined by `gap`, the pairs as sorted numbers of these, and pairs that hold
    `gap` more than once, as texts. Numbers take little memory, and only words are hashed again for each batch."""
    gaps = pc.count_substring(pairs, gap)
    parts = pc.split_pattern(pairs.filter(pc.equal(gaps, 1)), gap).flatten()
    words = pc.unique(parts)
    codes = pc.index_in(parts, words).to_numpy(zero_copy_only=False).astype(np.int64)
    return words, np.unique(codes[::2] * len(words) + codes[1::2]), pairs.filter(pc.greater(gaps, 1))


def pair_flags_in_rows(df: DataFrame, column: str, pairs: DataFrame, pair: str, gap: str, output: str) -> DataFrame:
    """Add a text with a character per entry of an array column: 1 where it and the next one, joined by `gap`, are a
    listed pair, else 0; null where the array is. Check with `fits` before."""
    ship_package(df.sparkSession)
    limit_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(_coded_pairs(pairs.select(pair).toArrow().column(0).combine_chunks(), gap))
    place, schema = df.columns.index(column), df.withColumn(output, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, others = shared.value
        for batch in batches:
            lists = batch.column(place)
            flat, offsets = _flat(lists)
            flags = np.zeros(len(flat), bool)
            if len(flat) > 1 and len(known):
                codes = pc.fill_null(pc.index_in(flat, words.cast(flat.type)), -1).to_numpy().astype(np.int64)
                both = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * len(words) + codes[1:], -1)
                flags[:-1] = known[np.minimum(np.searchsorted(known, both), len(known) - 1)] == both
            if len(flat) > 1 and len(others):
                both = pc.binary_join_element_wise(flat[:-1], flat[1:], pa.scalar(gap, flat.type))
                flags[:-1] |= pc.is_in(both, others.cast(flat.type)).to_numpy(zero_copy_only=False)
            flags[offsets[1:][offsets[1:] > 0] - 1] = False  # the last entry of a row has no next one
            data = np.where(flags, ord("1"), ord("0")).astype(np.uint8).tobytes()
            text = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
            if lists.null_count:
                text = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, output])

    return df.mapInArrow(run, schema)

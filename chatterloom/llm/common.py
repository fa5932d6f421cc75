"""What several operators share: words, their hashes, batches of whole texts, and staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.sources.shipping import ship_package
from chatterloom.sources.staging import StagingArea

#: Distinct words whose hashes a worker remembers; the memory is emptied when full.
REMEMBERED_WORDS = 200_000
#: Rows that go to a Python worker at once, so that batches of long texts stay small.
BATCH_ROWS = 1_000
#: Odd multipliers that make the hash of a window depend on the order of its words (fixed values).
WINDOW_MULTIPLIERS = (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than the ASCII white space 0x20 and 0x09 to 0x0D, in UTF-8."""
    return text.split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each window of `width` successive words."""
    count = max(len(hashes) - width + 1, 0)
    mixed = np.zeros(count, np.uint64)
    for offset in range(width):
        mixed += hashes[offset:offset + count] * np.uint64(WINDOW_MULTIPLIERS[offset])
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null for null."""
    return column.cast(pa.binary()).to_pylist()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into small ones, none of them empty."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield batch.slice(start, 256)


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers; lower the session's rows per Arrow batch to BATCH_ROWS."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def area_for(df: DataFrame, area: StagingArea | None) -> StagingArea:
    return area if area is not None else StagingArea(df.sparkSession)


#: Bits of a bitmap of hashed keys: 16 MB at most, however many keys there are.
BITMAP_BITS = 1 << 27


def bitmap_of(keys: DataFrame, *columns: str) -> DataFrame:
    """`(part, bits)`: a bitmap of the hashed keys, of a fixed size, to be sent to all tasks."""
    place = F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS))
    return keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )


def perhaps_in(df: DataFrame, bitmap: DataFrame, *columns: str) -> DataFrame:
    """The rows of `df` whose hashed key is in the bitmap: all that have a key in the table it was made
    from and few others. An exact inner join behind it then shuffles little; a semi join would be moved
    in front of it."""
    place = F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS))
    part, bits = fresh_name(df, "_part"), fresh_name(df, "_bits")
    named = F.broadcast(bitmap.select(F.col("part").alias(part), F.col("bits").alias(bits)))
    position = F.bitmap_bit_position(place)
    byte = F.substring(F.col(bits), F.floor(position / 8).cast("int") + 1, F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int"))
    return df.withColumn(part, F.bitmap_bucket_number(place)).join(named, part).where(held == 1).select(*df.columns)


def marked_by(df: DataFrame, bitmap: DataFrame, mark: str, column: str) -> DataFrame:
    """`df` with a column that tells whether the hashed key is in the bitmap; false where the key is null."""
    place = F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))
    part, bits = fresh_name(df, "_part"), fresh_name(df, "_bits")
    named = F.broadcast(bitmap.select(F.col("part").alias(part), F.col("bits").alias(bits)))
    position = F.bitmap_bit_position(place)
    byte = F.substring(F.col(bits), F.floor(position / 8).cast("int") + 1, F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int")) == 1
    joined = df.withColumn(part, F.bitmap_bucket_number(place)).join(named, part, "left")
    return joined.withColumn(mark, F.col(column).isNotNull() & F.coalesce(held, F.lit(False))).drop(part, bits)


#: Bytes of a staged table that is sent to all tasks.
SENT_BYTES = 32 << 20


def join_staged(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a staged table, sent to all tasks if it takes at most SENT_BYTES when counted, in columns of fixed
    size and lists; else rows meet by a shuffle, of which adaptive execution splits hot keys."""
    sizes = F.lit(0)
    for name, kind in table.dtypes:
        sizes = sizes + (16 + 8 * F.coalesce(F.size(name), F.lit(0)) if kind.startswith("array") else F.lit(16))
    small = (table.agg(F.sum(sizes)).first()[0] or 0) <= SENT_BYTES
    return df.join(F.broadcast(table) if small else table, on, how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have in any spelling."""
    taken = {name.lower() for name in df.columns}
    while base.lower() in taken:
        base += "_"
    return base

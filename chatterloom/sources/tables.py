"""Reading input tables and writing result tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """A CSV file or folder with a header row; quoted cells may span lines.

    Give a schema for large input: inferring types reads the files twice. Where no cell spans lines,
    `multi_line=False` lets several tasks read one file.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A columnar table, such as an exported dataset split."""
    return spark.read.parquet(path)


def read_json_pages(
    spark: SparkSession, path: str, rows_field: str = "rows", row_field: str = "row",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Saved pages of a row service: one JSON document per file with an array of wrapped rows."""
    reader = spark.read.option("multiLine", True)
    pages = (reader.schema(schema) if schema is not None else reader).json(path)
    return pages.select(F.explode(rows_field).alias("entry")).select(f"entry.{row_field}.*")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a result table."""
    df.write.mode(mode).parquet(path)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


#: Bytes that one scan split holds by default.
SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame, *keys: str, part_bytes: int | None = None) -> DataFrame:
    """Give a small input enough partitions for all cores.

    Text work is heavy per byte, so a table that fits into fewer splits than there are cores would
    leave most of them idle. The size is the optimizer's estimate, which needs no job; a table that
    fills the cores, or is of unknown size, is returned untouched. Best used on a scan: estimates
    after joins are far too high.

    With `part_bytes`, a larger table is dealt too, in partitions of about that size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    statistics = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(statistics.sizeInBytes()))
    if part_bytes is not None:
        return df.repartition(max(cores, math.ceil(size / part_bytes)), *keys)
    if size >= cores * SPLIT_BYTES:
        return df
    return df.repartition(cores, *keys)

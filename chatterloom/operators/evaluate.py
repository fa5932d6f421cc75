"""Control over how often an expensive expression is evaluated."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(
    df: DataFrame, columns: Mapping[str, Column], keep: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Add or replace columns that are evaluated exactly once per row; drop rows that fail `keep`.

    The optimizer copies a projected expression into its user, which may be the body of an array
    function that runs per element, and into filters pushed below it. The output of a generator is
    never copied, so the columns are produced by one that yields a single row. `keep` gets the
    struct of the new columns.
    """
    row = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    if keep is not None:
        row = F.filter(row, keep)
    others = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    return df.select(*others, F.inline(row))

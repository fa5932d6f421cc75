"""Exact top-k search by inner product, one term at a time.

Vectors are sparse rows of integer weights. Candidates are dealt out in slices and queries in blocks of
bounded size. A task turns its slice into postings per term; every term of a query adds its weight times
the posting's weight to the query's dense score array. The k best of a slice are found by partition
selection, and slices are merged per query. Nothing is pruned, so the result is exact.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; rows
without an id take no part; of vectors of unlike length the missing components count as zero; an
empty vector scores 0 with all. Rows that repeat an id all are candidates, and each is a query of its
own if its id is one; rows with the query's own id are not its candidates. Scores are 64-bit integers
and must fit. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.common import prepare, read_table

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Rows of a slice of candidates and of a block of queries.
SLICE_ROWS, BLOCK_ROWS = 8192, 512


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nonzero weights of rows as (row, term, weight)."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    weights = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = weights != 0
    return row[held], term[held], weights[held]


def scores(queries: pa.ChunkedArray, candidates: pa.ChunkedArray) -> np.ndarray:
    """All inner products: for every term, query weights times postings are added to the arrays."""
    total = np.zeros((len(queries), len(candidates)), np.int64)
    q_row, q_term, q_weight = _matrix(queries)
    c_row, c_term, c_weight = _matrix(candidates)
    q_order, c_order = np.argsort(q_term, kind="stable"), np.argsort(c_term, kind="stable")
    for term in np.intersect1d(q_term, c_term).tolist():
        q = q_order[slice(*np.searchsorted(q_term[q_order], [term, term + 1]))]
        c = c_order[slice(*np.searchsorted(c_term[c_order], [term, term + 1]))]
        if len(c) == total.shape[1]:
            total[q_row[q]] += q_weight[q][:, None] * c_weight[c]
        else:
            total[np.ix_(q_row[q], c_row[c])] += q_weight[q][:, None] * c_weight[c]
    return total


def best_of(row: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, without sorting the rest."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        values = row[at]
        limit = np.partition(values, len(at) - k)[len(at) - k]
        at = at[values >= limit]
    return at[np.lexsort((ids[at], -row[at]))[:k]]


def search(
    df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K,
    scale: int = SCALE, slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`(query_id, rank, key, score)`: the k best candidates of every row for which `is_query` holds."""
    spark = df.sparkSession
    prepare(spark)
    weights = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), weights.alias("weights"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    slices, blocks = max(1, math.ceil(counts.n / slice_rows)), max(1, math.ceil(counts.q / block_rows))

    def dealt(frame: DataFrame, parts: int) -> Column:
        return F.pmod(F.xxhash64("id", "weights"), F.lit(parts)).cast("int")

    # Every block of queries meets every slice of candidates once.
    asked = rows.where("asks").select("id", "weights", dealt(rows, blocks).alias("block")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )
    held = rows.select("id", "weights", dealt(rows, slices).alias("slice")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if queries.num_rows and candidates.num_rows:
            q_ids, c_ids = (np.asarray(t.column("id").combine_chunks()) for t in (queries, candidates))
            for start in range(0, queries.num_rows, 128):
                part = queries.slice(start, 128)
                total = scores(part.column("weights"), candidates.column("weights"))
                for i, row in enumerate(total):
                    own = q_ids[start + i]
                    for at in best_of(row, c_ids, c_ids != own, k).tolist():
                        found.append((own, c_ids[at], row[at]))
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("q", "id", "score"), columns)})

    schema = "q bigint, id bigint, score bigint"
    partial = asked.groupBy("block", "slice").cogroup(held.groupBy("block", "slice")).applyInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return partial.withColumn("rank", place).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), "rank", F.col("id").alias(key), "score"
    )


def op5_topk(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


OP5_SQL = f"""
WITH v AS (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
long AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS t FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM long q JOIN long c USING (t)
  WHERE q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id GROUP BY ALL
),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

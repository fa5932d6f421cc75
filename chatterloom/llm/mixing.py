"""Mixing sources to target weights by Pareto order sampling of documents.

Sources get targets in words. Inside a source a document's expected copies are proportional to an
importance that grows slowly with its length, at most MAX_COPIES; all documents of a length class share
them, so the factor that meets the target is found from a few sums. The whole part of the expected
copies is certain. The fraction is an inclusion probability p: documents are ranked by random odds over
inclusion odds, u / (1 - u) * (1 - p) / p, and taken in that order until the source's words are filled,
to the nearest document. u is a hash of the key, so that reruns and retried tasks agree.

Where the order is cut is found by counting words per range of ranks, and again within the range that
holds the cut, so no source is ever sorted in one task.

Defined results: null and empty texts have size 0 and are never taken; null sources form one source;
rows that repeat a key are ranked alike and told apart by size only, and of equal ones as many are taken
as the order says; an empty table gives an empty one. Other columns are ignored by `plan_mix` and kept,
copy by copy, by `mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.common import area_for, fresh_name, read_table
from chatterloom.sources.staging import StagingArea

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"
#: Ranks are cut into so many ranges, and a range again, LEVELS times.
RANGES, LEVELS = 1024, 3
#: Importance of a document grows by this much each time its length doubles.
LENGTH_BONUS = 0.05


def word_count(text: str) -> Column:
    """Number of runs of anything but the white space 0x20 and 0x09 to 0x0D."""
    starts = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(starts, F.lit(0)).cast("bigint")


def uniform(key: str) -> Column:
    """A number strictly between 0 and 1 from the key, the same in every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, area: StagingArea) -> DataFrame:
    """`(source, source_size, weight, target)` from `(source, source_size)`.

    Sources are numbered in code-point order, null last, by ranges: a range is numbered on its own and
    shifted by the rows of the ranges before it. Targets beyond MAX_COPIES times the source give up the
    excess to the others by weight until none is above.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = area.stage(ranged, "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "shift", F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    order = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    numbered = ranged.join(F.broadcast(shifts.select("range", "shift")), "range").withColumn(
        "place", F.row_number().over(order) - 1 + F.col("shift")
    )
    weighed = area.stage(numbered.select("source", "source_size", weight.cast("double").alias("weight")), "weights")

    cap = F.col("source_size").cast("double") * MAX_COPIES
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, capped = math.inf, -1
    # Words per unit of weight: it only grows while more sources reach their cap.
    factor = 0.0
    while total:
        above = cap < F.lit(factor) * F.col("weight")
        row = weighed.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count_if(above),
        ).first()
        if row[2] == capped or not row[1]:
            break
        capped, share = row[2], (total - row[0]) / row[1]
        factor = share
    target = F.least(cap, F.lit(factor) * F.col("weight")) if total else F.lit(0.0)
    return weighed.withColumn("target", target)


def _expected(classes: DataFrame) -> DataFrame:
    """Adds `expected` copies to `(source, target, class, importance, words)` of length classes.

    copies = min(MAX_COPIES, factor * importance) with the words of all classes adding up to the target.
    Classes reach the maximum in order of importance; a source has a few dozen of them at most.
    """
    up = Window.partitionBy("source").orderBy(F.desc("importance"))
    full = F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_words = F.sum(F.col("words") * F.col("importance")).over(up.rowsBetween(0, Window.unboundedFollowing))
    tried = classes.withColumn("factor", (F.col("target") - MAX_COPIES * full) / open_words).withColumn(
        "fits", F.col("factor") * F.col("importance") <= MAX_COPIES * (1 + 1e-12)
    )
    # The first class that fits fixes the factor for itself and all of less importance.
    chosen = F.first(F.when(F.col("fits"), F.col("factor")), True).over(
        up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    copies = F.least(F.lit(float(MAX_COPIES)), F.coalesce(chosen, F.lit(float(MAX_COPIES))) * F.col("importance"))
    return tried.withColumn("expected", F.greatest(copies, F.lit(0.0)))


def _cut(docs: DataFrame, residual: DataFrame, area: StagingArea) -> DataFrame:
    """`docs` with `picked`: whether the order of ranks takes the document into its source's residual.

    `docs` has (source, size, position, key), position in [0, 1) in rank order; `residual` (source, words).
    """
    open_ = residual.select("source", F.col("words").alias("room"), F.lit(0.0).alias("low"), F.lit(1.0).alias("span"))
    for level in range(LEVELS):
        inside = docs.join(open_, docs["source"].eqNullSafe(open_["source"])).where(
            (F.col("position") >= F.col("low")) & (F.col("position") < F.col("low") + F.col("span"))
        ).select(docs["source"], "size", "room", "low", "span", F.floor((F.col("position") - F.col("low")) / F.col("span") * RANGES).alias("range"))
        sums = inside.groupBy("source", "range").agg(
            F.sum("size").alias("words"), F.first("room").alias("room"), F.first("low").alias("low"), F.first("span").alias("span")
        )
        so_far = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
        # The range that holds the cut: the first after which the words exceed the room.
        next_open = (
            sums.withColumn("after", so_far).where("after > room").groupBy("source")
            .agg(F.min_by(F.struct("range", "words", "after", "room", "low", "span"), "range").alias("r"))
            .select(
                "source", (F.col("r.room") - F.col("r.after") + F.col("r.words")).alias("room"),
                (F.col("r.low") + F.col("r.range") * F.col("r.span") / RANGES).alias("low"),
                (F.col("r.span") / RANGES).alias("span"),
            )
        )
        open_ = area.stage(next_open, f"cut-{level}")
    closed = open_.select(F.col("source").alias("s"), "room", "low", "span")
    placed = docs.join(closed, docs["source"].eqNullSafe(closed["s"]), "left")
    end = F.col("low") + F.col("span")
    at_cut = placed.where((F.col("position") >= F.col("low")) & (F.col("position") < end))
    # About one document in RANGES ** LEVELS is here; they are taken one by one, to the nearest.
    so_far = F.sum("size").over(Window.partitionBy("source", "low").orderBy("position", "key", "size").rowsBetween(Window.unboundedPreceding, 0))
    near = at_cut.withColumn("after", so_far).withColumn("picked", F.col("after") - F.col("size") / 2 <= F.col("room"))
    rest = placed.where(F.col("low").isNull() | (F.col("position") < F.col("low")) | (F.col("position") >= end))
    rest = rest.withColumn("picked", F.coalesce(F.col("position") < F.col("low"), F.lit(True)))
    return rest.unionByName(near.drop("after"))


def plan_mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", area: StagingArea | None = None
) -> DataFrame:
    """`(key, source, size, source_size, target, copies, taken)`: one row per row of `df`."""
    area = area_for(df, area)
    sized = area.stage(
        df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")), "sizes"
    )
    length = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double"))).cast("int")).otherwise(F.lit(-1))
    classed = sized.withColumn("class", length)
    sums = area.stage(classed.groupBy("source", "class").agg(F.sum("size").alias("words")), "classes")
    targets = area.stage(
        source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), area), "targets"
    )
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    importance = 1 + LENGTH_BONUS * F.col("class")
    joined = sums.where("words > 0").join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn("importance", importance)
    expected = area.stage(
        _expected(joined.select("source", "class", "words", "importance", "target")).select(
            "source", "class", "words", "target", F.floor("expected").cast("int").alias("certain"),
            (F.col("expected") - F.floor("expected")).alias("chance"),
        ), "expected",
    )
    residual = expected.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("words") * F.col("certain"))).alias("words")
    )
    e = expected.select(F.col("source").alias("es"), F.col("class").alias("ec"), "certain", "chance")
    u, p = uniform("key"), F.col("chance")
    odds = u / (1 - u) * (1 - p) / p
    ranked = classed.join(e, F.col("source").eqNullSafe(F.col("es")) & (F.col("class") == F.col("ec")), "left").select(
        "key", "source", "size", F.coalesce("certain", F.lit(0)).alias("certain"),
        # Odds map onto [0, 1) in their order.
        F.when(F.coalesce(p, F.lit(0.0)) > 1e-9, odds / (1 + odds)).alias("position"),
    )
    ranked = area.stage(ranked, "ranked")
    drawn = _cut(ranked.where("position IS NOT NULL"), residual, area).select("key", "source", "size", "certain", "picked")
    fixed = ranked.where("position IS NULL").select("key", "source", "size", "certain", F.lit(False).alias("picked"))
    copies = F.col("certain") + F.col("picked").cast("int")
    return drawn.unionByName(fixed).join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"),
    )


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `df` as often as the mix takes them, with all their columns."""
    name, times = fresh_name(df, "_key"), fresh_name(df, "_copies")
    plan = plan_mix(df, key, text, source).where("copies > 0").groupBy(F.col(key).alias(name)).agg(
        F.max("copies").alias(times)
    )
    taken = df.join(plan, df[key].eqNullSafe(plan[name]))
    copy = F.explode(F.sequence(F.lit(1), plan[times])).alias(fresh_name(df, "_copy"))
    return taken.select(*[df[c] for c in df.columns], copy).select(*df.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies")


_WEIGHT_LIST = "[" + ", ".join(f"CAST({w} AS DOUBLE)" for w in WEIGHTS) + "]"

OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    {_WEIGHT_LIST}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS weight
  FROM d GROUP BY source
),
water AS (
  SELECT *, {MAX_COPIES}.0::DOUBLE * source_size AS cap,
    ((SELECT sum(size) FROM d) - coalesce(sum({MAX_COPIES}.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor
  FROM src WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(factor, source_size / weight) FROM water WHERE factor * weight <= cap)) AS target
  FROM water
),
classes AS (
  SELECT source, CASE WHEN size > 0 THEN CAST(floor(log2(size)) AS INTEGER) ELSE -1 END AS class,
    sum(size) AS words, 1 + {LENGTH_BONUS}::DOUBLE * class AS importance
  FROM d GROUP BY ALL
),
tried AS (
  SELECT c.*, t.target,
    (t.target - {MAX_COPIES} * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(words * importance) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WHERE words > 0
  WINDOW o AS (PARTITION BY c.source ORDER BY importance DESC)
),
chosen AS (
  SELECT source, max_by(factor, importance) AS factor FROM tried
  WHERE factor * importance <= {MAX_COPIES} * (1 + 1e-12::DOUBLE) GROUP BY source
),
expected AS (
  SELECT t.source, t.class, t.words, t.target,
    greatest(0.0::DOUBLE, least({MAX_COPIES}.0::DOUBLE, coalesce(c.factor, {MAX_COPIES}.0::DOUBLE) * t.importance)) AS copies
  FROM tried t LEFT JOIN chosen c ON t.source IS NOT DISTINCT FROM c.source
),
residual AS (
  SELECT source, any_value(target) - sum(words * floor(copies)) AS room FROM expected GROUP BY source
),
ranked AS (
  SELECT d.row_id, d.doc_id, d.source, d.size, CAST(coalesce(floor(copies), 0) AS INTEGER) AS certain,
    coalesce(copies - floor(copies), 0) AS p,
    (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE AS u,
    CASE WHEN p > 1e-9::DOUBLE THEN u / (1 - u) * (1 - p) / p END AS odds, odds / (1 + odds) AS position
  FROM d LEFT JOIN expected e ON d.source IS NOT DISTINCT FROM e.source
    AND CASE WHEN d.size > 0 THEN CAST(floor(log2(d.size)) AS INTEGER) ELSE -1 END = e.class
),
drawn AS (
  SELECT row_id, sum(size) OVER (PARTITION BY k.source ORDER BY position, doc_id, size ROWS UNBOUNDED PRECEDING)
      - size / 2.0::DOUBLE <= room AS picked
  FROM ranked k JOIN residual r ON k.source IS NOT DISTINCT FROM r.source WHERE position IS NOT NULL
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST((certain + CASE WHEN picked THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
  CAST(certain + CASE WHEN picked THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM ranked k LEFT JOIN drawn USING (row_id) JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
"""

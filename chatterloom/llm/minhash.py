"""Near-duplicate documents: hash minima, bands, verification on full sets, components.

1. Every document gets the set of its word shingles, a digest of that set and HASHES minima under
   universal hash functions. Documents with equal sets form a class, represented by its least key.
2. The minima are cut into bands; representatives that agree on a band share a bucket.
3. In each bucket the member with most company is compared with all others: one pair per member.
   This joins most copies, whatever the size of their group.
4. Buckets whose members are still in several components are compared in full, in blocks of bounded
   size inside one task: first the signatures, then, for members that come close to another component,
   exact set sizes by matrix products. Only links that join different components leave a block, so no
   pairs within a group are listed.

Links are confirmed on the full sets in both steps. With BANDS bands of ROWS minima a pair at the
threshold shares no bucket with a chance of (1 - t ** ROWS) ** BANDS: 1e-7 at 0.80, 6e-11 at 0.85.

Defined results: texts that are null, empty or without words have no shingles and link with nothing;
texts with fewer words than a shingle count as one shingle; rows that repeat a key form one document,
and if their texts differ the least of their sets stands for it; rows without key come back as their own group
with a null component. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import (
    WINDOW_MULTIPLIERS, area_for, as_bytes, bitmap_of, fresh_name, perhaps_in, read_table, rows_of, prepare, window_hashes, word_hashes, words,
)
from chatterloom.llm.components import components
from chatterloom.sources.staging import StagingArea

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Members and shingles that a block of a bucket holds, about.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 20
#: How far below the threshold the share of equal minima may lie, in standard deviations.
SLACK = 5.0
#: Columns of one matrix product.
_COLUMNS = 8192

_random = np.random.default_rng(20_240_501)
#: Multiply-shift hashing: odd multipliers and summands modulo 2 ** 64, of which the high half counts.
_MULTIPLIERS = _random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_SUMMANDS = _random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text, letters A to Z in lower case."""
    tokens = words(text.lower()) if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(tokens)
    if len(hashes) < width:
        return window_hashes(hashes, len(hashes)) + np.uint64(len(hashes))
    return np.unique(window_hashes(hashes, width))


def minima(values: np.ndarray) -> np.ndarray:
    """The minimum of the set under each hash function, folded to 16 bits."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(values), 2048):
        hashed = _MULTIPLIERS[:, None] * values[None, start:start + 2048] + _SUMMANDS[:, None]
        np.minimum(least, hashed.min(1) >> np.uint64(32), out=least)
    # Minima of long texts are all small, so they are mixed before they are cut.
    return (least * np.uint64(WINDOW_MULTIPLIERS[0]) >> np.uint64(48)).astype(np.uint16)


def signatures(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """`(key, n, digest, minima)` per row."""
    prepare(df.sparkSession)
    narrow = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sizes, digests, signs = [], [], []
            for value in as_bytes(batch.column(1)):
                found = shingles(value, width)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(minima(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
                names=["key", "n", "digest", "minima"],
            )

    return narrow.mapInArrow(run, "key bigint, n bigint, digest binary, minima binary")


def shingle_sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """`(key, shingles array<bigint>)`, sorted, per row."""
    narrow = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [shingles(value, width).view(np.int64) for value in as_bytes(batch.column(1))]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "shingles"])

    return narrow.mapInArrow(run, "key bigint, shingles array<bigint>")


def _buckets(classes: DataFrame, area: StagingArea) -> DataFrame:
    """`(bucket, rep, n)` for buckets of several members, of equal ones only one."""
    bands = classes.select(
        "rep", "n", F.posexplode(F.expr(
            f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(minima, b * {2 * ROWS} + 1, {2 * ROWS})))"
        )).alias("band", "bucket"),
    ).select("bucket", "rep", "n")
    chosen = area.stage(_unlike(bands), "chosen")
    few = perhaps_in(bands, bitmap_of(chosen, "bucket"), "bucket")
    return few.join(chosen, "bucket").select("bucket", "members", "rep", "n")


def _unlike(members: DataFrame) -> DataFrame:
    """`(bucket, members)` of buckets (bucket, rep) with several members, of buckets alike only one."""
    several = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.expr("bit_xor(xxhash64(rep))").alias("a"),
        F.expr("bit_xor(xxhash64(rep, 1))").alias("b"),
    ).where("members > 1")
    return several.groupBy("members", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "members")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that reach the similarity on their full sets."""
    def named(name: str) -> DataFrame:
        return sets.select(F.col("key").alias(name), F.col("shingles").alias(f"{name}_set"))

    shared = F.size(F.array_intersect("u_set", "v_set"))
    union = F.size("u_set") + F.size("v_set") - shared
    return pairs.join(named("v"), "v").join(named("u"), "u").where(100 * shared >= percent * union).select("u", "v")


def _share(signs: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The number of equal minima of every row of one with every row of the other."""
    equal = np.zeros((len(signs), len(others)), np.uint16)
    for column in range(signs.shape[1]):
        equal += signs[:, column, None] == others[None, :, column]
    return equal


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of every set on the left with every set on the right."""
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(values), _COLUMNS):
        part = values[start:start + _COLUMNS]

        def presence(sets: list[np.ndarray]) -> np.ndarray:
            matrix = np.zeros((len(sets), len(part)), np.float32)
            for row, held in enumerate(sets):
                held = held[np.searchsorted(held, part[0]):np.searchsorted(held, part[-1], "right")]
                at = np.searchsorted(part, held)
                matrix[row, at[part[np.minimum(at, len(part) - 1)] == held]] = 1
            return matrix

        total += presence(left) @ presence(right).T
    return total


def _block_links(
    rows: list[tuple[int, int, np.ndarray, int, np.ndarray]], others: list, percent: int
) -> list[tuple[int, int]]:
    """Links `(rep, rep)` between the rows `(rep, component, minima, n, set)` of one and other side that
    join components; as many as it takes, none twice."""
    likely = _likely(rows, others, percent)
    up, down = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
    if not len(up):
        return []
    shared = _intersections([rows[i][4] for i in up], [others[i][4] for i in down])
    union = np.array([rows[i][3] for i in up])[:, None] + np.array([others[i][3] for i in down]) - shared
    linked = (100 * shared >= percent * union) & likely[np.ix_(up, down)]
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while (above := parent.get(node, node)) != node:
            parent[node] = node = parent.get(above, above)
        return node

    links = []
    for a, b in np.argwhere(linked).tolist():
        one, other = rows[up[a]], others[down[b]]
        x, y = root(one[1]), root(other[1])
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((one[0], other[0]))
    return links


def _blocks(members: DataFrame) -> DataFrame:
    """Deals the members of every bucket into blocks of bounded size, pairs of blocks into groups.

    Members of the bucket's largest component need no comparison with each other. So the other members, few as
    a rule, have blocks of their own, which meet all blocks, while a block of the largest component meets
    theirs only: its members are copied as often as there are blocks of others, which is once as a rule.

    Adds (low, high), the blocks of the group, `first`, whether the row is of block `low`, and `alone`,
    whether the group is one block compared with itself.
    """
    def blocks(count: Column, shingles_: Column) -> Column:
        return F.ceil(F.greatest(count / BLOCK_MEMBERS, shingles_ / BLOCK_SHINGLES)).cast("int")

    comps = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    largest = F.max(F.struct("s", "c", "comp")).alias("largest")
    sized = comps.groupBy("bucket").agg(largest, F.sum("c").alias("c"), F.sum("s").alias("s")).select(
        "bucket", F.col("largest.comp").alias("main"),
        blocks(F.col("c") - F.col("largest.c"), F.col("s") - F.col("largest.s")).alias("others"),
        blocks(F.col("largest.c"), F.col("largest.s")).alias("mains"),
    )
    in_main = F.col("comp") == F.col("main")
    place = F.xxhash64("rep")
    own = F.when(in_main, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others")))
    meets = F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    return (
        members.join(sized.where("others > 0"), "bucket")
        .withColumn("block", own.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
        .select(
            "bucket", "rep", "n", "comp", (F.col("block") <= F.col("other")).alias("first"),
            (F.col("block") == F.col("other")).alias("alone"),
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
    )


def _sides(table: pa.Table, rows: list) -> tuple[list, list]:
    flags = list(zip(rows, table.column("first").to_pylist(), table.column("alone").to_pylist()))
    return [row for row, first, _ in flags if first], [row for row, first, alone in flags if alone or not first]


def _likely(rows: list, others: list, percent: int) -> np.ndarray:
    """Which pairs of (rep, component, minima, n, ...) may link components, by signatures and sizes."""
    share = _share(np.stack([row[2] for row in rows]), np.stack([row[2] for row in others]))
    wanted = percent / 100
    least = HASHES * wanted - SLACK * (HASHES * wanted * (1 - wanted)) ** 0.5
    sizes, others_sizes = np.array([row[3] for row in rows]), np.array([row[3] for row in others])
    long, short = np.maximum(sizes[:, None], others_sizes), np.minimum(sizes[:, None], others_sizes)
    comps, others_comps = np.array([row[1] for row in rows]), np.array([row[1] for row in others])
    return (share >= least) & (100 * short >= percent * long) & (comps[:, None] != others_comps)


def _promising(members: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Members (bucket, rep) that some signature of another component in their bucket comes close to."""
    def run(table: pa.Table) -> pa.Table:
        minima_ = [np.frombuffer(value, np.uint16) for value in table.column("minima").to_pylist()]
        rows = list(zip(*(table.column(name).to_pylist() for name in ("rep", "comp")), minima_, table.column("n").to_pylist()))
        one, other = _sides(table, rows)
        likely = _likely(one, other, percent) if one and other else np.zeros((0, 0), bool)
        found = {one[i][0] for i in np.flatnonzero(likely.any(1))} | {other[i][0] for i in np.flatnonzero(likely.any(0))}
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([bucket] * len(found), pa.int64()), "rep": pa.array(sorted(found), pa.int64())})

    dealt = _blocks(members).join(signs, "rep")
    return dealt.groupBy("bucket", "low", "high").applyInArrow(run, "bucket bigint, rep bigint").distinct()


def _residual_links(members: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside buckets, found block against block on the full sets."""
    dealt = _blocks(members).join(signs, "rep").join(sets.select(F.col("key").alias("rep"), "shingles"), "rep")

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(name).to_pylist() for name in ("rep", "comp", "minima")]
        held = table.column("shingles").combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        rows = []
        for i, (rep, comp, minima_) in enumerate(zip(*columns)):
            found = held.slice(i, 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rows.append((rep, comp, np.frombuffer(minima_, np.uint16), len(found), found))
        one, other = _sides(table, rows)
        links = _block_links(one, other, percent) if one and other else []
        return pa.table({
            "u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64()),
        })

    return dealt.groupBy("bucket", "low", "high").applyInArrow(run, "u bigint, v bigint")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
    area: StagingArea | None = None,
) -> DataFrame:
    """`(key, n_shingles, class_id, component_id, kept)`: one row per row of `df`.

    `class_id` is the least key with the same set, `component_id` the least key that links reach,
    `kept` whether the row's key is that one. Keys are integers.
    """
    area = area_for(df, area)
    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    base = area.stage(signatures(source, "key", "text", width), "signatures")
    classes = area.stage(
        base.where("n > 0 AND key IS NOT NULL").groupBy("digest").agg(
            F.min("key").alias("rep"), F.min("n").alias("n"), F.min("minima").alias("minima")
        ), "classes",
    )
    members = area.stage(_buckets(classes, area), "buckets")
    signs = classes.select("rep", "minima")

    # Texts are read again for the few documents that share a bucket, rather than kept as sets for all.
    wanted = members.select(F.col("rep").alias("key")).distinct()
    texts = perhaps_in(source, bitmap_of(wanted, "key"), "key").join(wanted, "key")
    candidates = shingle_sets(texts, "key", "text", width)
    sets = area.stage(candidates.groupBy("key").agg(F.min("shingles").alias("shingles")), "sets")

    company = members.groupBy("rep").agg(F.sum("members").alias("company"))
    known = members.join(company, "rep")
    pivots = known.groupBy("bucket").agg(
        F.max_by(F.struct("rep", "n"), F.struct("company", -F.col("rep"))).alias("pivot")
    )
    close = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")
    pairs = (
        members.join(pivots, "bucket").where(close & (F.col("rep") != F.col("pivot.rep")))
        .select(F.col("pivot.rep").alias("u"), F.col("rep").alias("v")).distinct()
    )
    links = area.stage(_confirmed(pairs, sets, percent), "links")
    joined = area.stage(components(links, area, "star"), "joined")

    labelled = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", "n", F.coalesce("component", "rep").alias("comp")
    )
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bucket")
    residual = area.stage(labelled.join(mixed, "bucket", "left_semi"), "residual")
    promising = area.stage(_promising(residual, signs, percent), "promising")
    narrowed = promising.join(_unlike(promising).select("bucket"), "bucket")
    more = area.stage(_residual_links(residual.join(narrowed, ["bucket", "rep"]), signs, sets, percent), "more")
    whole = joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)
    final = components(whole, area, "whole")

    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")
    )
    found = base.select("key", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return found.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), F.coalesce("class_id", "key")).alias("class_id"),
        component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"),
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` with one document of each group of near-duplicates: the one with the least key.

    Of rows that repeat a kept key one stays.
    """
    name = fresh_name(df, "_dropped")
    dropped = near_duplicates(df.select(key, text), key, text, width, percent).where(~F.col("kept")).select(
        F.col(key).cast("bigint").alias(name)
    )
    keyed = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    stay = keyed.join(dropped.distinct(), F.col(key) == F.col(name), "left_anti")
    return stay.unionByName(df.where(F.col(key).isNull()))


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM d
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
e AS (
  SELECT a, b, c = x.n AND c = y.n AS same FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
  WHERE 100 * c >= 85 * (x.n + y.n - c)
),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(r.least, doc_id)) AS component_id,
  least(doc_id, coalesce(r.least, doc_id)) = doc_id AS kept, least(doc_id, coalesce(s.least, doc_id)) AS class_id
FROM d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) r USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM e WHERE same GROUP BY a) s USING (doc_id)
"""

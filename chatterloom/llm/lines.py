"""Line dedup by a log-template tree.

A line is cut into tokens, and tokens with a digit become a wildcard. The tree has a fixed depth: a leaf
is the number of tokens and the first LEADING tokens. Inside a leaf the different lines that have a token at a position are
counted, and in every line the tokens that are rare at their position become wildcards too, wherever they stand. This is
done twice, as a token may be called rare if only one line has it, or if no more than half of the leaf's lines do; lines that
are then the same form a template. It counts if enough of its tokens are constant. A template, or a line as it stands, that
recurs in enough documents is repeated text: the first document that has it keeps its first line of it, all other lines of it
are dropped. Lines with digits that agree but for these are held to what a template is; those with the same digits are not.

Every step is a grouped sum, minimum or maximum over hashes, combined before the shuffle, so a template
that is in a third of all lines is no burden to any task. Lines themselves are never shuffled.

Defined results: a null or empty text has no lines with tokens and stays as it is; lines without tokens
are never dropped; repeated rows are documents of their own if their keys differ, and one document if they
do not, whose lines do not count as recurring across documents; rows without a key are left alone. An
empty table gives an empty one. Other columns are ignored by `line_ledger` and kept by `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import (
    area_for, as_bytes, bitmap_of, fresh_name, join_staged, marked_by, perhaps_in, prepare, read_table, rows_of,
)
from chatterloom.sources.staging import StagingArea

#: Leading tokens that select a leaf, besides the number of tokens.
LEADING = 3
#: Documents a repeated line must be in; short lines, which recur by chance, must be in more.
MIN_DOCS, SHORT_TOKENS, SHORT_MIN_DOCS = 2, 8, 10
#: Documents, constant tokens and share of constant tokens of a template with fields found by comparison.
MIN_TEMPLATE_DOCS, MIN_CONSTANT, MIN_CONSTANT_SHARE = 3, 8, 0.6
WILDCARD = "<*>"
#: Odd multipliers of the hashes of a line (fixed values).
_PLACE, _MIX, _CHECK, _SIZE, _LEAF = (
    np.uint64(value) for value in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
)


def _mixed(values: np.ndarray, factor: np.uint64 = _MIX) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * factor
    return values ^ (values >> np.uint64(29))


#: Bytes of tokens that are hashed at once, so that steps in between stay in a core's cache.
HASHED_BYTES = 1 << 17
#: White space that parts tokens.
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


def _multipliers(seed: np.uint64, count: int) -> np.ndarray:
    """An odd multiplier for each place in a token (fixed values)."""
    with np.errstate(over="ignore"):
        return _mixed(_mixed(np.arange(1, count + 1, dtype=np.uint64) * seed), _CHECK) | np.uint64(1)


_SHORT = 256
_FACTORS = [_multipliers(seed, _SHORT) for seed in (_PLACE, _LEAF)]


def _token_hashes(held: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of tokens whose bytes lie end to end: two weighted sums of the bytes, mixed into one number."""
    found = np.empty(len(lengths), np.uint64)
    ends = np.cumsum(lengths)
    first = begin = 0
    while first < len(lengths):
        # As many tokens as fit, one at least.
        last = max(first + 1, int(np.searchsorted(ends, begin + HASHED_BYTES, "right")))
        sizes = lengths[first:last]
        end = int(ends[last - 1])
        starts = ends[first:last] - sizes - begin
        at = np.arange(end - begin) - np.repeat(starts, sizes)
        values = held[begin:end].astype(np.uint64) + np.uint64(1)
        longest = int(sizes.max())
        factors = _FACTORS if longest <= _SHORT else [_multipliers(seed, longest) for seed in (_PLACE, _LEAF)]
        one, two = (np.add.reduceat(values * factor[at], starts) for factor in factors)
        found[first:last] = _mixed(_mixed(one) + _mixed(two, _CHECK), _SIZE)
        first, begin = last, end
    return found


def _hash_of(token: bytes) -> np.uint64:
    return _token_hashes(np.frombuffer(token, np.uint8), np.array([len(token)]))[0]


_FIELD_HASH = _hash_of(WILDCARD.encode())


class Lines:
    """The lines with tokens of several texts: hashes in place of tokens.

    `place` is the text of a line, `number` its number there, `size` its tokens, `constant` those that are
    no wildcard, `line` and `check` hash all tokens, `raw` does so for lines with digits as they stand and is
    null for others, `leaf` the number of tokens and the first of them, `tokens` the hash of each token. Fields become wildcards before anything is hashed.
    """

    def __init__(self, texts: list[bytes | None]):
        # All texts as one, a line end between them; tokens are found and hashed without leaving the array.
        texts = [text or b"" for text in texts]
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        inside = ~_SPACE[data]
        turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begins, ends = turns[::2], turns[1::2]
        line_ends = np.flatnonzero(data == 0x0A)
        line_of = np.searchsorted(line_ends, begins)
        self.starts = np.flatnonzero(np.diff(line_of, prepend=-1))
        self.size = np.diff(self.starts, append=len(begins))
        text_starts = np.cumsum([0] + [len(text) + 1 for text in texts])[:-1]
        self.place = np.searchsorted(text_starts, begins[self.starts], "right") - 1
        self.number = line_of[self.starts] - np.searchsorted(line_ends, text_starts)[self.place]
        held, lengths = data[inside], ends - begins
        self.tokens = _token_hashes(held, lengths)
        if not len(self.size):
            self.raw = pa.array([], pa.int64())
            self.constant = self.size
            self.line = self.check = self.leaf = self.tokens
            return
        at = np.arange(len(begins)) - np.repeat(self.starts, self.size)
        sizes = _mixed(self.size.astype(np.uint64) * _SIZE)
        # uint8 wraps below "0", so one comparison tells digits.
        field = np.logical_or.reduceat(held - np.uint8(0x30) < 10, np.cumsum(lengths) - lengths)

        def placed() -> np.ndarray:
            return self.tokens + (at + 1).astype(np.uint64) * _PLACE

        def summed(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, self.starts)

        plain = ~np.logical_or.reduceat(field, self.starts)
        self.raw = pa.array((summed(_mixed(placed(), _LEAF)) + sizes).view(np.int64), mask=plain)
        self.tokens[field] = _FIELD_HASH
        mixed = _mixed(placed())
        zero = np.uint64(0)
        self.leaf = _mixed(summed(np.where(at < LEADING, mixed, zero)) + sizes * _LEAF)
        self.constant = summed((self.tokens != _FIELD_HASH).astype(np.int64))
        self.line, self.check = _mixed(summed(mixed) + sizes), _mixed(summed(_mixed(placed(), _CHECK)) + sizes)


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def _placed(keyed: DataFrame) -> DataFrame:
    """One narrow row of hashes per line that has tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = Lines(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(found.place)), pa.array(found.number, pa.int32()),
                    pa.array(found.size, pa.int32()), pa.array(found.constant, pa.int32()),
                    pa.array(found.line.view(np.int64)), pa.array(found.check.view(np.int64)),
                    pa.array(found.leaf.view(np.int64)), found.raw,
                ],
                names=["key", "line_no", "size", "constant", "line", "check", "leaf", "raw"],
            )

    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.mapInArrow(
        run, f"key {kind}, line_no int, size int, constant int, line bigint, check bigint, leaf bigint, raw bigint"
    )


def _tokens(keyed: DataFrame) -> DataFrame:
    """`(line, check, tokens)` of every line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = Lines(as_bytes(batch.column(1)))
            offsets = np.append(found.starts, len(found.tokens)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.line.view(np.int64)), pa.array(found.check.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.tokens.view(np.int64))),
                ],
                names=["line", "check", "tokens"],
            )

    return keyed.mapInArrow(run, "line bigint, check bigint, tokens array<bigint>")


def _first(key: str = "key") -> Column:
    return F.min(F.struct(F.col(key).alias("key"), "line_no"))


def line_ledger(
    df: DataFrame, key: str = "doc_id", text: str = "text", area: StagingArea | None = None
) -> DataFrame:
    """`(key, line_no)` of the lines to drop, counted from 0."""
    area = area_for(df, area)
    prepare(df.sparkSession)
    keyed = _keyed(df, key, text)
    # What a template needs of the tokens is read again, for the few lines that may form one.
    placed = area.stage(_placed(keyed), "lines")

    # Lines as they stand: partial counts leave a row per line and task at most.
    per_line = area.stage(
        placed.groupBy("line", "check").agg(
            F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"), _first().alias("first"),
            F.first("size").alias("size"), F.first("constant").alias("constant"), F.first("leaf").alias("leaf"),
        ), "distinct",
    )
    # A line in a single document does not recur; only the others have their documents counted.
    recurring = area.stage(per_line.where("low <> high").select("line", "check"), "recurring")
    docs = join_staged(placed, recurring, ["line", "check"]).select("line", "check", "key").distinct()
    counts = docs.groupBy("line", "check").agg(F.count(F.lit(1)).alias("docs"))
    enough = F.when(F.col("size") < SHORT_TOKENS, SHORT_MIN_DOCS).otherwise(MIN_DOCS)
    least = F.greatest(F.lit(MIN_CONSTANT), MIN_CONSTANT_SHARE * F.col("size"))
    told = F.when(F.col("constant") == F.col("size"), F.col("docs") >= enough).otherwise(
        (F.col("docs") >= MIN_TEMPLATE_DOCS) & (F.col("constant") >= least)
    )
    first = (F.col("first.key").alias("first_key"), F.col("first.line_no").alias("first_no"))
    repeated = per_line.join(counts, ["line", "check"]).where(told).select("line", "check", *first)
    # Of lines with digits, those that are the same with them; only what recurs without them can.
    digits = placed.where("raw IS NOT NULL AND constant > 0").select("line", "check", "raw", "key", "line_no", "size")
    same = ["line", "check", "raw"]
    per_raw = join_staged(digits, recurring, ["line", "check"]).groupBy(*same).agg(
        F.min("key").alias("low"), F.max("key").alias("high"), _first().alias("first"), F.first("size").alias("size")
    ).where("low <> high")
    per_raw = area.stage(per_raw, "digits")
    raw_docs = join_staged(digits, per_raw.select(*same), same).select(*same, "key").distinct()
    raw_counts = raw_docs.groupBy(*same).agg(F.count(F.lit(1)).alias("docs"))
    repeated_raw = area.stage(per_raw.join(raw_counts, same).where(F.col("docs") >= enough).select(*same, *first), "raw-rules")

    # Lines that may form a template: in a leaf with several, in several documents, and with enough constant tokens
    # to be members; a template needs as many lines as documents.
    able = per_line.where(F.col("constant") >= least).select("leaf", "line", "check", "low", "high", "n", "size")
    leaves = able.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    ).where(f"members > 1 AND low <> high AND n >= {MIN_TEMPLATE_DOCS}").select("leaf", "members")
    wanted = area.stage(able.drop("n", "high").join(leaves, "leaf"), "able")
    # The tokens come from one document of each line; bitmaps keep other texts and lines from being shuffled.
    texts = perhaps_in(keyed, bitmap_of(wanted, "low"), "key")
    few = perhaps_in(_tokens(texts), bitmap_of(wanted, "line"), "line")
    tokens = few.join(wanted.select("line", "check"), ["line", "check"]).dropDuplicates(["line", "check"])
    cells = area.stage(
        wanted.drop("low").join(tokens, ["line", "check"]).select("leaf", "members", "size", "line", "check", F.posexplode("tokens").alias("at", "token"))
        .where(F.col("token") != int(_FIELD_HASH.view(np.int64))), "cells",
    )
    held = cells.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    common = cells.join(held, ["leaf", "at", "token"]).withColumn("most", 2 * F.col("lines") > F.col("members"))
    # What is left of a line, as two sums of hashes that do not depend on the order of its tokens.
    kinds = {"any": F.lit(True), "most": F.col("most")}
    sums = {}
    for kind, kept in kinds.items():
        sums[f"{kind}_n"] = F.count_if(kept)
        for seed in (1, 2):
            sums[f"{kind}_{seed}"] = F.bit_xor(F.when(kept, F.xxhash64("at", "token", F.lit(seed))))
    masked = common.groupBy("leaf", "size", "line", "check").agg(*[column.alias(name) for name, column in sums.items()])
    forms = F.array(*[
        F.struct(F.col(f"{kind}_n").alias("n"), F.xxhash64("leaf", f"{kind}_1").alias("a"), F.xxhash64("leaf", f"{kind}_2").alias("b"))
        for kind in kinds
    ])
    valid = masked.select("line", "check", "size", F.explode(forms).alias("form")).where(
        F.col("form.n") >= F.greatest(F.lit(MIN_CONSTANT), MIN_CONSTANT_SHARE * F.col("size"))
    ).select("line", "check", F.col("form.a").alias("a"), F.col("form.b").alias("b")).distinct()
    valid = area.stage(valid, "valid")
    # Documents per template, from the lines of its members.
    template = ["a", "b"]
    of_template = join_staged(placed.select("line", "check", "key", "line_no"), valid, ["line", "check"])
    template_docs = of_template.select(*template, "key").distinct().groupBy(*template).agg(F.count(F.lit(1)).alias("docs"))
    firsts = of_template.groupBy(*template).agg(_first().alias("first"))
    templates = template_docs.where(F.col("docs") >= MIN_TEMPLATE_DOCS).join(firsts, template).select(
        *template, F.col("first.key").alias("first_key"), F.col("first.line_no").alias("first_no")
    )
    by_template = valid.join(templates, template).select("line", "check", "first_key", "first_no")

    # A line is dropped if it is not the first of some template it belongs to.
    rules = area.stage(repeated.unionByName(by_template).distinct(), "rules")
    hit = join_staged(placed.select("line", "check", "key", "line_no"), rules, ["line", "check"]).unionByName(
        join_staged(digits.select(*same, "key", "line_no"), repeated_raw, same).drop("raw")
    )
    later = ~((F.col("key") == F.col("first_key")) & (F.col("line_no") == F.col("first_no")))
    return hit.where(later).select(F.col("key").alias(key), "line_no").distinct()


def _without(text: str, dropped: list[int]) -> str:
    gone = set(dropped)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def cleaned(
    df: DataFrame, key: str = "doc_id", text: str = "text", dropped: str = "dropped", area: StagingArea | None = None
) -> DataFrame:
    """The rows of `df` with `text` freed of repeated lines, and the numbers of these lines or null."""
    area = area_for(df, area)
    prepare(df.sparkSession)
    drops = line_ledger(df, key, text, area).groupBy(F.col(key).alias(fresh_name(df, "_key"))).agg(
        F.sort_array(F.collect_list("line_no")).alias(dropped)
    )
    drops = area.stage(drops, "drops")
    # Rows that surely lose nothing stay where they are.
    mark = fresh_name(df, "_touched")
    marked = marked_by(df, bitmap_of(drops, drops.columns[0]), mark, key)
    name = drops.columns[0]
    touched = join_staged(marked.where(mark).withColumn(name, F.col(key)), drops, [name], "left").select(*df.columns, dropped)
    others = marked.where(~F.col(mark)).select(*df.columns).withColumn(dropped, F.lit(None).cast("array<int>"))
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            columns, gone = list(batch.columns), batch.column(batch.num_columns - 1)
            if gone.null_count < batch.num_rows:
                texts = [
                    value if numbers is None or value is None else _without(value, numbers)
                    for value, numbers in zip(columns[place].to_pylist(), gone.to_pylist())
                ]
                columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return touched.mapInArrow(run, touched.schema).unionByName(others)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` with cleaned texts; rows of which nothing but white space is left are gone."""
    dropped = fresh_name(df, "_dropped")
    found = cleaned(df, key, text, dropped)
    emptied = F.col(dropped).isNotNull() & ~F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return found.where(~emptied).select(*df.columns)


def op1_lines(spark, sf_dir: str) -> DataFrame:
    found = cleaned(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("dropped", lambda i: i.cast("string")), ","), F.lit("")).alias("dropped_lines"),
        "text",
    )


_TOKENS_SQL = (
    rf"[CASE WHEN regexp_matches(t, '[0-9]') THEN '{WILDCARD}' ELSE t END "
    r"FOR t IN regexp_extract_all(raw, '[^\x20\x09-\x0D]+')]"
)

_LEAST_SQL = f"greatest({MIN_CONSTANT}, {MIN_CONSTANT_SHARE} * size)"
_ENOUGH_SQL = f"CASE WHEN any_value(size) < {SHORT_TOKENS} THEN {SHORT_MIN_DOCS} ELSE {MIN_DOCS} END"

OP1_SQL = f"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
),
cut AS (SELECT doc_id, line_no, array_to_string(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+'), ' ') AS same, {_TOKENS_SQL} AS t FROM raw),
l AS (
  SELECT doc_id, line_no, same, t, len(t) AS size, array_to_string(t, ' ') AS line,
    len([x FOR x IN t IF x <> '{WILDCARD}']) AS constant, concat_ws('|', len(t), array_to_string(t[1:{LEADING}], ' ')) AS leaf,
    doc_id * 10000000 + line_no AS place
  FROM cut WHERE len(t) > 0
),
repeated AS (
  SELECT line, min(place) AS first FROM l WHERE constant > 0 GROUP BY line
  HAVING CASE WHEN any_value(constant) = any_value(size) THEN count(DISTINCT doc_id) >= {_ENOUGH_SQL}
    ELSE count(DISTINCT doc_id) >= {MIN_TEMPLATE_DOCS} AND any_value(constant) >= any_value({_LEAST_SQL}) END
),
same AS (
  SELECT same, min(place) AS first FROM l WHERE constant > 0 AND constant < size GROUP BY same
  HAVING count(DISTINCT doc_id) >= {_ENOUGH_SQL}
),
able AS (
  SELECT line, any_value(leaf) AS leaf, any_value(t) AS t, any_value(size) AS size, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high
  FROM l WHERE constant >= {_LEAST_SQL} GROUP BY line
),
leaves AS (
  SELECT leaf, count(*) AS members FROM able GROUP BY leaf
  HAVING count(*) > 1 AND min(low) <> max(high) AND sum(n) >= {MIN_TEMPLATE_DOCS}
),
cells AS (
  SELECT * FROM (
    SELECT leaf, members, line, size, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM able JOIN leaves USING (leaf)
  ) WHERE token <> '{WILDCARD}'
),
common AS (
  SELECT *, count(*) OVER (PARTITION BY leaf, pos, token) AS lines FROM cells
),
forms AS (
  SELECT line, leaf || ':' || string_agg(pos || '=' || token, ' ' ORDER BY pos) AS form FROM common WHERE lines > 1
  GROUP BY leaf, line, size HAVING count(*) >= {_LEAST_SQL}
  UNION
  SELECT line, leaf || ':' || string_agg(pos || '=' || token, ' ' ORDER BY pos) AS form FROM common WHERE lines > 1 AND 2 * lines > members
  GROUP BY leaf, line, size HAVING count(*) >= {_LEAST_SQL}
),
templates AS (
  SELECT form, min(place) AS first FROM l JOIN forms USING (line) GROUP BY form HAVING count(DISTINCT doc_id) >= {MIN_TEMPLATE_DOCS}
),
gone AS (
  SELECT doc_id, line_no FROM l JOIN repeated USING (line) WHERE place <> first
  UNION
  SELECT doc_id, line_no FROM l JOIN same USING (same) WHERE place <> first
  UNION
  SELECT doc_id, line_no FROM l JOIN forms USING (line) JOIN templates USING (form) WHERE place <> first
),
told AS (
  SELECT doc_id, count(gone.line_no) AS n, string_agg(CAST(gone.line_no AS VARCHAR), ',' ORDER BY gone.line_no) AS numbers,
    string_agg(CASE WHEN gone.line_no IS NULL THEN raw END, chr(10) ORDER BY raw.line_no) AS kept
  FROM raw LEFT JOIN gone USING (doc_id, line_no) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_dropped, coalesce(numbers, '') AS dropped_lines,
  CASE WHEN n > 0 THEN coalesce(kept, '') ELSE d.text END AS text
FROM documents d LEFT JOIN told ON d.doc_id = told.doc_id
"""

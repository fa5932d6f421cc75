"""Quotation linking: find what messages quote, and order conversations by reply, without the quotes.

Messages are cut into passages: runs of lines of one quote level (the number of leading ">" marks), ended
by lines without text; single lines and the whole unquoted text count as passages too. Quoted passages are
compared with the unquoted passages of earlier messages by a digest of their letters and digits. A message replies to
the message that the passage of least depth quotes, within its conversation if it can be found there and
in any other else; without such a quote it goes on from the message before it.

Messages come out as rows with a position rather than one row per conversation, so a conversation of any
length is spread over tasks. A thread is a message that quotes nothing known, with all that reply to it
by quotes, directly or not; threads are ordered by their first turn and messages in a thread by turn.
Replies are therefore behind what they reply to.

Only DataFrame functions are used. Defined results: a null or empty text is an empty message; messages of
one turn are ordered by role and text; rows that repeat a message are messages of their own with links
alike; rows without conversation or turn are left out, since they have no place; an empty table gives an
empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.common import area_for, read_table
from chatterloom.operators.joins import lookup_join
from chatterloom.sources.staging import StagingArea

#: Passages of fewer letters and digits say too little to be linked to another conversation.
MIN_PASSAGE = 12
#: Rounds after which a chain of quotes has surely been followed: each doubles its length.
MAX_DOUBLINGS = 40
#: Chat format of a message (fixed values).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: Lines that introduce a quote, such as "On Monday, Ann wrote:".
_LEAD_IN = r"(?i)^\s*(?:on\b.{0,200}\bwrote|le\b.{0,200}\bécrit|am\b.{0,200}\bschrieb.{0,100}|el\b.{0,200}\bescribió)\s*:\s*$"


def _levels(lines: Column) -> Column:
    """Quote level and content of every line."""
    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        body = F.substr(line, F.length(marks) + 1)
        return F.struct(level.alias("level"), body.alias("body"), (F.trim(body) == "").alias("blank"))

    return F.transform(lines, parsed)


def normalised(passage: Column) -> Column:
    """Letters and digits of a passage in lower case."""
    return F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", "")


def _run_starts(parsed: str) -> Column:
    """Where the runs of lines of one level start, in an array column of lines."""
    lines = F.col(parsed)

    def starts(line: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        return ~line["blank"] & ((i == 0) | before["blank"] | (before["level"] != line["level"]))

    marked = F.transform(lines, lambda line, i: F.struct(starts(line, i).alias("starts"), i.alias("at")))
    return F.transform(F.filter(marked, lambda mark: mark["starts"]), lambda mark: mark["at"])


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds `own`, the text without quotes, and `passages` and `short`, arrays of (level, digest)."""
    # Every step is a column of its own behind a generator, so that no array is computed anew per element.
    def step(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.withColumn(name, F.explode(F.array(value)))

    df = step(messages, "_lines", _levels(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")))
    df = step(df, "_starts", _run_starts("_lines"))
    runs = F.transform(
        F.col("_starts"),
        lambda at: F.struct(
            F.get(F.col("_lines"), at)["level"].alias("level"), at.alias("at"),
        ),
    )
    df = step(df, "_runs", runs)
    # The end of a run is the first line without text or the start of the next run.
    bodies = F.transform(
        F.col("_runs"),
        lambda run, i: F.struct(
            run["level"].alias("level"),
            F.array_join(F.transform(
                F.slice(F.col("_lines"), run["at"] + 1, F.coalesce(F.get(F.col("_starts"), i + 1), F.size("_lines")) - run["at"]),
                lambda line: line["body"],
            ), " ").alias("body"),
        ),
    )
    df = step(df, "_bodies", bodies)

    def introduces(line: Column, i: Column) -> Column:
        after, second = F.get(F.col("_lines"), i + 1), F.get(F.col("_lines"), i + 2)
        quote = (after["level"] > 0) | (after["blank"] & (second["level"] > 0))
        return line["body"].rlike(_LEAD_IN) & F.coalesce(quote, F.lit(False))

    own = F.filter(F.col("_lines"), lambda line, i: (line["level"] == 0) & ~introduces(line, i))
    own = F.array_join(F.transform(own, lambda line: line["body"]), "\n")
    df = step(df, "own", F.regexp_replace(F.regexp_replace(own, r"\n\s*\n", "\n\n"), r"^\s*\n|\s+$", ""))
    keyed = F.transform(
        F.concat(
            F.col("_bodies"), F.transform("_lines", lambda line: F.struct(line["level"].alias("level"), line["body"].alias("body"))),
            F.array(F.struct(F.lit(0).alias("level"), F.col("own").alias("body"))),
        ),
        lambda passage: F.struct(passage["level"].alias("level"), normalised(passage["body"]).alias("plain")),
    )
    df = step(df, "_keyed", keyed)

    def digests(told: Column) -> Column:
        return F.array_distinct(F.transform(told, lambda p: F.struct(p["level"].alias("level"), F.md5(p["plain"]).alias("digest"))))

    df = step(df, "passages", digests(F.filter(F.col("_keyed"), lambda p: F.length(p["plain"]) >= MIN_PASSAGE)))
    short = F.filter(F.col("_keyed"), lambda p: (p["plain"] != "") & (F.length(p["plain"]) < MIN_PASSAGE))
    return step(df, "short", digests(short)).drop("_lines", "_starts", "_runs", "_bodies", "_keyed")


def links(parsed: DataFrame) -> DataFrame:
    """`(conv_id, turn, level, digest, to_conv, to_turn)`: the original of every quoted passage that has one.

    The original is the first message that says the passage itself: per conversation if it is before the
    quote, otherwise in all other conversations, unless the passage is short. Quoted and original passages meet per digest, one row each.
    """
    long = F.transform("passages", lambda p: F.struct(p["level"].alias("level"), p["digest"].alias("digest"), F.lit(True).alias("long")))
    short = F.transform("short", lambda p: F.struct(p["level"].alias("level"), p["digest"].alias("digest"), F.lit(False).alias("long")))
    each = parsed.select("conv_id", "turn", F.explode(F.concat(long, short)).alias("p")).select("conv_id", "turn", "p.level", "p.digest", "p.long")
    said = each.where("level = 0").groupBy("digest", "conv_id").agg(F.min("turn").alias("to_turn"), F.first("long").alias("long"))
    away = said.where("long").select("digest", "conv_id", "to_turn")
    first = away.groupBy("digest").agg(F.min(F.struct("conv_id", "to_turn")).alias("first"))
    # The quoter's own conversation is passed over: for it there is the first message of any other.
    others = lookup_join(away, first, ["digest"], "inner").where(F.col("conv_id") != F.col("first.conv_id"))
    second = others.groupBy("digest").agg(F.min(F.struct("conv_id", "to_turn")).alias("second"))
    anywhere = first.join(second, "digest", "left")
    quoted = each.where("level > 0").distinct()
    here = quoted.join(said, ["digest", "conv_id"], "left").withColumn(
        "to_turn", F.when(F.col("to_turn") < F.col("turn"), F.col("to_turn"))
    )
    found = here.join(anywhere, "digest", "left").withColumn(
        "first", F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    )
    elsewhere = F.col("to_turn").isNull() & F.col("first").isNotNull()
    return found.select(
        "conv_id", "turn", "level", "digest",
        F.when(F.col("to_turn").isNotNull(), F.col("conv_id")).when(elsewhere, F.col("first.conv_id")).alias("to_conv"),
        F.coalesce("to_turn", F.when(elsewhere, F.col("first.to_turn"))).alias("to_turn"),
    ).where("to_conv IS NOT NULL")


def _threads(parents: DataFrame, area: StagingArea) -> DataFrame:
    """`(conv_id, turn, thread)`: for messages with a quoted parent in their conversation, the turn at
    which following parents ends. Chains are followed by doubling."""
    current = area.stage(parents.select("conv_id", "turn", F.col("to_turn").alias("thread")), "threads-0")
    for number in range(1, MAX_DOUBLINGS):
        above = current.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        moved = current.join(above, ["conv_id", "thread"], "left")
        stepped = area.stage(
            moved.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), F.col("above").isNotNull().alias("moved")),
            f"threads-{number}",
        )
        current = stepped.select("conv_id", "turn", "thread")
        if not stepped.where("moved").limit(1).count():
            break
    return current


def conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    area: StagingArea | None = None,
) -> DataFrame:
    """`(conv_id, position, turn, role, text, reply_conv, reply_turn, quote_depth, n_links, thread, formatted)`."""
    area = area_for(df, area)
    messages = df.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    parsed = area.stage(parse(messages).drop("text"), "parsed")
    linked = area.stage(links(parsed), "links")
    parent = linked.groupBy("conv_id", "turn").agg(
        F.min(F.struct("level", (F.col("to_conv") != F.col("conv_id")).alias("away"), "to_turn", "to_conv")).alias("least"),
        F.max("level").alias("quote_depth"), F.count(F.lit(1)).alias("n_links"),
    ).select("conv_id", "turn", F.col("least.to_turn").alias("to_turn"), F.col("least.to_conv").alias("to_conv"), "quote_depth", "n_links")
    threads = _threads(parent.where("to_conv = conv_id"), area).withColumnRenamed("thread", "root")

    placed = (
        parsed.join(parent, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
        .withColumn("thread", F.coalesce("root", "turn"))
    )
    # Positions: ranges of the reply order are numbered by themselves and shifted by those before them.
    order = ("conv_id", "thread", "turn", "role", "own")
    ranged = area.stage(
        placed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("conv_id", "range").orderBy("thread", "turn", "role", "own")
    numbered = ranged.withColumn("place", F.row_number().over(within)).join(shifts, ["conv_id", "range"])
    body = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.col("own"), F.lit(CLOSE), F.lit("\n"))
    return numbered.select(
        "conv_id", (F.col("place") + F.col("shift") - 1).cast("bigint").alias("position"), "turn", "role",
        F.col("own").alias("text"), F.col("to_conv").alias("reply_conv"), F.col("to_turn").alias("reply_turn"),
        F.coalesce("quote_depth", F.lit(0)).cast("int").alias("quote_depth"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "thread", body.alias("formatted"),
    )


def op9_quotes(spark, sf_dir: str) -> DataFrame:
    return conversations(read_table(spark, sf_dir, "conversations"))

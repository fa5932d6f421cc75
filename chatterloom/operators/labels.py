"""Names for topics, and attaching them to topics and documents.

A topic table has one row per topic. Naming goes through it in topic order, because each request
shows the names given before; the table is checked to be small first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chatterloom.functions import prompts
from chatterloom.functions.text import capitalize_words, clean_label
from chatterloom.operators.joins import lookup_join

#: Answers a request: `(instruction, request) -> text`.
Namer = Callable[[str, str], str]
MAX_TOPICS = 2000
UNKNOWN = "Unknown Topic"


def _by_topic():
    # One group by intent: a topic table has at most MAX_TOPICS rows.
    return Window.partitionBy(F.lit(0)).orderBy("topic")


def naming_prompts(
    topics: DataFrame, context: str, labels: DataFrame | None = None
) -> DataFrame:
    """`(topic, topic_key, instruction, request)`, one naming request per topic.

    With `labels (topic, topic_label)` each instruction lists the names of the topics before.
    """
    used = F.lit("")
    if labels is not None:
        topics = topics.join(F.broadcast(_checked(labels)), "topic", "left")
        before = _by_topic().rowsBetween(Window.unboundedPreceding, -1)
        topics = topics.withColumn(
            "_used", F.array_join(F.collect_list("topic_label").over(before), ", ")
        )
        used = F.col("_used")
    return topics.select(
        "topic", "topic_key",
        prompts.naming_instruction(context, used).alias("instruction"),
        prompts.naming_request(F.col("terms")).alias("request"),
    )


def review_prompts(topics: DataFrame, labels: DataFrame, context: str) -> DataFrame:
    """`(topic, topic_key, instruction, request)`: each request shows all names and keywords."""
    lines = topics.join(F.broadcast(_checked(labels)), "topic", "left").select(
        "topic", "topic_key",
        prompts.review_line(
            F.col("topic_key"), F.coalesce("topic_label", F.lit(UNKNOWN)), F.col("terms")
        ).alias("line"),
    )
    whole = _by_topic().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return lines.select(
        "topic", "topic_key",
        prompts.review_instruction(
            context, F.array_join(F.collect_list("line").over(whole), "\n")
        ).alias("instruction"),
        prompts.review_request(F.col("topic_key")).alias("request"),
    )


def keyword_labels(topics: DataFrame) -> DataFrame:
    """`(topic, topic_label)` without a model: the three best terms.

    Where topics share them, all but the first add a later term of their own; where that runs out, or
    gives a name that another topic has, they add their number.
    """
    def spelled(terms: Column) -> Column:
        return clean_label(F.translate(F.array_join(terms, " "), "_", " "))

    first = topics.select("topic", "terms", spelled(F.slice("terms", 1, 3)).alias("base"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("topic"))
    term = spelled(F.array(F.get("terms", F.col("place") + 1)))
    numbered = F.concat_ws(" ", "base", F.col("topic").cast("string"))
    told = first.withColumn("place", place).select(
        "topic", "place", numbered.alias("numbered"),
        F.when(F.col("place") == 1, F.col("base"))
        .when(F.coalesce(term, F.lit("")) != "", F.concat_ws(" ", "base", term))
        .otherwise(numbered).alias("name"),
    )
    same = F.row_number().over(Window.partitionBy("name").orderBy("place", "topic"))
    return told.withColumn("same", same).select(
        "topic", F.when(F.col("same") == 1, F.col("name")).otherwise(F.col("numbered")).alias("topic_label")
    )


def name_topics(
    topics: DataFrame, namer: Namer, context: str, show_used: bool = True, review: bool = True
) -> DataFrame:
    """`(topic, topic_label)` from a namer, in two passes.

    Pass one names each topic, seeing the names given so far; pass two shows all names and lets the
    namer improve each, later topics seeing earlier improvements.
    """
    rows = (
        _checked(topics)
        .orderBy("topic")
        .select(
            "topic", "topic_key", F.array_join(F.slice("terms", 1, 10), ", ").alias("keywords"),
            prompts.naming_request(F.col("terms")).alias("naming"),
            prompts.review_request(F.col("topic_key")).alias("reviewing"),
        )
        .collect()
    )

    def cleaned(text: str) -> str:
        return " ".join(word.capitalize() for word in text.split())

    names: dict[int, str] = {}
    before, after = prompts.naming_parts(context)
    for row in rows:
        used = ", ".join(names.values()) if show_used else ""
        names[row["topic"]] = cleaned(namer(f"{before}{used or 'none'}{after}", row["naming"]))
    if review:
        before, after = prompts.review_parts(context)
        for row in rows:
            lines = "\n".join(
                prompts.review_text(each["topic_key"], names[each["topic"]], each["keywords"])
                for each in rows
            )
            answer = namer(f"{before}{lines}{after}", row["reviewing"])
            names[row["topic"]] = cleaned(answer.replace('"', "").replace("'", ""))
    return topics.sparkSession.createDataFrame(
        sorted(names.items()), "topic int, topic_label string"
    )


def attach_labels(
    df: DataFrame, labels: DataFrame, topic_col: str = "dominant_topic", default: str | None = UNKNOWN
) -> DataFrame:
    """Add `topic_label`; topics without a name get `default`, or null when that is None."""
    named = lookup_join(df, labels.select(F.col("topic").alias(topic_col), "topic_label"), [topic_col])
    if default is None:
        return named
    return named.withColumn("topic_label", F.coalesce("topic_label", F.lit(default)))


def attach_terms(df: DataFrame, topics: DataFrame, topic_col: str = "dominant_topic") -> DataFrame:
    """Add `topic_desc`, the terms of the row's topic."""
    described = topics.select(
        F.col("topic").alias(topic_col), F.array_join("terms", ", ").alias("topic_desc")
    )
    return lookup_join(df, described, [topic_col])


def tidy_labels(df: DataFrame, column: str = "topic_label", quotes: bool = True) -> DataFrame:
    """Bring names given by a model into their stored form."""
    text = F.col(column)
    return df.withColumn(column, clean_label(text) if quotes else capitalize_words(text))


def _checked(topics: DataFrame) -> DataFrame:
    if topics.limit(MAX_TOPICS + 1).count() > MAX_TOPICS:
        raise ValueError(f"a topic table has at most {MAX_TOPICS} rows")
    return topics

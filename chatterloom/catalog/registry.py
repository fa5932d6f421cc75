"""Registration, inputs shared by the queries, and the SQL fragments that mirror them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.functions.wordlists import STOP_WORDS
from chatterloom.operators import normalize, vocabulary
from chatterloom.sources.tables import read_parquet, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- inputs ---------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def plain_documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """All documents as conversations."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("conversation"), *more)


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """All documents, prepared for work that is heavy per byte."""
    return spread(plain_documents(spark, sf_dir, *more), "conv_id")


def normalized(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return normalize.normalize_tokens(documents(spark, sf_dir, *more))


def rounded(*names: str) -> dict[str, Column]:
    return {name: F.round(name, 6) for name in names}


# --- topics dealt out from the vocabulary, in place of learned ones ---------------------------

DEALT_TOPICS = 7
DEALT_TERMS = 20
#: The last topic has no label, and two topics share one.
TOPIC_LABELS = {
    1: "Orders", 2: "Refunds", 3: "Account Access", 4: "Delivery", 5: "Contact", 6: "Contact",
}


def dealt_terms(
    spark: SparkSession, sf_dir: str, topics: int = DEALT_TOPICS, terms: int = DEALT_TERMS
) -> DataFrame:
    """`(topic, rank, term)`: the most common terms dealt out to the topics in turn."""
    vocab = vocabulary.build_vocabulary(normalized(spark, sf_dir), keep_terms=topics * terms)
    return vocab.select(
        (F.col("term_id") % topics + 1).alias("topic"),
        (F.floor(F.col("term_id") / topics) + 1).cast("int").alias("rank"),
        "term",
    )


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOPIC_LABELS.items()), "topic int, topic_label string")


def dealt_topic(key: str = "conv_id") -> Column:
    return (F.col(key) % DEALT_TOPICS + 1).cast("int")


# --- SQL fragments ---------------------------------------------------------------------------

STOP_SQL = "(" + ", ".join(quoted(word) for word in sorted(set(STOP_WORDS))) + ")"

#: A list expression over a column `text`.
RAW_SQL = (
    r"regexp_extract_all(regexp_replace(lower({text}), '\{{\{{.*?\}}\}}', '', 'g'), "
    r"'[\p{{L}}\p{{N}}_]+')"
)


def raw_sql(text: str = "text") -> str:
    return RAW_SQL.format(text=text)


def light_sql(text: str = "text") -> str:
    return rf"[t FOR t IN {raw_sql(text)} IF NOT regexp_full_match(t, '\p{{N}}+')]"


def content_sql(text: str = "text") -> str:
    return (
        rf"[t FOR t IN {raw_sql(text)} IF NOT regexp_full_match(t, '\p{{N}}+') "
        rf"AND length(t) > 1 AND t NOT IN {STOP_SQL}]"
    )


#: CTEs `toks (conv_id, tokens)` and `long (conv_id, pos, token)` over all documents.
TOKS_SQL = f"""
toks AS (
  SELECT * FROM (SELECT doc_id AS conv_id, lang, {content_sql()} AS tokens FROM documents)
  WHERE len(tokens) > 0
),
long AS (
  SELECT conv_id, lang, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM toks
)"""

#: CTE `vocab (term, term_id, df, cf)` over `long`.
VOCAB_SQL = """
stats AS (
  SELECT token AS term, count(*) AS cf, count(DISTINCT conv_id) AS df FROM long GROUP BY token
),
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS term_id, df, cf
  FROM stats
  WHERE df >= 5 AND df <= 0.95::DOUBLE * (SELECT count(*) FROM toks)
  ORDER BY df DESC, term LIMIT 100000
)"""

#: CTE `dealt (topic, rank, term)` over `vocab`.
DEALT_SQL = f"""
dealt AS (
  SELECT CAST(term_id % {DEALT_TOPICS} + 1 AS INTEGER) AS topic,
         CAST(term_id // {DEALT_TOPICS} + 1 AS INTEGER) AS rank, term
  FROM vocab WHERE term_id < {DEALT_TOPICS * DEALT_TERMS}
)"""

LABELS_SQL = "labels_given AS (SELECT * FROM (VALUES " + ", ".join(
    f"(CAST({topic} AS INTEGER), {quoted(label)})" for topic, label in TOPIC_LABELS.items()
) + ") v(topic, topic_label))"

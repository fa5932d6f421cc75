"""LDA topic models: training, sweeping the number of topics, and reading the result."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.config import Settings
from chatterloom.operators import coherence, sharded, variational
from chatterloom.operators.variational import VariationalModel
from chatterloom.sources.staging import StagingArea


@dataclass(frozen=True)
class TopicModel:
    """A fitted model with the terms its vectors count."""

    model: LDAModel
    terms: Sequence[str]
    num_topics: int

    def term_rows(self, top: int) -> list[tuple]:
        """`(topic, rank, term, weight)`, topics from 1; `num_topics * top` rows."""
        described = self.model.describeTopics(top).collect()
        return [
            (row["topic"] + 1, rank, self.terms[index], round(float(weight), 3))
            for row in described
            for rank, (index, weight) in enumerate(
                zip(row["termIndices"], row["termWeights"], strict=True), start=1
            )
        ]

    def mixtures(self, features: DataFrame, carry: Sequence[str]) -> DataFrame:
        """`(carried columns, mixture)`: the share of each topic in every document, zeros without known terms."""
        return self.model.transform(features).select(*carry, vector_to_array("topicDistribution").alias("mixture"))


def training_schedule(n_docs: int, settings: Settings) -> tuple[int, float]:
    """`(updates, share of documents per update)`: `passes` visits per document in chunks.

    The rule is the same at every size. An update reads its chunk only.
    """
    updates = settings.passes * max(1, math.ceil(n_docs / settings.chunk_size))
    return updates, min(1.0, settings.passes / updates)


def fit_topics(
    features: DataFrame, terms: Sequence[str], num_topics: int, n_docs: int, settings: Settings,
    whole_corpus_updates: int | None = None, area: StagingArea | None = None,
) -> VariationalModel:
    """Fit an online topic model with learned priors; see `variational`.

    `whole_corpus_updates` trains the library's kind of model instead, in that many updates over all documents: the prior of
    the terms is not learned, and a document is inferred until it has settled.
    """
    if whole_corpus_updates is None:
        return variational.fit_together(features, terms, [num_topics], n_docs, settings, area)[num_topics]
    area = area if area is not None else StagingArea(features.sparkSession)
    dealt = sharded.deal(features, n_docs, n_docs, sharded.PART_DOCS, area, "parts")
    try:
        return sharded.train(
            dealt, terms, [num_topics], n_docs, whole_corpus_updates, settings.seed, learn_terms=False
        )[num_topics]
    finally:
        dealt.release()


def sweep_topics(
    features: DataFrame, corpus: DataFrame, terms: Sequence[str], n_docs: int, settings: Settings,
    with_bound: bool = False, area: StagingArea | None = None,
) -> tuple[dict[int, VariationalModel], DataFrame]:
    """Fit one model per topic count in shared passes and score all of them in one pass over the corpus.

    Returns the models by topic count and the table
    `(num_topics, c_v, u_mass, log_perplexity_bound, warning)`. The bound is null unless asked for:
    it infers every document again for each model.
    """
    models = variational.fit_together(features, terms, settings.topic_counts(), n_docs, settings, area)
    rows = [
        (k, topic, rank, term)
        for k, model in models.items()
        for topic, rank, term, _weight in model.term_rows(settings.top_terms)
    ]
    scores = coherence.model_coherence(corpus, rows, settings.window)
    notes = features.sparkSession.createDataFrame(
        [
            (k, model.log_bound(features) if with_bound else None, model.prior_warning())
            for k, model in models.items()
        ],
        "model int, log_perplexity_bound double, warning string",
    )
    table = (
        notes.join(scores, "model", "left")
        .select(
            F.col("model").alias("num_topics"),
            F.round("c_v", 4).alias("c_v"),
            F.round("u_mass", 4).alias("u_mass"),
            F.round("log_perplexity_bound", 4).alias("log_perplexity_bound"),
            "warning",
        )
        .orderBy("num_topics")
    )
    return models, table


def topic_terms(spark: SparkSession, model: TopicModel | VariationalModel, top: int = 20) -> DataFrame:
    """`(topic, rank, term, weight)`, weights rounded to three decimals."""
    return spark.createDataFrame(
        model.term_rows(top), "topic int, rank int, term string, weight double"
    )


def topic_table(terms: DataFrame) -> DataFrame:
    """`(topic, topic_key, terms array<string>)`, the terms in rank order."""
    # A group holds the top terms of one topic.
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return terms.groupBy("topic").agg(ordered.alias("ranked")).select(
        "topic",
        F.concat(F.lit("Topic"), F.col("topic").cast("string")).alias("topic_key"),
        F.col("ranked.term").alias("terms"),
    )


def strongest_entry(vector):
    """`(1-based place of the first maximum, its value)` of an array; nulls when all are zero."""
    top = F.array_max(vector)
    found = top > 0
    return F.when(found, F.array_position(vector, top).cast("int")), F.when(found, top)


def dominant_topics(
    model: TopicModel | VariationalModel, features: DataFrame, carry: Iterable[str] = ("conv_id",)
) -> DataFrame:
    """`(carried columns, dominant_topic, contribution_pct)`.

    A document without any vocabulary term has no dominant topic: null, with share 0.
    """
    carry = list(carry)
    mixed = model.mixtures(features, carry)
    topic, share = strongest_entry(F.col("mixture"))
    return mixed.select(
        *carry, topic.alias("dominant_topic"),
        F.round(F.coalesce(share, F.lit(0.0)) * 100, 2).alias("contribution_pct"),
    )


def top_topics(corpus: DataFrame, terms: DataFrame, window: int = 110) -> DataFrame:
    """Topics by falling UMass coherence: `(topic, u_mass)`."""
    pairs = coherence.topic_pairs(corpus, terms, window)
    return coherence.umass(pairs).select("topic", "u_mass").orderBy(F.desc("u_mass"), "topic")


def category_purity(df: DataFrame, category_col: str, topic_col: str) -> DataFrame:
    """Known categories against found topics: `(category, topic, n, topic_share, purity)`.

    Rows without a topic form a topic of their own, null. `topic_share` is the part of the topic that the category makes up; `purity`, the same in every
    row, is the share of all rows that belong to the main category of their topic.
    """
    counts = df.groupBy(category_col, topic_col).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(topic_col).agg(
        F.sum("n").alias("topic_n"), F.max("n").alias("main_n")
    )
    purity = sizes.agg((F.sum("main_n") / F.sum("topic_n")).alias("purity"))
    sizes = sizes.withColumnRenamed(topic_col, "sized_topic")
    return counts.join(sizes, F.col(topic_col).eqNullSafe(F.col("sized_topic"))).select(
        category_col, topic_col, "n",
        (F.col("n") / F.col("topic_n")).alias("topic_share"),
        purity.scalar().alias("purity"),
    )


def category_matrix(df: DataFrame, category_col: str, topic_col: str, topics: Sequence[int]) -> DataFrame:
    """The same counts with one column per topic."""
    return df.groupBy(category_col).pivot(topic_col, list(topics)).count().na.fill(0)

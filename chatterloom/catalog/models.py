"""Queries that train a model. Their rows depend on the learner, so they have no SQL."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.catalog.registry import documents, normalized, query, table
from chatterloom.catalog.reports import text_scorer
from chatterloom.catalog.texts import assembled
from chatterloom.config import WIDE_SWEEP, Settings
from chatterloom.operators import clusters, coherence, density, normalize, phrases, topics, vocabulary
from chatterloom.plans.analysis import ConversationAnalysis
from chatterloom.plans.fitted import FittedAnalysis
from chatterloom.sources.staging import StagingArea

#: A short range of topic counts with the whole training schedule.
SHORT_SWEEP = Settings(start_topics=3, end_topics=5)
#: Updates of the second model, each over the whole corpus.
NGRAM_UPDATES = 100


def _prepared(
    corpus: DataFrame, no_above: float = 0.95, keep_terms: int | None = 100_000
) -> tuple[DataFrame, list[str]]:
    vectorize = vocabulary.fit_vectorizer(corpus, no_above=no_above, keep_terms=keep_terms)
    features = vectorize.transform(corpus).select("conv_id", "features")
    return features.persist(StorageLevel.MEMORY_AND_DISK), vectorize.vocabulary


def _phrase_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final tokens of all documents, staged because training and scoring both read them."""
    area = StagingArea(spark)
    corpus = area.stage(normalized(spark, sf_dir).select("conv_id", "tokens"), "normalized")
    return area.stage(
        phrases.apply_phrases(corpus, phrases.score_phrases(corpus, area=area)), "corpus"
    )


def _fitted(spark: SparkSession, sf_dir: str, k: int = 4):
    corpus = _phrase_corpus(spark, sf_dir)
    features, terms = _prepared(corpus)
    model = topics.fit_topics(features, terms, k, features.count(), SHORT_SWEEP)
    return corpus, features, model


@query("lda_fit")
def lda_fit(spark, sf_dir):
    """The learned priors: of each topic in documents, and the range of those of the terms."""
    _corpus, features, model = _fitted(spark, sf_dir)
    features.unpersist()
    low, high = float(model.term_prior.min()), float(model.term_prior.max())
    return spark.createDataFrame(
        [(topic, float(alpha), low, high) for topic, alpha in enumerate(model.doc_prior, start=1)],
        "topic int, doc_prior double, least_term_prior double, greatest_term_prior double",
    )


@query("topic_terms")
def topic_terms(spark, sf_dir):
    _corpus, features, model = _fitted(spark, sf_dir)
    features.unpersist()
    return topics.topic_terms(spark, model)


@query("dominant_topic")
def dominant_topic(spark, sf_dir):
    _corpus, features, model = _fitted(spark, sf_dir)
    found = StagingArea(spark).stage(topics.dominant_topics(model, features), "dominant")
    features.unpersist()
    return found


@query("top_topics")
def top_topics(spark, sf_dir):
    corpus, features, model = _fitted(spark, sf_dir)
    features.unpersist()
    return topics.top_topics(corpus, topics.topic_terms(spark, model))


def _sweep(spark: SparkSession, sf_dir: str, settings: Settings, with_bound: bool) -> DataFrame:
    corpus = _phrase_corpus(spark, sf_dir)
    features, terms = _prepared(corpus)
    n_docs = features.count()
    _models, scores = topics.sweep_topics(features, corpus, terms, n_docs, settings, with_bound)
    features.unpersist()
    return scores


@query("lda_sweep")
def lda_sweep(spark, sf_dir):
    """5 to 19 topics, as users run it."""
    return _sweep(spark, sf_dir, WIDE_SWEEP, with_bound=False)


@query("lda_sweep_with_bound")
def lda_sweep_with_bound(spark, sf_dir):
    return _sweep(spark, sf_dir, SHORT_SWEEP.with_(end_topics=4), with_bound=True)


def _ngram_model(spark: SparkSession, sf_dir: str):
    """Whole-corpus updates over words and word pairs."""
    plain = normalize.normalize_light(documents(spark, sf_dir)).select("conv_id", "tokens")
    grams = StagingArea(spark).stage(vocabulary.ngram_tokens(plain), "grams")
    features, terms = _prepared(grams, no_above=0.9, keep_terms=None)
    try:
        model = topics.fit_topics(
            features, terms, 8, features.count(), SHORT_SWEEP, whole_corpus_updates=NGRAM_UPDATES
        )
    finally:
        features.unpersist()
    return grams, model


@query("lda_ngram")
def lda_ngram(spark, sf_dir):
    _grams, model = _ngram_model(spark, sf_dir)
    return topics.topic_terms(spark, model, 10)


def _clustered(spark: SparkSession, sf_dir: str):
    """Clusters of the embedded documents, and their words. Vectors belong to documents by key."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("conv_id"), "embedding"
    )
    found = clusters.cluster_embeddings(vectors, clusters=15, dimensions=5)
    return found, clusters.cluster_terms(normalized(spark, sf_dir), found)


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir)[1]


@query("cluster_topics")
def cluster_topics(spark, sf_dir):
    """Every document, also those without a vector."""
    found, _terms = _clustered(spark, sf_dir)
    return clusters.cluster_topics(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id")), found).select(
        "conv_id", "topic"
    )


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of at least 100 embedded documents, however many there are, and outliers."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    return density.density_clusters(vectors, min_size=100)


@query("density_clusters")
def density_clusters(spark, sf_dir):
    return _dense(spark, sf_dir).select("conv_id", "cluster")


@query("density_topics")
def density_topics(spark, sf_dir):
    """Every document, with the topic of its cluster."""
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"))
    return clusters.cluster_topics(corpus, _dense(spark, sf_dir)).select("conv_id", "topic")


@query(
    "vector_coverage",
    """SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM embeddings) AS n_vectors,
      (SELECT count(*) FROM documents JOIN embeddings ON doc_id = vec_id) AS n_both""",
)
def vector_coverage(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"))
    return clusters.vector_coverage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id")), vectors)


@query("model_comparison")
def model_comparison(spark, sf_dir):
    rows = []

    def compare(name: str, train) -> None:
        start = time.monotonic()
        corpus, terms = train()
        terms = [(0, row["topic"], row["rank"], row["term"]) for row in terms.collect()]
        seconds = time.monotonic() - start
        score = coherence.model_coherence(corpus, terms).first()
        rows.append((name, round(score["c_v"], 4), round(seconds, 3)))

    def lda():
        corpus, features, model = _fitted(spark, sf_dir, 8)
        features.unpersist()
        return corpus, topics.topic_terms(spark, model)

    def ngram_lda():
        grams, model = _ngram_model(spark, sf_dir)
        return grams, topics.topic_terms(spark, model)

    def embedding():
        return normalized(spark, sf_dir), _clustered(spark, sf_dir)[1]

    compare("LDA", lda)
    compare("LDA over words and pairs", ngram_lda)
    compare("embedding clusters", embedding)
    return spark.createDataFrame(rows, "model string, c_v double, train_seconds double")


@query("full_report")
def full_report(spark, sf_dir):
    """The whole analysis of the assembled conversations; its result is the worst topics."""
    analysis = ConversationAnalysis(WIDE_SWEEP.with_(min_count=5), scorer=text_scorer)
    return analysis.fit(assembled(spark, sf_dir)).final_insights


def _kept_analysis(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """An analysis of the assembled conversations, saved, and its own assignment of topics."""
    area = StagingArea(spark)
    analysis = ConversationAnalysis(SHORT_SWEEP.with_(min_count=5, end_topics=3)).fit(assembled(spark, sf_dir))
    analysis.fitted().save(area.path("kept"))
    return area.path("kept"), analysis.corpus_topic_df


@query("score_new_conversations")
def score_new_conversations(spark, sf_dir):
    """A saved analysis applied to all conversations, as it would be to new ones."""
    path, _ = _kept_analysis(spark, sf_dir)
    fitted = FittedAnalysis.load(spark, path)
    return fitted.transform(assembled(spark, sf_dir).select("conv_id", "conversation")).drop("conversation")

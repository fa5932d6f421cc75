"""Vocabularies, bags of words and class-based term weights."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import SparkContext
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chatterloom.functions.text import keep_content
from chatterloom.functions.wordlists import STOP_WORDS
from chatterloom.operators.evaluate import compute_once
from chatterloom.operators.joins import lookup_join
from chatterloom.sources.staging import StagingArea

#: Stands for "any document" among the terms; no token is empty.
_ANY = ""


def count_in_rows(corpus: DataFrame, others: Iterable[str] = ()) -> DataFrame:
    """`others` and `counts array<struct<term, n>>`: distinct tokens of each row with their number.

    Sorting a row's tokens and measuring the runs counts them without a shuffle.
    """
    others = list(others)
    ordered = compute_once(corpus.select(*others, "tokens"), {"_sorted": F.sort_array("tokens")})
    starts = F.filter(
        F.transform(
            "_sorted",
            lambda token, i: F.when((i == 0) | (token != F.get("_sorted", i - 1)), i),
        ),
        lambda i: i.isNotNull(),
    )
    runs = compute_once(ordered.drop("tokens"), {"_starts": starts})
    counts = F.transform(
        "_starts",
        lambda start, j: F.struct(
            F.get("_sorted", start).alias("term"),
            (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - start).alias("n"),
        ),
    )
    return runs.select(*others, counts.alias("counts"))


def term_statistics(corpus: DataFrame) -> DataFrame:
    """`(term, cf, df)`: occurrences and documents per term, and per `''` the document count.

    Rows are counted in themselves first and add one mark, so one partially summed aggregation
    gives all numbers without a distinct count.
    """
    mark = F.array(F.struct(F.lit(_ANY).alias("term"), F.lit(0).alias("n")))
    return (
        count_in_rows(corpus)
        .select(F.inline(F.when(F.size("counts") > 0, F.concat(mark, "counts"))))
        .groupBy("term")
        .agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
    )


def filter_terms(
    statistics: DataFrame, no_below: int = 5, no_above: float = 0.95,
    keep_terms: int | None = 100_000,
) -> DataFrame:
    """Terms in at least `no_below` documents and at most the share `no_above` of them.

    Of the rest, the `keep_terms` terms in most documents stay. They are found by document
    frequency first, so that no task has to sort the whole vocabulary.
    """
    mark = statistics.where(F.col("term") == _ANY).select("df").first()
    documents = mark["df"] if mark is not None else 0
    kept = statistics.where(
        (F.col("df") >= no_below)
        & (F.col("df") <= int(no_above * documents))
        & (F.col("term") != _ANY)
    )
    if keep_terms is None:
        return kept
    per_df = kept.groupBy("df").agg(F.count("*").alias("terms"))
    reached = per_df.select(
        "df", F.sum("terms").over(Window.orderBy(F.desc("df"))).alias("terms")
    )
    cut = reached.where(F.col("terms") >= keep_terms).agg(F.max("df").alias("df"))
    return (
        kept.where(F.col("df") >= F.coalesce(cut.scalar(), F.lit(0)))
        .orderBy(F.desc("df"), "term")
        .limit(keep_terms)
    )


def frequent_terms(
    corpus: DataFrame, no_below: int = 5, no_above: float = 0.95,
    keep_terms: int | None = 100_000, area: StagingArea | None = None,
) -> DataFrame:
    """`(term, cf, df)` of the terms of a corpus that pass `filter_terms`."""
    # The filter reads the statistics several times; staged, the texts are read once.
    area = area or StagingArea(corpus.sparkSession)
    statistics = area.stage(term_statistics(corpus), "term_statistics")
    return filter_terms(statistics, no_below, no_above, keep_terms)


def build_vocabulary(
    corpus: DataFrame, no_below: int = 5, no_above: float = 0.95,
    keep_terms: int | None = 100_000, area: StagingArea | None = None,
) -> DataFrame:
    """`(term, term_id, df, cf)`, ids counting from 0 by falling document frequency, then term."""
    kept = frequent_terms(corpus, no_below, no_above, keep_terms, area)
    # Only terms in `no_below` documents or more reach this window, at most `keep_terms` of them.
    order = Window.orderBy(F.desc("df"), "term")
    return kept.select(
        "term", (F.row_number().over(order) - 1).alias("term_id"), "df", "cf"
    )


def fit_vectorizer(
    corpus: DataFrame, no_below: int = 5, no_above: float = 0.95,
    keep_terms: int | None = 100_000, area: StagingArea | None = None,
) -> CountVectorizerModel:
    """A transformer from `tokens` to the sparse term counts that topic models train on.

    Its indices are the ids of `build_vocabulary`, so equal corpora give equal vectors.
    """
    vocabulary = build_vocabulary(corpus, no_below, no_above, keep_terms, area)
    # The model lives on the driver with all its terms: at most `keep_terms`, or as many as pass.
    terms = [row["term"] for row in vocabulary.orderBy("term_id").select("term").collect()]
    if not terms:
        raise ValueError("no term passes the vocabulary filter; lower no_below")
    return vectorizer(terms)


def vectorizer(terms: Sequence[str]) -> CountVectorizerModel:
    """`CountVectorizerModel.from_vocabulary`, but handing over the terms in one call.

    The public constructor sends them one by one, which takes long for a full vocabulary.
    """
    jvm = SparkContext.getOrCreate()._jvm
    divider = "\n"
    if any(divider in term for term in terms):
        raise ValueError("terms are single lines")
    java_terms = jvm.java.util.regex.Pattern.compile(divider).split(divider.join(terms))
    model = CountVectorizerModel(
        jvm.org.apache.spark.ml.feature.CountVectorizerModel(java_terms)
    )
    return model.setInputCol("tokens").setOutputCol("features")


def bag_of_words(
    corpus: DataFrame, vocabulary: DataFrame, key: Iterable[str] = ("conv_id",)
) -> DataFrame:
    """Long form `(key, term_id, n)`. Counted in each row; the vocabulary is joined to the counts."""
    cells = count_in_rows(corpus, key).select(*key, F.inline("counts"))
    numbered = lookup_join(
        cells, vocabulary.select("term", "term_id"), ["term"], "inner", spread_by=[*key, "term"]
    )
    return numbered.select(*key, "term_id", F.col("n").cast("long").alias("n"))


def ngram_tokens(corpus: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Replace `tokens` by its words of two or more characters and their neighbouring pairs.

    Stop words are dropped first, so a pair may span one.
    """
    kept = compute_once(corpus, {"tokens": keep_content(F.col("tokens"), stop_words)})
    pairs = F.filter(
        F.transform("tokens", lambda token, i: F.concat(token, F.lit(" "), F.get("tokens", i + 1))),
        lambda pair: pair.isNotNull(),
    )
    return compute_once(kept, {"tokens": F.concat("tokens", pairs)})


def class_term_weights(
    corpus: DataFrame, class_col: str, area: StagingArea | None = None
) -> DataFrame:
    """Class-based TF-IDF: `(class, term, n, weight)` from rows with a class and `tokens`.

    weight = share of the term in its class * ln(1 + A / f), with A the mean number of words per
    class and f the frequency of the term in all classes.
    """
    counts = (
        corpus.select(class_col, F.explode(F.filter("tokens", lambda t: t != "")).alias("term"))
        .groupBy(class_col, "term")
        .agg(F.count("*").alias("n"))
    )
    counts = (area or StagingArea(corpus.sparkSession)).stage(counts, "class_terms")
    sizes = counts.groupBy(class_col).agg(F.sum("n").alias("class_words"))
    mean_words = sizes.agg(F.avg("class_words").alias("mean"))
    # A term has one row per class here, so its group is small however frequent it is.
    with_totals = counts.select(
        "*", F.sum("n").over(Window.partitionBy("term")).alias("term_total")
    )
    return lookup_join(with_totals, sizes, [class_col], "inner").select(
        class_col, "term", "n",
        (
            F.col("n") / F.col("class_words")
            * F.log(F.lit(1.0) + mean_words.scalar() / F.col("term_total"))
        ).alias("weight"),
    )


def top_class_terms(weights: DataFrame, class_col: str, n: int = 10) -> DataFrame:
    """The `n` heaviest terms of each class with their rank."""
    order = Window.partitionBy(class_col).orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def corpus_statistics(
    corpus: DataFrame, vocabulary: DataFrame, column: str = "conversation"
) -> DataFrame:
    """One row of counts, from a corpus that kept its empty rows."""
    terms = vocabulary.agg(F.count("*").alias("n_terms"))
    return corpus.agg(
        F.count("*").alias("n_texts"),
        F.count_if(F.col(column).isNull()).alias("n_null_texts"),
        F.count_if(F.size("tokens") > 0).alias("n_documents"),
        F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("n_tokens"),
    ).withColumn("n_terms", terms.scalar())

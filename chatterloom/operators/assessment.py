"""Scoring conversations with a supplied scorer, and reading its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chatterloom.functions import prompts
from chatterloom.functions import text as T
from chatterloom.functions.evaluation import (
    CRITERIA, evaluation_fields, evaluation_lines, number_in_line,
)
from chatterloom.functions.wordlists import STOP_WORDS
from chatterloom.operators.evaluate import compute_once
from chatterloom.sources.shipping import limit_batches

#: Runs inside tasks over batches of rows with `instruction` and `request`, and returns each batch
#: with its answers in `evaluation`. Batches may be repeated when a task is retried.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def evaluation_prompts(df: DataFrame, context: str) -> DataFrame:
    """Add `instruction` and `request` to rows with `topic_label` and `conversation`."""
    return df.withColumns(
        {
            "instruction": F.lit(prompts.evaluation_instruction(context)),
            "request": prompts.evaluation_request(F.col("topic_label"), F.col("conversation")),
        }
    )


def score_with(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Run the scorer over the partitions of `df` and add its text as `evaluation`.

    Store the result before using it twice, or the scorer is called again for every use.
    """
    limit_batches(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField("evaluation", StringType())])
    return df.mapInPandas(scorer, schema)


def parse_evaluations(df: DataFrame, column: str = "evaluation") -> DataFrame:
    """Add the five scores, `average_score`, `assessment` and `out_of_range`; drop the raw text."""
    lines = compute_once(df, {"_lines": evaluation_lines(F.col(column))})
    names = [f"_number{i}" for i in range(len(CRITERIA))]
    numbers = compute_once(
        lines, {name: number_in_line(F.col("_lines"), i) for i, name in enumerate(names)}
    )
    fields = evaluation_fields(F.col("_lines"), [F.col(name) for name in names])
    return numbers.withColumns(fields).drop("_lines", *names, column)


def assess(df: DataFrame, scorer: Scorer, context: str) -> DataFrame:
    """Score conversations and read the answers into columns."""
    scored = score_with(evaluation_prompts(df, context), scorer)
    return parse_evaluations(scored).drop("instruction", "request")


def readability(df: DataFrame, column: str = "conversation") -> DataFrame:
    """Add `readability_proxy`, the Flesch-Kincaid grade: a stand-in for conciseness."""
    words = compute_once(df, {"_words": T.words(F.lower(F.col(column)))})
    return words.withColumn(
        "readability_proxy", T.reading_grade(F.col(column), F.col("_words"))
    ).drop("_words")


def question_answer_overlap(
    pairs: DataFrame, question_col: str = "question", answer_col: str = "answer",
    stop_words=STOP_WORDS,
) -> DataFrame:
    """Add stand-ins for relevance and completeness that need no model.

    `coverage_proxy`: share of the question's content words found in the answer;
    `overlap_proxy`: shared content words over all content words; `answer_words`: answer length.
    Nothing stands in for accuracy or tone.
    """
    def content(column: str):
        tokens = T.keep_content(T.tokens_without_numbers(F.col(column)), stop_words)
        return F.array_distinct(tokens)

    prepared = compute_once(
        pairs,
        {
            "_question": content(question_col),
            "_answer": content(answer_col),
            "answer_words": F.size(T.words(F.col(answer_col))),
        },
    ).withColumn("_shared", F.size(F.array_intersect("_question", "_answer")))
    n_question, n_answer = F.size("_question"), F.size("_answer")
    return prepared.withColumns(
        {
            "coverage_proxy": F.when(n_question > 0, F.col("_shared") / n_question),
            "overlap_proxy": F.when(
                n_question + n_answer - F.col("_shared") > 0,
                F.col("_shared") / (n_question + n_answer - F.col("_shared")),
            ),
        }
    ).drop("_question", "_answer", "_shared")

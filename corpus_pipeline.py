"""From raw documents to token ids: five stages, each of them one operator of `chatterloom.llm`.

Every stage takes all documents that the one before kept; all but the last return the columns of the
table they were given. What the operators do with nulls, empty texts, ties and repeated rows holds here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.llm import bpe, lines, minhash, mixing, quality
from chatterloom.llm.common import read_table
from chatterloom.sources.staging import StagingArea


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across them; documents of nothing but such lines are gone."""
    found = lines.without_repeats(docs)
    return found.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else found


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return minhash.one_of_each(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)` for every copy of a document.

    Ids are staged before they are digested: a task that ran both steps would hold two Python workers, each with
    a vocabulary, and executors keep their workers, idle ones too, through the stages of the next run.
    """
    path = bpe.multilingual_path()
    ids = StagingArea(spark).stage(bpe.encode(docs, path), "ids")
    return bpe.digests(ids, path, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: Merges of bytes and links of near-duplicates are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    area = StagingArea(spark)
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = area.stage(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs

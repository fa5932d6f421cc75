"""Loading, assembling, cleaning and tokenising texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.catalog.registry import (
    STOP_SQL, TOKS_SQL, content_sql, documents, light_sql, normalized, query, raw_sql, rounded, table,
)
from chatterloom.functions import text as T
from chatterloom.functions.wordlists import NOUN_ENDINGS
from chatterloom.operators import assemble, assessment, labels, lemmas, normalize, sampling
from chatterloom.sources.tables import spread


@query("load_table", "SELECT conv_id, turn, role, text FROM conversations")
def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# --- question and answer columns, cut from whole documents; some cells are null ----------------

_QA_SQL = """
qa AS (
  SELECT doc_id AS conv_id, source AS title,
         CASE WHEN doc_id % 10 <> 0 THEN substring(text, 1, length(text) // 2) END AS question,
         CASE WHEN doc_id % 15 <> 0 THEN substring(text, length(text) // 2 + 1) END AS answer
  FROM documents
)"""


def _question_answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("source").alias("title"),
        F.when(F.col("doc_id") % 10 != 0, F.substr("text", F.lit(1), half)).alias("question"),
        F.when(F.col("doc_id") % 15 != 0, F.substr("text", half + 1)).alias("answer"),
    )


@query(
    "merge_qa",
    f"""WITH {_QA_SQL}
    SELECT conv_id, 'Question: ' || concat_ws(' ', title, question) || ' Answer: '
           || coalesce(answer, '') AS conversation FROM qa""",
)
def merge_qa(spark, sf_dir):
    df = _question_answer_table(spark, sf_dir)
    return assemble.corpus(assemble.conversations(df, question_cols=["title", "question"], answer_cols=["answer"]))


@query(
    "merge_qa_null_text",
    f"""WITH {_QA_SQL}
    SELECT conv_id, 'Question: ' || title || ' ' || coalesce(question, 'nan') || ' Answer: '
           || coalesce(answer, 'nan') AS conversation FROM qa""",
)
def merge_qa_null_text(spark, sf_dir):
    df = _question_answer_table(spark, sf_dir)
    return assemble.corpus(
        assemble.merge_questions_answers(df, ["title", "question"], ["answer"], null_text="nan")
    )


@query(
    "merge_qa_strict",
    f"""WITH {_QA_SQL}
    SELECT conv_id, 'Question: ' || title || ' ' || question || ' Answer: ' || answer AS conversation
    FROM qa""",
)
def merge_qa_strict(spark, sf_dir):
    df = _question_answer_table(spark, sf_dir)
    return assemble.corpus(
        assemble.merge_questions_answers_strict(df, ["title", "question"], ["answer"])
    )


@query("unified_column", "SELECT doc_id AS conv_id, text AS conversation FROM documents")
def unified_column(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    return assemble.corpus(assemble.conversations(df, column="text"))


_ASSEMBLED_SQL = """
assembled AS (
  SELECT conv_id,
         'Question: ' || coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '')
         || ' Answer: '
         || coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '')
         AS conversation
  FROM conversations GROUP BY conv_id
)"""


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble_turns(table(spark, sf_dir, "conversations"))


@query("assemble_turns", f"WITH {_ASSEMBLED_SQL} SELECT conv_id, conversation FROM assembled")
def assemble_turns(spark, sf_dir):
    return assembled(spark, sf_dir)


_PAIRS_SQL = """
pairs AS (
  SELECT conv_id, turn, question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer
  FROM (
    SELECT conv_id, turn, role, text AS question,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
    FROM conversations
  ) WHERE role = 'user'
)"""


@query("qa_pairs", f"WITH {_PAIRS_SQL} SELECT conv_id, turn, question, answer FROM pairs")
def qa_pairs(spark, sf_dir):
    return assemble.question_answer_pairs(table(spark, sf_dir, "conversations"))


# --- cleaning ----------------------------------------------------------------------------------


@query(
    "strip_placeholders",
    r"""SELECT conv_id, regexp_replace(conversation, '\{\{.*?\}\}', '', 'g') AS stripped FROM (
      SELECT doc_id AS conv_id,
             CASE doc_id % 5 WHEN 0 THEN '{{Order Number}} ' || text
                  WHEN 1 THEN '{{a' || chr(10) || 'b}} ' || text
                  ELSE text || ' {{x}}{y} {{z}}' END AS conversation
      FROM documents)""",
)
def strip_placeholders(spark, sf_dir):
    docs = documents(spark, sf_dir)
    marked = (
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("{{Order Number}} "), "conversation"))
        .when(F.col("conv_id") % 5 == 1, F.concat(F.lit("{{a\nb}} "), "conversation"))
        .otherwise(F.concat("conversation", F.lit(" {{x}}{y} {{z}}")))
    )
    return docs.select("conv_id", T.strip_placeholders(marked).alias("stripped"))


@query(
    "tokenize",
    f"""WITH {_ASSEMBLED_SQL}
    SELECT conv_id, CAST(len({raw_sql('conversation')}) AS INTEGER) AS n_tokens,
           array_to_string({raw_sql('conversation')}, ' ') AS normalized
    FROM assembled""",
)
def tokenize(spark, sf_dir):
    tokens = normalize.tokenize(assembled(spark, sf_dir))
    return normalize.token_text(tokens).select(
        "conv_id", F.size("tokens").alias("n_tokens"), "normalized"
    )


@query(
    "normalize_tokens",
    f"""WITH {TOKS_SQL}
    SELECT conv_id, CAST(len(tokens) AS INTEGER) AS n_tokens,
           array_to_string(tokens, ' ') AS normalized FROM toks""",
)
def normalize_tokens(spark, sf_dir):
    return normalize.token_text(normalized(spark, sf_dir)).select(
        "conv_id", F.size("tokens").alias("n_tokens"), "normalized"
    )


@query(
    "normalized_text",
    f"""WITH {_ASSEMBLED_SQL}
    SELECT conv_id, array_to_string({content_sql('conversation')}, ' ') AS normalized
    FROM assembled WHERE len({content_sql('conversation')}) > 0""",
)
def normalized_text(spark, sf_dir):
    tokens = normalize.normalize_tokens(assembled(spark, sf_dir))
    return normalize.token_text(tokens).select("conv_id", "normalized")


@query(
    "normalize_light",
    f"""SELECT doc_id AS conv_id, array_to_string({light_sql()}, ' ') AS normalized
    FROM documents WHERE len({light_sql()}) > 0""",
)
def normalize_light(spark, sf_dir):
    tokens = normalize.normalize_light(documents(spark, sf_dir))
    return normalize.token_text(tokens).select("conv_id", "normalized")


@query(
    "stopword_antijoin",
    f"""WITH light AS (SELECT unnest({light_sql()}) AS token FROM documents)
    SELECT token, count(*) AS n FROM light WHERE token NOT IN {STOP_SQL} GROUP BY token""",
)
def stopword_antijoin(spark, sf_dir):
    tokens = normalize.token_positions(normalize.normalize_light(documents(spark, sf_dir)))
    return normalize.without_stop_words(tokens).groupBy("token").agg(F.count("*").alias("n"))


_SPACES = r"[ \t\n\x0B\f\r]+"


@query(
    "clean_labels",
    rf"""WITH raw AS (
      SELECT doc_id AS conv_id, ' "' || lang || chr(9) || source || '''s"  ' || text AS label
      FROM documents)
    SELECT conv_id, array_to_string(
      [CASE substring(w, 1, 1) WHEN 'ß' THEN 'Ss' ELSE upper(substring(w, 1, 1)) END
       || lower(substring(w, 2))
       FOR w IN regexp_split_to_array(translate(label, '"''', ''), '{_SPACES}') IF w <> ''], ' ')
      AS topic_label
    FROM raw""",
)
def clean_labels(spark, sf_dir):
    raw = documents(spark, sf_dir, "lang", "source").select(
        "conv_id",
        F.concat(
            F.lit(' "'), "lang", F.lit("\t"), "source", F.lit("'s\"  "), "conversation"
        ).alias("topic_label"),
    )
    return labels.tidy_labels(raw)


# --- base forms --------------------------------------------------------------------------------

_LEMMA_SQL = f"""
light AS (
  SELECT doc_id AS conv_id, {light_sql()} AS tokens FROM documents
),
light_long AS (
  SELECT conv_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM light
),
forms AS (SELECT token AS form, count(*) AS cf FROM light_long GROUP BY token),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{e}', '{r}')" for e, r in NOUN_ENDINGS)}) v(ending, new)),
options AS (
  SELECT form, cf, substring(form, 1, length(form) - length(ending)) || new AS lemma
  FROM forms JOIN rules ON suffix(form, ending)
  WHERE form NOT IN {STOP_SQL}
),
lemma_table AS (
  SELECT form, cf, lemma FROM options
  WHERE length(lemma) >= 2 AND lemma IN (SELECT form FROM forms)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY length(lemma), lemma) = 1
)"""


@query("learn_lemmas", f"WITH {_LEMMA_SQL} SELECT form, lemma, cf FROM lemma_table")
def learn_lemmas(spark, sf_dir):
    return lemmas.learn_lemmas(normalize.normalize_light(documents(spark, sf_dir)))


@query(
    "lemma_join",
    f"""WITH {_LEMMA_SQL}
    SELECT conv_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS normalized
    FROM light_long LEFT JOIN lemma_table ON token = form GROUP BY conv_id""",
)
def lemma_join(spark, sf_dir):
    tokens = normalize.normalize_light(documents(spark, sf_dir))
    replaced = lemmas.replace_tokens(tokens, lemmas.learn_lemmas(tokens))
    return normalize.token_text(replaced).select("conv_id", "normalized")


# --- samples -----------------------------------------------------------------------------------


@query(
    "sample_n",
    """SELECT doc_id AS conv_id, text AS conversation FROM documents
    ORDER BY md5('7:' || doc_id), doc_id LIMIT 250""",
)
def sample_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("text").alias("conversation")
    )
    return sampling.sample_rows(docs, 250)


@query(
    "head_n",
    "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 100",
)
def head_n(spark, sf_dir):
    return sampling.head_rows(table(spark, sf_dir, "conversations"), 100, ["conv_id", "turn"])


@query(
    "tail_n",
    "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 100",
)
def tail_n(spark, sf_dir):
    return sampling.tail_rows(table(spark, sf_dir, "conversations"), 100, ["conv_id", "turn"])


# --- stand-ins for graded criteria ---------------------------------------------------------------


@query(
    "readability",
    r"""WITH w AS (
      SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents),
    c AS (
      SELECT doc_id, len(words)::DOUBLE AS n_words,
             greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS n_sentences,
             list_sum([greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1) FOR x IN words]) AS n_syllables
      FROM w)
    SELECT doc_id AS conv_id,
           CASE WHEN n_words > 0 THEN round(0.39::DOUBLE * n_words / n_sentences
             + 11.8::DOUBLE * n_syllables / n_words - 15.59::DOUBLE, 6) END AS readability_proxy
    FROM c""",
)
def readability(spark, sf_dir):
    graded = assessment.readability(documents(spark, sf_dir))
    return graded.withColumns(rounded("readability_proxy")).select("conv_id", "readability_proxy")


@query(
    "qa_overlap",
    rf"""WITH {_PAIRS_SQL},
    words AS (
      SELECT conv_id, turn, list_distinct({content_sql('question')}) AS q,
             list_distinct({content_sql('answer')}) AS a,
             len(regexp_extract_all(answer, '[\p{{L}}\p{{N}}_]+')) AS answer_words
      FROM pairs),
    counted AS (
      SELECT conv_id, turn, answer_words, len(q)::DOUBLE AS n_q, len(a) AS n_a,
             len([x FOR x IN q IF list_contains(a, x)]) AS shared FROM words)
    SELECT conv_id, turn, CAST(answer_words AS INTEGER) AS answer_words,
           CASE WHEN n_q > 0 AND n_a IS NOT NULL THEN round(shared / n_q, 6) END AS coverage_proxy,
           CASE WHEN n_q + n_a - shared > 0 THEN round(shared / (n_q + n_a - shared), 6) END
             AS overlap_proxy
    FROM counted""",
)
def qa_overlap(spark, sf_dir):
    pairs = assemble.question_answer_pairs(spread(table(spark, sf_dir, "conversations"), "conv_id"))
    scored = assessment.question_answer_overlap(pairs)
    return scored.withColumns(rounded("coverage_proxy", "overlap_proxy")).select(
        "conv_id", "turn", "answer_words", "coverage_proxy", "overlap_proxy"
    )

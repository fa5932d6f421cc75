"""Labels, prompts, evaluations and topic reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.catalog.registry import (
    DEALT_SQL, LABELS_SQL, TOKS_SQL, VOCAB_SQL, dealt_terms, dealt_topic, documents, label_table,
    plain_documents, query, quoted, rounded,
)
from chatterloom.functions import prompts
from chatterloom.operators import assessment, insights, labels, scoring, topics
from chatterloom.sources.staging import StagingArea

CONTEXT = "chatbot conversations"

# --- evaluation texts derived from the documents -------------------------------------------------
# Well-formed answers and each kind of malformed one. The remark is the whole document in one line.


def evaluation_text(key: str = "conv_id", text: str = "conversation") -> Column:
    kind = F.col(key) % 20
    remark = F.concat(F.lit("Assessment: "), F.regexp_replace(text, "[ \t\n\r]+", " "))

    def line(i: int) -> Column:
        score = 1 + (F.col(key) * 7 + i * 3 + F.col(key) % (i + 2)) % 5
        normal = F.concat(F.lit(f"{i}: "), score.cast("string"))
        if i == 2:
            return F.when(kind == 4, "2: 9").otherwise(normal)
        if i == 3:
            return F.when(kind == 1, "3: 4/5").otherwise(normal)
        return normal

    scores = [line(i) for i in range(1, 6)]
    with_colon = F.concat(remark, F.lit(" : more: text"))
    return (
        F.when((F.col(key) % 7 + 1 == 7) | (kind == 0), "")
        .when(kind == 2, F.concat_ws("\n", *scores))
        .when(kind == 3, F.concat_ws("\r\n", *scores, remark, F.lit("")))
        .when(kind == 5, F.concat_ws("\n", *scores, with_colon))
        .when(kind == 6, F.concat_ws("\n", *scores[:2]))
        .otherwise(F.concat_ws("\n", *scores, remark))
    )


def _line_sql(i: int) -> str:
    normal = f"'{i}: ' || (1 + (doc_id * 7 + {i * 3} + doc_id % {i + 2}) % 5)"
    if i == 2:
        return f"CASE WHEN doc_id % 20 = 4 THEN '2: 9' ELSE {normal} END"
    if i == 3:
        return f"CASE WHEN doc_id % 20 = 1 THEN '3: 4/5' ELSE {normal} END"
    return normal


_SCORES_SQL = ", ".join(_line_sql(i) for i in range(1, 6))
_REMARK_SQL = r"'Assessment: ' || regexp_replace(text, '[ \t\n\r]+', ' ', 'g')"

#: CTE `evaluated (conv_id, dominant_topic, evaluation)` and its fields in `assessed`.
_ASSESSED_SQL = rf"""
evaluated AS (
  SELECT doc_id AS conv_id, CAST(doc_id % 7 + 1 AS INTEGER) AS dominant_topic, text,
    CASE WHEN doc_id % 7 + 1 = 7 OR doc_id % 20 = 0 THEN ''
         WHEN doc_id % 20 = 2 THEN concat_ws(chr(10), {_SCORES_SQL})
         WHEN doc_id % 20 = 3 THEN concat_ws(chr(13) || chr(10), {_SCORES_SQL}, {_REMARK_SQL}, '')
         WHEN doc_id % 20 = 5 THEN concat_ws(chr(10), {_SCORES_SQL}, {_REMARK_SQL} || ' : more: text')
         WHEN doc_id % 20 = 6 THEN concat_ws(chr(10), {_line_sql(1)}, {_line_sql(2)})
         ELSE concat_ws(chr(10), {_SCORES_SQL}, {_REMARK_SQL}) END AS evaluation
  FROM documents
),
split_lines AS (SELECT *, string_split(evaluation, chr(10)) AS l FROM evaluated),
read_numbers AS (
  SELECT *, {", ".join(
    f"CASE WHEN regexp_full_match(string_split(l[{i}], ':')[2], '[ \\r\\t]*[+-]?[0-9]+[ \\r\\t]*') "
    f"THEN TRY_CAST(trim(string_split(l[{i}], ':')[2], chr(13) || ' ') AS INTEGER) END AS n{i}"
    for i in range(1, 6))},
    [x FOR x IN l IF contains(x, 'Assessment:')][1] AS remark
  FROM split_lines
),
numbered AS (
  SELECT conv_id, dominant_topic, text, remark, n1 AS relevance,
    CASE WHEN n1 IS NOT NULL THEN n2 END AS accuracy,
    CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN n3 END AS completeness,
    CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL AND n3 IS NOT NULL THEN n4 END AS conciseness,
    CASE WHEN n1 + n2 + n3 + n4 IS NOT NULL THEN n5 END AS tone
  FROM read_numbers
),
{LABELS_SQL},
assessed AS (
  SELECT conv_id, dominant_topic, coalesce(topic_label, 'Unknown Topic') AS topic_label, text,
    relevance, accuracy, completeness, conciseness, tone,
    CASE WHEN tone IS NOT NULL THEN
      (relevance + accuracy + completeness + conciseness + tone) / 5.0::DOUBLE END AS average_score,
    CASE WHEN tone IS NOT NULL THEN
      trim(substring(remark, position(':' IN remark) + 1), chr(13) || chr(10) || chr(9) || ' ')
      END AS assessment,
    coalesce(relevance NOT BETWEEN 1 AND 5, false) OR coalesce(accuracy NOT BETWEEN 1 AND 5, false)
      OR coalesce(completeness NOT BETWEEN 1 AND 5, false)
      OR coalesce(conciseness NOT BETWEEN 1 AND 5, false)
      OR coalesce(tone NOT BETWEEN 1 AND 5, false) AS out_of_range
  FROM numbered LEFT JOIN labels_given ON topic = dominant_topic
)"""

_FIELDS = (
    "relevance, accuracy, completeness, conciseness, tone, average_score, assessment, out_of_range"
)


def assigned(spark: SparkSession, sf_dir: str, texts=plain_documents) -> DataFrame:
    """Documents with a topic by key and its label; topic 7 has none."""
    docs = texts(spark, sf_dir).withColumn("dominant_topic", dealt_topic())
    return labels.attach_labels(docs, label_table(spark))


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.parse_evaluations(
        assigned(spark, sf_dir, documents).withColumn("evaluation", evaluation_text())
    )


@query("parse_evaluations", f"WITH {_ASSESSED_SQL} SELECT conv_id, {_FIELDS} FROM assessed")
def parse_evaluations(spark, sf_dir):
    return assessed(spark, sf_dir).select("conv_id", *_FIELDS.split(", "))


def text_scorer(batches):
    """Stands in for a model: answers every request from its own length."""
    for batch in batches:
        def answer(request: str) -> str:
            n = len(request)
            lines = [f"{i}: {1 + (n * i + i) % 5}" for i in range(1, 6)]
            return "\n".join([*lines, f"Assessment: {n} characters"])

        yield batch.assign(evaluation=batch["request"].map(answer))


@query(
    "assess",
    f"""WITH {LABELS_SQL},
    sized AS (
      SELECT doc_id AS conv_id, CAST(doc_id % 7 + 1 AS INTEGER) AS dominant_topic,
             coalesce(topic_label, 'Unknown Topic') AS topic_label, text,
             length('Topic: ' || coalesce(topic_label, 'Unknown Topic') || chr(10)
                    || 'Conversation: ' || text) AS n
      FROM documents LEFT JOIN labels_given ON topic = doc_id % 7 + 1),
    scored AS (
      SELECT *, {", ".join(
        f"CAST(1 + (n * {i} + {i}) % 5 AS INTEGER) AS {name}" for i, name in enumerate(
          ("relevance", "accuracy", "completeness", "conciseness", "tone"), start=1))}
      FROM sized)
    SELECT conv_id, dominant_topic, topic_label, relevance, accuracy, completeness, conciseness, tone,
      (relevance + accuracy + completeness + conciseness + tone) / 5.0::DOUBLE AS average_score,
      n || ' characters' AS assessment FROM scored""",
)
def assess(spark, sf_dir):
    done = assessment.assess(assigned(spark, sf_dir, documents), text_scorer, CONTEXT)
    return done.drop("conversation", "out_of_range")


_ANSWERS_SQL = f"""WITH {LABELS_SQL},
    sized AS (
      SELECT doc_id AS conv_id, length('Topic: ' || coalesce(topic_label, 'Unknown Topic') || chr(10)
        || 'Conversation: ' || text) AS n
      FROM documents LEFT JOIN labels_given ON topic = doc_id % 7 + 1)
    SELECT conv_id, {" || ".join(f"'{i}: ' || (1 + (n * {i} + {i}) % 5) || chr(10)" for i in range(1, 6))}
      || 'Assessment: ' || n || ' characters' AS evaluation FROM sized"""


@query("score_with_callable", _ANSWERS_SQL)
def score_with_callable(spark, sf_dir):
    prepared = assessment.evaluation_prompts(assigned(spark, sf_dir), CONTEXT)
    return assessment.score_with(prepared, text_scorer).select("conv_id", "evaluation")


def failing_scorer(batches):
    """The same, but it gives up on a batch that holds a request of certain lengths."""
    for batch in batches:
        if (batch["request"].str.len() % 7 == 3).any():
            raise ValueError("the model gave up")
        yield from text_scorer(iter([batch]))


@query("score_resumed", _ANSWERS_SQL)
def score_resumed(spark, sf_dir):
    """Scoring that was left with unanswered rows, taken up again with a scorer that answers all."""
    area = StagingArea(spark)
    prepared = area.stage(assessment.evaluation_prompts(assigned(spark, sf_dir), CONTEXT), "prepared")
    answers = area.path("answers")
    scoring.score_resumable(prepared, failing_scorer, answers, rounds=2, ask_rows=4)
    return scoring.score_resumable(prepared, text_scorer, answers).select("conv_id", "evaluation")


@query(
    "eval_prompts",
    f"""WITH {LABELS_SQL}
    SELECT doc_id AS conv_id, {quoted(prompts.evaluation_instruction(CONTEXT))} AS instruction,
           'Topic: ' || coalesce(topic_label, 'Unknown Topic') || chr(10) || 'Conversation: ' || text
           AS request
    FROM documents LEFT JOIN labels_given ON topic = doc_id % 7 + 1""",
)
def eval_prompts(spark, sf_dir):
    prepared = assessment.evaluation_prompts(assigned(spark, sf_dir), CONTEXT)
    return prepared.select("conv_id", "instruction", "request")


# --- joins to topics -----------------------------------------------------------------------------


@query(
    "map_labels",
    f"""WITH {LABELS_SQL}
    SELECT doc_id AS conv_id, CAST(doc_id % 7 + 1 AS INTEGER) AS dominant_topic,
           coalesce(topic_label, 'Unknown Topic') AS topic_label
    FROM documents LEFT JOIN labels_given ON topic = doc_id % 7 + 1""",
)
def map_labels(spark, sf_dir):
    return assigned(spark, sf_dir).select("conv_id", "dominant_topic", "topic_label")


_TOPICS_SQL = f"""{TOKS_SQL}, {VOCAB_SQL}, {DEALT_SQL},
topics AS (
  SELECT topic, 'Topic' || topic AS topic_key, list(term ORDER BY rank) AS terms
  FROM dealt GROUP BY topic
)"""


def dealt_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_table(dealt_terms(spark, sf_dir))


@query(
    "topic_desc",
    f"""WITH {_TOPICS_SQL}
    SELECT doc_id AS conv_id, CAST(doc_id % 7 + 1 AS INTEGER) AS dominant_topic,
           array_to_string(terms, ', ') AS topic_desc
    FROM documents LEFT JOIN topics ON topic = doc_id % 7 + 1""",
)
def topic_desc(spark, sf_dir):
    docs = plain_documents(spark, sf_dir).select("conv_id", dealt_topic().alias("dominant_topic"))
    return labels.attach_terms(docs, dealt_topics(spark, sf_dir))


# --- names ---------------------------------------------------------------------------------------

_CAPS = "[upper(substring(w, 1, 1)) || lower(substring(w, 2)) FOR w IN string_split({0}, ' ') IF w <> '']"
_NAMED_SQL = f"""
bases AS (
  SELECT *, array_to_string(
    {_CAPS.format("translate(array_to_string(terms[1:3], ' '), '_', ' ')")}, ' ') AS base FROM topics
),
placed AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY topic) AS place FROM bases),
named AS (
  SELECT topic, topic_key, terms,
    CASE WHEN place = 1 THEN base
         ELSE base || ' ' || array_to_string({_CAPS.format("translate(terms[place + 2], '_', ' ')")}, ' ')
    END AS topic_label
  FROM placed
)"""


@query("topic_labels", f"WITH {_TOPICS_SQL}, {_NAMED_SQL} SELECT topic, topic_label FROM named")
def topic_labels(spark, sf_dir):
    return labels.keyword_labels(dealt_topics(spark, sf_dir))


def _parts_sql(parts: tuple[str, str], middle: str) -> str:
    return f"{quoted(parts[0])} || {middle} || {quoted(parts[1])}"


@query(
    "label_prompts",
    f"""WITH {_TOPICS_SQL}, {_NAMED_SQL},
    used AS (
      SELECT *, coalesce(string_agg(topic_label, ', ') OVER (
        ORDER BY topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'none') AS used FROM named)
    SELECT topic, topic_key, {_parts_sql(prompts.naming_parts(CONTEXT), "used")} AS instruction,
           'Keywords: ' || array_to_string(terms, ', ') || '. Name this topic.' AS request
    FROM used""",
)
def label_prompts(spark, sf_dir):
    found = dealt_topics(spark, sf_dir)
    return labels.naming_prompts(found, CONTEXT, labels.keyword_labels(found))


@query(
    "review_prompts",
    f"""WITH {_TOPICS_SQL}, {_NAMED_SQL},
    lines AS (
      SELECT string_agg(topic_key || ' is named ' || topic_label || ', keywords: '
                        || array_to_string(terms[1:10], ', '), chr(10) ORDER BY topic) AS lines
      FROM named)
    SELECT topic, topic_key, {_parts_sql(prompts.review_parts(CONTEXT), "lines")} AS instruction,
           'Give the final name of ' || topic_key || '. Reply with the name only.' AS request
    FROM named, lines""",
)
def review_prompts(spark, sf_dir):
    found = dealt_topics(spark, sf_dir)
    return labels.review_prompts(found, labels.keyword_labels(found), CONTEXT)


def echo_namer(instruction: str, request: str) -> str:
    """Stands in for a model: names a topic by its first keywords, and keeps names on review."""
    if request.startswith("Keywords: "):
        keywords = request.removeprefix("Keywords: ").removesuffix(". Name this topic.")
        return " ".join(keywords.split(", ")[:2])
    topic_key = request.removeprefix("Give the final name of ").split(".")[0]
    line = next(text for text in instruction.split("\n") if text.startswith(f"{topic_key} is named "))
    return line.removeprefix(f"{topic_key} is named ").split(", keywords: ")[0]


@query(
    "name_topics_with_callable",
    f"""WITH {_TOPICS_SQL}
    SELECT topic, array_to_string({_CAPS.format("array_to_string(terms[1:2], ' ')")}, ' ') AS topic_label
    FROM topics""",
)
def name_topics_with_callable(spark, sf_dir):
    return labels.name_topics(dealt_topics(spark, sf_dir), echo_namer, CONTEXT)


# --- reports -------------------------------------------------------------------------------------


@query(
    "topic_distribution",
    f"""WITH {LABELS_SQL}, counts AS (
      SELECT CAST(doc_id % 7 + 1 AS INTEGER) AS dominant_topic,
             coalesce(topic_label, 'Unknown Topic') AS topic_label, count(*) AS count
      FROM documents LEFT JOIN labels_given ON topic = doc_id % 7 + 1 GROUP BY 1, 2)
    SELECT dominant_topic, topic_label, count,
           round(count::DOUBLE / (SELECT sum(count) FROM counts)::DOUBLE * 100, 6) AS percentage,
           dominant_topic || ' ' || topic_label AS label FROM counts""",
)
def topic_distribution(spark, sf_dir):
    return insights.topic_distribution(assigned(spark, sf_dir)).withColumns(rounded("percentage"))


@query(
    "topic_count",
    f"""WITH {LABELS_SQL} SELECT count(DISTINCT doc_id % 7 + 1) AS n_topics,
      count(DISTINCT coalesce(topic_label, 'Unknown Topic')) AS n_labels
      FROM documents LEFT JOIN labels_given ON topic = doc_id % 7 + 1""",
)
def topic_count(spark, sf_dir):
    return insights.topic_count(assigned(spark, sf_dir))


_MEANS = ("relevance", "accuracy", "completeness", "conciseness", "tone")
_MEANS_SQL = ", ".join(f"round(avg({name}), 6) AS {name}" for name in _MEANS)
_SCORES_BY_LABEL_SQL = (
    f"WITH {_ASSESSED_SQL} SELECT topic_label, round(avg(average_score), 6) AS average_score "
    "FROM assessed GROUP BY topic_label"
)


@query("topic_scores", _SCORES_BY_LABEL_SQL)
def topic_scores(spark, sf_dir):
    return insights.topic_scores(assessed(spark, sf_dir)).withColumns(rounded("average_score"))


@query(
    "topic_criteria_means",
    f"WITH {_ASSESSED_SQL} SELECT dominant_topic, topic_label, {_MEANS_SQL} FROM assessed "
    "GROUP BY dominant_topic, topic_label",
)
def topic_criteria_means(spark, sf_dir):
    means = insights.criteria_means(assessed(spark, sf_dir), by_label=False)
    return means.withColumns(rounded(*_MEANS))


@query(
    "worst_topics",
    f"{_SCORES_BY_LABEL_SQL} ORDER BY avg(average_score) ASC NULLS LAST, topic_label LIMIT 3",
)
def worst_topics(spark, sf_dir):
    scores = insights.topic_scores(assessed(spark, sf_dir))
    return insights.select_topics(scores, 3, "worst").withColumns(rounded("average_score"))


@query(
    "best_topics",
    f"{_SCORES_BY_LABEL_SQL} ORDER BY avg(average_score) DESC NULLS LAST, topic_label LIMIT 3",
)
def best_topics(spark, sf_dir):
    scores = insights.topic_scores(assessed(spark, sf_dir))
    return insights.select_topics(scores, 3, "best").withColumns(rounded("average_score"))


_DIGEST_SQL = """
digests AS (
  SELECT topic_label, substring(string_agg(assessment, ' ' ORDER BY conv_id), 1, 5000) AS digest
  FROM assessed WHERE assessment IS NOT NULL GROUP BY topic_label
)"""


@query("assessment_digest", f"WITH {_ASSESSED_SQL}, {_DIGEST_SQL} SELECT topic_label, digest FROM digests")
def assessment_digest(spark, sf_dir):
    return insights.assessment_digest(assessed(spark, sf_dir))


_INSIGHT_SQL = f"""WITH {_ASSESSED_SQL}, {_DIGEST_SQL},
means AS (
  SELECT topic_label, avg(average_score) AS average_score,
         {", ".join(f"avg({name}) AS {name}" for name in _MEANS)}
  FROM assessed GROUP BY topic_label
),
chosen AS (SELECT * FROM means ORDER BY average_score ASC NULLS LAST, topic_label LIMIT 3),
lowest AS (SELECT *, least({", ".join(_MEANS)}) AS weakest_mean FROM chosen)"""
_WEAKEST_SQL = "CASE " + " ".join(
    f"WHEN {name} = weakest_mean THEN '{name}'" for name in _MEANS
) + " END"


@query(
    "topic_insights",
    f"""{_INSIGHT_SQL}
    SELECT topic_label, round(average_score, 6) AS average_score,
           {", ".join(f"round({name}, 6) AS {name}" for name in _MEANS)}, digest,
           {_WEAKEST_SQL} AS weakest_criterion, round(weakest_mean, 6) AS weakest_mean
    FROM lowest LEFT JOIN digests USING (topic_label)""",
)
def topic_insights(spark, sf_dir):
    found = insights.topic_insights(assessed(spark, sf_dir), 3, "worst")
    return found.withColumns(rounded("average_score", *_MEANS, "weakest_mean"))


@query(
    "summary_prompts",
    f"""{_INSIGHT_SQL}
    SELECT topic_label, {quoted(prompts.summary_instruction(CONTEXT))} AS instruction,
           'Topic: ' || topic_label || chr(10) || 'Assessments: ' || coalesce(digest, '') AS request
    FROM lowest LEFT JOIN digests USING (topic_label)""",
)
def summary_prompts(spark, sf_dir):
    found = insights.topic_insights(assessed(spark, sf_dir), 3, "worst")
    return insights.summary_prompts(found, CONTEXT).select("topic_label", "instruction", "request")


@query(
    "docs_per_topic",
    """SELECT CAST(doc_id % 7 + 1 AS INTEGER) AS dominant_topic, doc_id // 256 AS block,
           count(text) AS n_texts, string_agg(text, ' ' ORDER BY doc_id) AS text
    FROM documents GROUP BY 1, 2""",
)
def docs_per_topic(spark, sf_dir):
    docs = plain_documents(spark, sf_dir).withColumn("dominant_topic", dealt_topic())
    return insights.texts_per_topic(docs, "dominant_topic", "conversation")

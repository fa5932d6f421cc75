"""Phrases, vocabularies, vectors and coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterloom.catalog.registry import (
    STOP_SQL, TOKS_SQL, VOCAB_SQL, dealt_terms, documents, light_sql, normalized, plain_documents, query,
    rounded, table,
)
from chatterloom.operators import coherence, insights, normalize, phrases, topics, vocabulary
from chatterloom.sources.tables import spread

# --- phrases -----------------------------------------------------------------------------------

_PHRASE_SQL = """
neighbours AS (
  SELECT conv_id, pos, token, lead(token) OVER (PARTITION BY conv_id ORDER BY pos) AS next_token
  FROM long
),
pair_n AS (
  SELECT token AS a, next_token AS b, count(*) AS n_ab FROM neighbours
  WHERE next_token IS NOT NULL GROUP BY token, next_token
),
word_n AS (SELECT token, count(*) AS n FROM long GROUP BY token),
size AS (SELECT (SELECT count(*) FROM word_n) + (SELECT count(*) FROM pair_n) AS v),
phrases AS (
  SELECT a, b, n_ab, (n_ab - 20)::DOUBLE * v / (wa.n::DOUBLE * wb.n::DOUBLE) AS score
  FROM pair_n JOIN word_n wa ON wa.token = a JOIN word_n wb ON wb.token = b, size
  WHERE (n_ab - 20)::DOUBLE * v / (wa.n::DOUBLE * wb.n::DOUBLE) > 10
)"""


@query("phrase_scores", f"WITH {TOKS_SQL}, {_PHRASE_SQL} SELECT a, b, n_ab, round(score, 6) AS score FROM phrases")
def phrase_scores(spark, sf_dir):
    scored = phrases.score_phrases(normalized(spark, sf_dir))
    return scored.withColumns(rounded("score"))


def _rewritten_sql(found: str) -> str:
    """Greedy rewriting by numbering the members of each run of phrase starts."""
    return f"""
flagged AS (
  SELECT n.*, coalesce((token, next_token) IN (SELECT (a, b) FROM {found}), false) AS starts
  FROM neighbours n
),
runs AS (
  SELECT *, pos - row_number() OVER (PARTITION BY conv_id, starts ORDER BY pos) AS run FROM flagged
),
placed AS (
  SELECT *, starts AND row_number() OVER (PARTITION BY conv_id, starts, run ORDER BY pos) % 2 = 1
         AS fuses FROM runs
),
roles AS (
  SELECT *, coalesce(lag(fuses) OVER (PARTITION BY conv_id ORDER BY pos), false) AS taken FROM placed
)
SELECT conv_id,
       string_agg(CASE WHEN fuses THEN token || '_' || next_token ELSE token END, ' ' ORDER BY pos)
         FILTER (NOT taken) AS normalized
FROM roles GROUP BY conv_id"""


@query("apply_phrases", f"WITH {TOKS_SQL}, {_PHRASE_SQL}, {_rewritten_sql('phrases')}")
def apply_phrases(spark, sf_dir):
    corpus = normalized(spark, sf_dir)
    fused = phrases.apply_phrases(corpus, phrases.score_phrases(corpus))
    return normalize.token_text(fused).select("conv_id", "normalized")


_FREQUENT_SQL = "frequent AS (SELECT a, b, n_ab FROM pair_n WHERE n_ab >= 20)"


#: Bytes of texts whose different pairs a task can count in memory; beyond that it would sort them.
PAIR_PART_BYTES = 16 << 20


@query("frequent_bigrams", f"WITH {TOKS_SQL}, {_PHRASE_SQL}, {_FREQUENT_SQL} SELECT a, b, n_ab FROM frequent")
def frequent_bigrams(spark, sf_dir):
    docs = spread(plain_documents(spark, sf_dir), "conv_id", "conversation", part_bytes=PAIR_PART_BYTES)
    return phrases.frequent_pairs(normalize.normalize_tokens(docs))


@query(
    "fuse_frequent_bigrams",
    f"WITH {TOKS_SQL}, {_PHRASE_SQL}, {_FREQUENT_SQL}, {_rewritten_sql('frequent')}",
)
def fuse_frequent_bigrams(spark, sf_dir):
    corpus = normalized(spark, sf_dir)
    fused = phrases.apply_phrases(corpus, phrases.frequent_pairs(corpus))
    return normalize.token_text(fused).select("conv_id", "normalized")


# --- vocabularies ------------------------------------------------------------------------------


@query("vocabulary", f"WITH {TOKS_SQL}, {VOCAB_SQL} SELECT term, term_id, df, cf FROM vocab")
def vocabulary_query(spark, sf_dir):
    return vocabulary.build_vocabulary(normalized(spark, sf_dir))


@query(
    "bag_of_words",
    f"""WITH {TOKS_SQL}, {VOCAB_SQL}
    SELECT conv_id, term_id, count(*) AS n FROM long JOIN vocab ON token = term
    GROUP BY conv_id, term_id""",
)
def bag_of_words(spark, sf_dir):
    corpus = normalized(spark, sf_dir)
    return vocabulary.bag_of_words(corpus, vocabulary.build_vocabulary(corpus))


@query(
    "corpus_stats",
    f"""WITH {TOKS_SQL}, {VOCAB_SQL}
    SELECT (SELECT count(*) FROM documents) AS n_texts,
           (SELECT count(*) FROM documents WHERE text IS NULL) AS n_null_texts,
           (SELECT count(*) FROM toks) AS n_documents,
           (SELECT count(*) FROM long) AS n_tokens,
           (SELECT count(*) FROM vocab) AS n_terms""",
)
def corpus_stats(spark, sf_dir):
    corpus = normalize.normalize_tokens(documents(spark, sf_dir), keep_empty=True)
    return vocabulary.corpus_statistics(corpus, vocabulary.build_vocabulary(corpus))


@query(
    "ngram_vocabulary",
    f"""WITH kept AS (
      SELECT doc_id AS conv_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM (
        SELECT doc_id, [t FOR t IN {light_sql()} IF length(t) > 1 AND t NOT IN {STOP_SQL}] AS tokens
        FROM documents)),
    grams AS (
      SELECT conv_id, token AS term FROM kept
      UNION ALL
      SELECT conv_id, token || ' ' || lead(token) OVER (PARTITION BY conv_id ORDER BY pos) FROM kept),
    counts AS (
      SELECT term, count(DISTINCT conv_id) AS df, count(*) AS cf FROM grams
      WHERE term IS NOT NULL GROUP BY term)
    SELECT term, df, cf FROM counts
    WHERE df >= 5 AND df <= 0.9::DOUBLE * (SELECT count(DISTINCT conv_id) FROM kept)""",
)
def ngram_vocabulary(spark, sf_dir):
    grams = vocabulary.ngram_tokens(normalize.normalize_light(documents(spark, sf_dir)))
    return vocabulary.frequent_terms(grams, 5, 0.9, keep_terms=None).select("term", "df", "cf")


@query(
    "class_tfidf",
    f"""WITH {TOKS_SQL},
    counts AS (SELECT lang, token AS term, count(*) AS n FROM long GROUP BY lang, token),
    sizes AS (SELECT lang, sum(n) AS class_words FROM counts GROUP BY lang),
    totals AS (SELECT term, sum(n) AS term_total FROM counts GROUP BY term)
    SELECT lang, term, n, round(n::DOUBLE / class_words::DOUBLE
      * ln(1 + (SELECT avg(class_words) FROM sizes)::DOUBLE / term_total::DOUBLE), 6) AS weight
    FROM counts JOIN sizes USING (lang) JOIN totals USING (term)""",
)
def class_tfidf(spark, sf_dir):
    weights = vocabulary.class_term_weights(normalized(spark, sf_dir, "lang"), "lang")
    return weights.withColumns(rounded("weight"))


@query(
    "class_top_terms",
    f"""WITH {TOKS_SQL},
    counts AS (SELECT lang, token AS term, count(*) AS n FROM long GROUP BY lang, token),
    sizes AS (SELECT lang, sum(n) AS class_words FROM counts GROUP BY lang),
    totals AS (SELECT term, sum(n) AS term_total FROM counts GROUP BY term),
    weights AS (
      SELECT lang, term, n, n::DOUBLE / class_words::DOUBLE
        * ln(1 + (SELECT avg(class_words) FROM sizes)::DOUBLE / term_total::DOUBLE) AS weight
      FROM counts JOIN sizes USING (lang) JOIN totals USING (term))
    SELECT lang, rank, term, n FROM (
      SELECT lang, term, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INTEGER) AS rank FROM weights
    ) WHERE rank <= 10""",
)
def class_top_terms(spark, sf_dir):
    weights = vocabulary.class_term_weights(normalized(spark, sf_dir, "lang"), "lang")
    return vocabulary.top_class_terms(weights, "lang", 10).select("lang", "rank", "term", "n")


# --- coherence of given topics -------------------------------------------------------------------


def _models_sql(counts) -> str:
    """CTE `topics (model, topic, rank, term)`: 40 common terms dealt out to 2, 3, ... topics."""
    models = ", ".join(f"({k})" for k in counts)
    return f"""
topics AS (
  SELECT CAST(k AS INTEGER) AS model, CAST(term_id % k + 1 AS INTEGER) AS topic,
         CAST(term_id // k + 1 AS INTEGER) AS rank, term
  FROM vocab, (VALUES {models}) m(k) WHERE term_id < 40
)"""


_UMASS_SQL = """
present AS (
  SELECT DISTINCT conv_id, token FROM long WHERE token IN (SELECT term FROM topics)
),
doc_n AS (SELECT token, count(*) AS n FROM present GROUP BY token),
both_n AS (
  SELECT x.token AS u, y.token AS w, count(*) AS n FROM present x JOIN present y USING (conv_id)
  GROUP BY x.token, y.token
),
umass AS (
  SELECT t.model, t.topic, avg(ln((coalesce(n.n, 0) + 1.0::DOUBLE) / d.n)) AS u_mass
  FROM topics t JOIN topics s ON s.model = t.model AND s.topic = t.topic AND s.rank > t.rank
  JOIN doc_n d ON d.token = t.term
  LEFT JOIN both_n n ON n.u = t.term AND n.w = s.term
  GROUP BY t.model, t.topic
)"""

_CV_SQL = """
sizes AS (SELECT conv_id, greatest(1, len(tokens) - 109) AS n FROM toks),
spans AS (
  SELECT conv_id, token, pos, greatest(0, pos - 109) AS s, least(pos, n - 1) AS e
  FROM long JOIN sizes USING (conv_id) WHERE token IN (SELECT term FROM topics)
),
marked AS (
  SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY conv_id, token ORDER BY pos) THEN 0 ELSE 1 END
         AS opens FROM spans
),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY conv_id, token ORDER BY pos) AS g FROM marked
),
cover AS (
  SELECT conv_id, token, min(s) AS s, max(e) AS e FROM numbered GROUP BY conv_id, token, g
),
pair_words AS (
  SELECT DISTINCT x.term AS w, y.term AS u FROM topics x JOIN topics y
  ON x.model = y.model AND x.topic = y.topic
),
shared AS (
  SELECT w, u, sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) AS n
  FROM pair_words JOIN cover a ON a.token = w JOIN cover b ON b.token = u AND b.conv_id = a.conv_id
  WHERE least(a.e, b.e) >= greatest(a.s, b.s)
  GROUP BY w, u
),
total AS (SELECT sum(n)::DOUBLE AS n FROM sizes),
npmi AS (
  SELECT x.model, x.topic, x.term AS w, y.term AS u,
         ln((coalesce(j.n, 0) / total.n + 1e-12::DOUBLE) / ((a.n / total.n) * (b.n / total.n)))
           / -ln(coalesce(j.n, 0) / total.n + 1e-12::DOUBLE) AS v
  FROM topics x JOIN topics y ON x.model = y.model AND x.topic = y.topic
  JOIN shared a ON a.w = x.term AND a.u = x.term
  JOIN shared b ON b.w = y.term AND b.u = y.term
  LEFT JOIN shared j ON j.w = x.term AND j.u = y.term, total
),
sums AS (SELECT model, topic, u, sum(v) AS v FROM npmi GROUP BY model, topic, u),
cosines AS (
  SELECT n.model, n.topic, n.w,
         sum(n.v * s.v) / (sqrt(sum(n.v * n.v)) * sqrt(sum(s.v * s.v))) AS c
  FROM npmi n JOIN sums s ON s.model = n.model AND s.topic = n.topic AND s.u = n.u
  GROUP BY n.model, n.topic, n.w
),
cv AS (SELECT model, topic, avg(c) AS c_v FROM cosines GROUP BY model, topic)"""

_GIVEN_COUNTS = (2, 3, 4, 5)


def _given_models(spark, sf_dir, counts):
    """Topic rows `(model, topic, rank, term)` of the same 40 terms dealt out in several ways."""
    terms = dealt_terms(spark, sf_dir, 1, 40).orderBy("rank").collect()
    return [
        (k, index % k + 1, index // k + 1, row["term"])
        for k in counts
        for index, row in enumerate(terms)
    ]


@query(
    "coherence_umass",
    f"""WITH {TOKS_SQL}, {VOCAB_SQL}, {_models_sql([4])}, {_UMASS_SQL}
    SELECT topic, round(u_mass, 6) AS u_mass FROM umass""",
)
def coherence_umass(spark, sf_dir):
    pairs = coherence.topic_pairs(normalized(spark, sf_dir), _given_models(spark, sf_dir, [4]))
    return coherence.umass(pairs).select("topic", F.round("u_mass", 6).alias("u_mass"))


@query(
    "coherence_cv",
    f"""WITH {TOKS_SQL}, {VOCAB_SQL}, {_models_sql([4])}, {_CV_SQL}
    SELECT topic, round(c_v, 6) AS c_v FROM cv""",
)
def coherence_cv(spark, sf_dir):
    pairs = coherence.topic_pairs(normalized(spark, sf_dir), _given_models(spark, sf_dir, [4]))
    return coherence.c_v(pairs).select("topic", F.round("c_v", 6).alias("c_v"))


@query(
    "best_k",
    f"""WITH {TOKS_SQL}, {VOCAB_SQL}, {_models_sql(_GIVEN_COUNTS)}, {_CV_SQL}
    SELECT model AS num_topics, round(avg(c_v), 4) AS c_v FROM cv GROUP BY model
    ORDER BY 2 DESC, 1 LIMIT 1""",
)
def best_k(spark, sf_dir):
    given = _given_models(spark, sf_dir, _GIVEN_COUNTS)
    scores = coherence.model_coherence(normalized(spark, sf_dir), given)
    return coherence.best_topic_count(
        scores.select(F.col("model").alias("num_topics"), "c_v")
    )


@query(
    "coherence_chart",
    f"""WITH {TOKS_SQL}, {VOCAB_SQL}, {_models_sql(_GIVEN_COUNTS)}, {_CV_SQL},
    scores AS (SELECT model AS num_topics, round(avg(c_v), 4) AS c_v FROM cv GROUP BY model)
    SELECT num_topics, c_v, num_topics = (SELECT num_topics FROM scores ORDER BY c_v DESC, num_topics LIMIT 1) AS is_best,
      CAST(0.5 AS DOUBLE) AS reference_line FROM scores""",
)
def coherence_chart(spark, sf_dir):
    given = _given_models(spark, sf_dir, _GIVEN_COUNTS)
    scores = coherence.model_coherence(normalized(spark, sf_dir), given)
    return insights.coherence_chart(scores.select(F.col("model").alias("num_topics"), F.round("c_v", 4).alias("c_v")))


@query(
    "compare_given_models",
    f"""WITH {TOKS_SQL}, {VOCAB_SQL}, {_models_sql(_GIVEN_COUNTS)}, {_CV_SQL}
    SELECT 'given ' || model AS model, CAST(model AS INTEGER) AS n_topics, round(avg(c_v), 4) AS c_v FROM cv GROUP BY model""",
)
def compare_given_models(spark, sf_dir):
    """The comparison of models, over topics that SQL can deal out too."""
    given = spark.createDataFrame(_given_models(spark, sf_dir, _GIVEN_COUNTS), "model int, topic int, rank int, term string")
    models = {f"given {k}": given.where(F.col("model") == k) for k in _GIVEN_COUNTS}
    return coherence.model_comparison(normalized(spark, sf_dir), models).drop("train_seconds")


# --- vectors -----------------------------------------------------------------------------------

_ARGMAX_SQL = """
argmax AS (
  SELECT vec_id, label, CASE WHEN list_max(embedding) > 0
           THEN CAST(list_position(embedding, list_max(embedding)) AS INTEGER) END AS dominant_topic,
         CASE WHEN list_max(embedding) > 0 THEN list_max(embedding)::DOUBLE END AS share
  FROM embeddings
)"""


def _strongest(spark, sf_dir):
    place, value = topics.strongest_entry(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", place.alias("dominant_topic"), value.cast("double").alias("share")
    )


@query(
    "argmax_vector",
    f"WITH {_ARGMAX_SQL} SELECT vec_id, dominant_topic, round(share, 6) AS share FROM argmax",
)
def argmax_vector(spark, sf_dir):
    return _strongest(spark, sf_dir).select("vec_id", "dominant_topic", F.round("share", 6).alias("share"))


@query(
    "category_topic_purity",
    f"""WITH {_ARGMAX_SQL},
    counts AS (SELECT label, dominant_topic, count(*) AS n FROM argmax GROUP BY ALL),
    sizes AS (
      SELECT dominant_topic, sum(n) AS topic_n, max(n) AS main_n FROM counts GROUP BY dominant_topic)
    SELECT label, counts.dominant_topic, n, round(n / topic_n::DOUBLE, 6) AS topic_share,
           round((SELECT sum(main_n)::DOUBLE / sum(topic_n)::DOUBLE FROM sizes), 6) AS purity
    FROM counts JOIN sizes ON counts.dominant_topic IS NOT DISTINCT FROM sizes.dominant_topic""",
)
def category_topic_purity(spark, sf_dir):
    found = topics.category_purity(_strongest(spark, sf_dir), "label", "dominant_topic")
    return found.withColumns(rounded("topic_share", "purity"))

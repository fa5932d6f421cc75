"""Vocabulary, coherence and topic models."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterloom.config import Settings
from chatterloom.operators import clusters, coherence, normalize, topics, vocabulary
from chatterloom.sources.tables import read_parquet


def corpus(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "conv_id long, tokens array<string>")


def test_vocabulary_cuts_at_the_limit_by_document_frequency(spark):
    docs = [[f"t{j}" for j in range(i % 7 + 1)] + ["t0"] for i in range(70)]
    full = vocabulary.build_vocabulary(corpus(spark, docs), 5, 1.0).collect()
    assert [r["term"] for r in sorted(full, key=lambda r: r["term_id"])] == [f"t{j}" for j in range(7)]
    assert {r["term"]: (r["df"], r["cf"]) for r in full}["t0"] == (70, 140)
    short = vocabulary.build_vocabulary(corpus(spark, docs), 5, 0.95, keep_terms=3).collect()
    assert {r["term"] for r in short} == {"t1", "t2", "t3"}


def test_vectors_use_the_ids_of_the_vocabulary(spark):
    docs = corpus(spark, [["a", "b", "a"], ["b"], [], ["z"]])
    vocab = vocabulary.build_vocabulary(docs, 1, 1.0)
    ids = {r["term"]: r["term_id"] for r in vocab.collect()}
    model = vocabulary.fit_vectorizer(docs, 1, 1.0)
    assert [ids[term] for term in model.vocabulary] == list(range(len(ids)))
    long = {(r["conv_id"], r["term_id"]): r["n"] for r in vocabulary.bag_of_words(docs, vocab).collect()}
    for row in model.transform(docs).collect():
        vector = row["features"]
        for index, value in zip(vector.indices, vector.values):
            assert long.pop((row["conv_id"], int(index))) == value
    assert not long


def brute_counts(docs, words, window):
    n_windows, seen, doc_seen = 0, {}, {}
    for doc in docs:
        if not doc:
            continue
        for pair in itertools.product(set(doc) & words, repeat=2):
            doc_seen[pair] = doc_seen.get(pair, 0) + 1
        for start in range(max(1, len(doc) - window + 1)):
            n_windows += 1
            held = set(doc[start:start + window]) & words
            for pair in itertools.product(held, repeat=2):
                seen[pair] = seen.get(pair, 0) + 1
    return n_windows, seen, doc_seen


def test_window_counts_equal_sliding_windows(spark):
    rng = random.Random(11)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))] for _ in range(120)]
    rows = [(0, 1, 1, "a"), (0, 1, 2, "b"), (0, 1, 3, "c"), (0, 2, 1, "c"), (0, 2, 2, "d")]
    pairs = coherence.topic_pairs(corpus(spark, docs).repartition(3), rows, window=6).collect()
    n_windows, seen, doc_seen = brute_counts(docs, set("abcd"), 6)
    assert len(pairs) == 9 + 4
    for row in pairs:
        key = (row["left_term"], row["right_term"])
        assert row["both_windows"] == seen[key]
        assert row["both_docs"] == doc_seen[key]
        assert row["all_windows"] == n_windows
        assert row["all_docs"] == sum(1 for doc in docs if doc)


def test_scores_follow_the_formulas(spark):
    rng = random.Random(12)
    docs = [[rng.choice("abcdef") for _ in range(20)] for _ in range(50)]
    words = ["a", "b", "c", "d"]
    pairs = coherence.topic_pairs(
        corpus(spark, docs), [(0, 1, i, w) for i, w in enumerate(words, 1)], window=3
    )
    n, seen, doc_seen = brute_counts(docs, set(words), 3)

    def npmi(w, u):
        joint = seen.get((w, u), 0) / n + 1e-12
        return math.log(joint / (seen[w, w] / n * seen[u, u] / n)) / -math.log(joint)

    matrix = np.array([[npmi(w, u) for u in words] for w in words])
    whole = matrix.sum(axis=0)
    cosines = [v @ whole / (np.linalg.norm(v) * np.linalg.norm(whole)) for v in matrix]
    assert coherence.c_v(pairs).first()["c_v"] == pytest.approx(np.mean(cosines))
    expected = [
        math.log((doc_seen.get((w, u), 0) + 1) / doc_seen[w, w])
        for i, w in enumerate(words) for u in words[i + 1:]
    ]
    assert coherence.umass(pairs).first()["u_mass"] == pytest.approx(np.mean(expected))


def test_known_coherence_of_english_documents(spark):
    docs = read_parquet(spark, "/root/testdata/sf0.01/documents.parquet").where("lang = 'en'")
    texts = docs.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("conversation"))
    tokens = normalize.tokenize(texts)
    # Terms have two characters or more; windows are over all tokens.
    longer = tokens.withColumn("tokens", F.filter("tokens", lambda t: F.length(t) > 1))
    vocab = vocabulary.build_vocabulary(longer, 1, 1.0, keep_terms=40).collect()
    rows = [(0, r["term_id"] % 4 + 1, r["term_id"] // 4 + 1, r["term"]) for r in vocab]
    scores = coherence.c_v(coherence.topic_pairs(tokens, rows)).orderBy("topic").collect()
    # Fixed values, found by a window loop.
    assert [round(r["c_v"], 6) for r in scores] == [0.390895, 0.398706, 0.394418, 0.383109]


def planted(spark):
    rng = random.Random(1)
    sides = [[f"sea{i}" for i in range(12)], [f"sky{i}" for i in range(12)]]
    return corpus(spark, [[rng.choice(sides[i % 2]) for _ in range(20)] for i in range(200)])


def test_planted_topics_are_separated_and_repeatable(spark):
    docs = planted(spark).union(corpus(spark, [["unknown"]]).withColumn("conv_id", F.lit(999).cast("long")))
    docs = docs.coalesce(2)
    vectorize = vocabulary.fit_vectorizer(docs, 5, 0.95)
    features = vectorize.transform(docs).cache()
    settings = Settings(passes=8, start_topics=2, end_topics=3, top_terms=5)
    model = topics.fit_topics(features, vectorize.vocabulary, 2, 200, settings)
    sides = [{term[:3] for topic, _r, term, _w in model.term_rows(10) if topic == k} for k in (1, 2)]
    assert sorted(map(sorted, sides)) == [["sea"], ["sky"]]
    found = {r["conv_id"]: r for r in topics.dominant_topics(model, features).collect()}
    assert len(found) == 201
    assert len({found[i]["dominant_topic"] for i in range(0, 200, 2)}) == 1
    assert found[0]["dominant_topic"] != found[1]["dominant_topic"]
    # No known word: no topic, rather than the first one.
    assert found[999]["dominant_topic"] is None and found[999]["contribution_pct"] == 0.0
    again = topics.fit_topics(features, vectorize.vocabulary, 2, 200, settings)
    assert again.term_rows(10) == model.term_rows(10)
    models, table = topics.sweep_topics(
        features, docs, vectorize.vocabulary, 200, settings, with_bound=True
    )
    rows = table.collect()
    assert [r["num_topics"] for r in rows] == [2, 3] and set(models) == {2, 3}
    assert all(r["c_v"] is not None and r["log_perplexity_bound"] < 0 for r in rows)
    features.unpersist()


def test_schedule_visits_every_document_equally_often():
    small = topics.training_schedule(10_000, Settings())
    assert small == (100, 0.2)
    updates, share = topics.training_schedule(10**10, Settings())
    assert updates == 20 * 5 * 10**6 and updates * share == pytest.approx(20)
    assert topics.training_schedule(10, Settings()) == (20, 1.0)


def test_purity_counts_rows_without_a_topic(spark):
    rows = [("a", 1), ("a", 1), ("b", 1), ("a", None), ("b", None), ("b", None), (None, 2)]
    df = spark.createDataFrame(rows, "label string, topic int")
    found = {(r["label"], r["topic"]): r for r in topics.category_purity(df, "label", "topic").collect()}
    assert len(found) == 5
    assert found["b", None]["topic_share"] == pytest.approx(2 / 3)
    assert {round(r["purity"], 6) for r in found.values()} == {round(5 / 7, 6)}


def test_window_counts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(coherence, "CUTS", 5)
    rng = random.Random(13)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))] for _ in range(60)]
    codes = {word: i for i, word in enumerate("abc")}
    hits = [(d, p, codes[w]) for d, doc in enumerate(docs) for p, w in enumerate(doc) if w in codes]
    document, place, word = (np.array(column) for column in zip(*hits))
    per = np.array([max(1, len(doc) - 5) if doc else 0 for doc in docs])
    windows, in_docs = coherence._shared(
        word, document, place, per[document] - 1, (np.cumsum(per) - per)[document], 6, 3
    )
    _n, seen, doc_seen = brute_counts(docs, set("abc"), 6)
    for a, b in itertools.product("abc", repeat=2):
        assert windows[codes[a], codes[b]] == seen[a, b] and in_docs[codes[a], codes[b]] == doc_seen[a, b]


def test_best_count_is_the_first_maximum(spark):
    scores = spark.createDataFrame(
        [(3, 0.4), (4, 0.51234), (5, 0.51231), (6, None)], "num_topics int, c_v double"
    )
    assert coherence.best_topic_count(scores).first()["num_topics"] == 4


def test_clusters_split_directions_and_mark_small_ones(spark):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        base = [[1, 0, 0], [0, 1, 0]][i % 2] if i else [0, 0, -1]
        rows.append((i, [x + rng.gauss(0, 0.01) for x in base]))
    df = spark.createDataFrame(rows, "conv_id long, embedding array<float>")
    found = {
        r["conv_id"]: r["cluster"]
        for r in clusters.cluster_embeddings(df, clusters=3, dimensions=2, min_size=5).collect()
    }
    assert found[0] == clusters.OUTLIER
    assert len({found[i] for i in range(2, 90, 2)}) == 1 and found[1] != found[2]


def test_purity(spark):
    df = spark.createDataFrame(
        [("x", 1), ("x", 1), ("y", 1), ("y", 2), ("y", 2), ("x", 2)], "category string, topic int"
    )
    found = topics.category_purity(df, "category", "topic").collect()
    assert {r["purity"] for r in found} == {4 / 6}
    matrix = topics.category_matrix(df, "category", "topic", [1, 2]).orderBy("category").collect()
    assert [tuple(r) for r in matrix] == [("x", 2, 1), ("y", 1, 2)]

"""Cleaning, tokens, base forms and phrases against plain restatements."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatterloom.functions import text as T
from chatterloom.operators import joins, lemmas, normalize, phrases
from chatterloom.sources import tables


def corpus(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "conv_id long, tokens array<string>")


def tokens_of(df):
    return {row["conv_id"]: row["tokens"] for row in df.collect()}


def test_tokens_follow_the_written_order_of_steps(spark):
    texts = [
        "The 42 Orders of {{Person Name}} été_x x 7b a1 Ünï ½ ٣ {{a\nb}}", "", None, "the a 1 22", "x1 _ __",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "conv_id long, conversation string")
    kept = tokens_of(normalize.normalize_tokens(df, stop_words=["the", "of"], keep_empty=True))
    for i, text in enumerate(texts):
        raw = re.findall(r"\w+", re.sub(r"\{\{.*?\}\}", "", (text or "").lower()))
        expected = [
            t for t in raw if not t.isnumeric() and len(t) > 1 and t not in ("the", "of")
        ]
        assert kept[i] == expected
    assert set(tokens_of(normalize.normalize_tokens(df, stop_words=["the", "of"]))) == {0, 4}
    light = tokens_of(normalize.normalize_light(df))
    assert light[3] == ["the", "a"]


@pytest.mark.parametrize("label", ['"it\'s  a\tBIG deal"', "  ", "ßen élan o'NEIL-smith", "x"])
def test_labels_are_cleaned_like_words(spark, label):
    df = spark.createDataFrame([(label,)], "label string")
    found = df.select(T.clean_label(F.col("label")).alias("x")).first()["x"]
    text = label.replace('"', "").replace("'", "")
    assert found == " ".join(word.capitalize() for word in text.split())


def greedy(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


@pytest.mark.parametrize("inline,limit", [(100, 0), (3, 0), (0, 0), (3, 1 << 20), (0, 1 << 20)])
def test_phrases_fuse_greedily_in_place_and_joined(spark, monkeypatch, inline, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    docs = [[rng.choice("abcd") for _ in range(rng.randrange(0, 25))] for _ in range(200)]
    pairs = {("a", "b"), ("b", "a"), ("b", "b"), ("c", "a"), ("a", "a"), ("d", "c")}
    table = spark.createDataFrame(
        [(a, b, n) for n, (a, b) in enumerate(sorted(pairs))], "a string, b string, n_ab long"
    )
    found = tokens_of(phrases.apply_phrases(corpus(spark, docs), table, inline_phrases=inline))
    assert found == {i: greedy(doc, pairs) for i, doc in enumerate(docs)}


def test_phrase_scores(spark):
    rng = random.Random(5)
    docs = [[rng.choice(["x", "y", "z", "w"]) for _ in range(30)] for _ in range(40)]
    pair_n, word_n = {}, {}
    for doc in docs:
        for word in doc:
            word_n[word] = word_n.get(word, 0) + 1
        for pair in zip(doc, doc[1:]):
            pair_n[pair] = pair_n.get(pair, 0) + 1
    size = len(pair_n) + len(word_n)
    expected = {
        pair: (n - 20) * size / (word_n[pair[0]] * word_n[pair[1]]) for pair, n in pair_n.items()
    }
    cut = sorted(expected.values())[len(expected) // 2]
    found = phrases.score_phrases(corpus(spark, docs), 20, cut).collect()
    assert {(r["a"], r["b"]): pytest.approx(r["score"]) for r in found} == {
        pair: score for pair, score in expected.items() if score > cut
    }


@pytest.mark.parametrize("inline,limit", [(100, 0), (1, 0), (0, 0), (1, 1 << 20), (0, 1 << 20)])
def test_base_forms_in_place_and_joined(spark, monkeypatch, inline, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    docs = [["cats", "cat", "boxes", "box", "glass", "mice"], ["men", "man", "was", "wa", "cats"],
            ["glasses", "glass", "it's"], []]
    irregular = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    table = lemmas.learn_lemmas(corpus(spark, docs), irregular)
    learned = {row["form"]: row["lemma"] for row in table.collect()}
    # "was" is a stop word; "glass" stays because "glas" is no word.
    assert learned == {
        "cats": "cat", "boxes": "box", "men": "man", "mice": "mouse", "glasses": "glass",
    }
    found = tokens_of(lemmas.replace_tokens(corpus(spark, docs), table, inline_forms=inline))
    assert found == {i: [learned.get(t, t) for t in doc] for i, doc in enumerate(docs)}


def test_large_sets_do_not_move_rows(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(3)
    docs = [(i, [rng.choice(words) for _ in range(rng.randrange(0, 30))]) for i in range(60)] + [(60, []), (61, [])]
    df = spark.createDataFrame(docs, "conv_id long, tokens array<string>").repartition(3)
    forms = spark.createDataFrame([(f"w{i}", f"v{i}", i) for i in range(0, 40, 3)], "form string, lemma string, cf long")
    pairs = spark.createDataFrame([(f"w{i}", f"w{j}", i) for i in range(0, 40, 3) for j in range(40)], "a string, b string, n_ab long")

    def told(found):
        return {r["conv_id"]: r["tokens"] for r in found.collect()}

    results = []
    for limit in (0, 1 << 20):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
        replaced = lemmas.replace_tokens(df, forms, inline_forms=0)
        fused = phrases.apply_phrases(df, pairs, inline_phrases=0)
        results.append((told(replaced), told(fused)))
        if limit:
            for found in (replaced, fused):
                plan = found._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan.lower()
    assert results[0] == results[1] and len(results[0][0]) == 62
    want = {i: tokens and [f"v{t[1:]}" if int(t[1:]) % 3 == 0 else t for t in tokens] for i, tokens in docs}
    assert results[0][0] == want


def test_filter_keeps_all_known_keys(spark):
    keys = spark.range(0, 5_000, 2).selectExpr("concat('k', id) AS word")
    bits, pieces = joins.key_filter(keys, "word")
    assert pieces == 2
    left = joins.perhaps_known(spark.range(10_000).selectExpr("concat('k', id) AS word", "id"), bits, pieces, "word")
    found = {r["id"] for r in left.collect()}
    assert found >= set(range(0, 5_000, 2)) and len(found) < 2_500 + 900


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_phrases_are_learned_once_however_they_are_applied(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    read = spark.sparkContext.accumulator(0)

    def tick(row):
        read.add(1)
        return row

    rows = spark.sparkContext.parallelize([("a", "b", 3), ("c", "a", 2), ("b", "x y", 1), ("q", "", 1)], 1).map(tick)
    pairs = spark.createDataFrame(rows, "a string, b string, n_ab long")
    docs = [["a", "b", "a"], ["b", "x y", "c", "a"], ["b", "x", "y"], ["q", "q"], [], ["a"]]
    found = tokens_of(phrases.apply_phrases(corpus(spark, docs), pairs, inline_phrases=0))
    assert found == {0: ["a_b", "a"], 1: ["b_x y", "c_a"], 2: ["b", "x", "y"], 3: ["q", "q"], 4: [], 5: ["a"]}
    assert read.value == 4


def test_pairs_of_null_empty_and_single_word_rows(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, ["a"]), (3, ["a", "b", "a", "b"])], "conv_id long, tokens array<string>")
    found = {(r.a, r.b): r.n for r in phrases.pair_counts(df).collect()}
    assert found == {("a", ""): 1, ("a", "b"): 2, ("b", "a"): 1, ("b", ""): 1}


def test_pairs_are_counted_without_a_lambda_and_told_apart(spark):
    rows = [["a", "bc", "ab", "c"], ["a b", "c", "a", "b c"], [], None, ["x"], ["", "x", None, "y", ""], ["é", "漢🙂", "é", "漢🙂"]]
    df = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "conv_id long, tokens array<string>")
    want = Counter((a, b or "") for row in rows for a, b in zip(row or [], [*(row or [])[1:], ""]))
    found = phrases.pair_counts(df)
    assert {(r.a, r.b): r.n for r in found.collect()} == want and found.count() == len(want)
    pairs = phrases.frequent_pairs(df, 1)
    assert {(r.a, r.b): r.n_ab for r in pairs.collect()} == {pair: n for pair, n in want.items() if pair[1]}
    for counted in (found, pairs):
        assert "lambda" not in counted._jdf.queryExecution().toString()


def test_texts_are_dealt_in_parts_of_a_size(spark, tmp_path):
    rows = [(None if i % 9 == 0 else i // 2, f"{i} " * 200 if i % 5 else None) for i in range(400)]
    spark.createDataFrame(rows, "conv_id long, conversation string").write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    dealt = tables.spread(df, "conv_id", "conversation", part_bytes=500)
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert Counter(map(tuple, dealt.collect())) == Counter(rows)
    assert tables.spread(df, "conv_id", part_bytes=1 << 30).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism

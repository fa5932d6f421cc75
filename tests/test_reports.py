"""Assembly, joins, evaluation, labels, reports, sources and the whole analysis."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chatterloom import ConversationAnalysis, Settings
from chatterloom.catalog.reports import echo_namer, text_scorer
from chatterloom.operators import assemble, assessment, insights, joins, labels, sampling
from chatterloom.sources import tables
from chatterloom.sources.staging import StagingArea


def test_question_pairs_across_blocks(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for conv in range(6):
        turns = sorted(rng.sample(range(60), 25))
        roles = [rng.choice(["user", "assistant", "system"]) for _ in turns]
        for i, (turn, role) in enumerate(zip(turns, roles)):
            rows.append((conv, turn, role, f"t{conv}.{turn}"))
            if role == "user":
                follows = i + 1 < len(turns) and roles[i + 1] == "assistant"
                expected[conv, turn] = f"t{conv}.{turns[i + 1]}" if follows else None
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = assemble.question_answer_pairs(df, block_turns=7).collect()
    assert {(r["conv_id"], r["turn"]): r["answer"] for r in found} == expected


def test_conversations_are_one_row_however_long_or_sparse(spark):
    turns = [*range(6), 2999, 1_700_000_000, 1_700_001_500]
    df = spark.createDataFrame(
        [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in turns]
        + [(2, 5000, "user", "q"), (2, 9001, "user", None), (3, 1, "system", "s")],
        "conv_id long, turn long, role string, text string",
    )
    told = lambda rest: " ".join(f"m{t}" for t in turns if t % 2 == rest)
    expected = [
        (1, f"Question: {told(0)} Answer: {told(1)}"), (2, "Question: q Answer: "), (3, "Question:  Answer: "),
    ]
    for block in (1000, 4):
        found = assemble.assemble_turns(df, block_turns=block)
        assert sorted(tuple(r) for r in found.collect()) == expected


def test_columns_must_be_lists_and_exist(spark):
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    with pytest.raises(ValueError):
        assemble.conversations(df, question_cols="question", answer_cols=["answer"])
    with pytest.raises(ValueError):
        assemble.conversations(df, question_cols=["missing"], answer_cols=["answer"])
    with pytest.raises(ValueError):
        assemble.conversations(df, column="question", question_cols=["question"])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    left = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 10, 2)], "k long, v string")
    one = joins.lookup_join(left, right, ["k"], how)
    two = joins.lookup_join(left, right, ["k"], how, rows=2)
    assert one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def restated(text):
    names = ["relevance", "accuracy", "completeness", "conciseness", "tone"]
    out = dict.fromkeys([*names, "average_score", "assessment"])
    try:
        lines = text.split("\n")
        for i, name in enumerate(names):
            out[name] = int(lines[i].split(":")[1].strip())
        out["average_score"] = sum(out[name] for name in names) / 5
        line = [x for x in lines if "Assessment:" in x][0]
        out["assessment"] = line.split(":", 1)[1].strip()
    except Exception:
        pass
    return out


def test_evaluations_keep_the_fields_before_a_failure(spark):
    good = ["1: 4", "2: 5", "3: 3", "4: 4", "5: 2", "Assessment: fine: really \t"]
    texts = ["\n".join(good), "\r\n".join(good), "", None, "\n".join(good[:5]), "\n".join(good[:2])]
    for bad in ("4/5", " ", "x", "4.5", "+3", "-1", "9", "３"[:0] + "3 points"):
        for at in range(5):
            texts.append("\n".join(good[:at] + [f"{at + 1}:{bad}"] + good[at + 1:]))
    texts.append("\n".join([good[5], *good]))
    df = spark.createDataFrame(list(enumerate(texts)), "conv_id int, evaluation string")
    parsed = assessment.parse_evaluations(df)
    assert "evaluation" not in parsed.columns
    for row in parsed.collect():
        expected = restated(texts[row["conv_id"]])
        assert {name: row[name] for name in expected} == expected, texts[row["conv_id"]]
        scores = [expected[n] for n in list(expected)[:5] if expected[n] is not None]
        assert row["out_of_range"] == any(not 1 <= s <= 5 for s in scores)


def test_digest_is_the_start_of_all_assessments(spark):
    rng = random.Random(8)
    rows = [
        (i, rng.choice(["hot"] * 5 + ["cold"]), rng.choice([None, "", "ab", "abcdef gh"]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "conv_id long, topic_label string, assessment string")
    found = {r["topic_label"]: r["digest"] for r in insights.assessment_digest(df, 50).collect()}
    for label in ("hot", "cold"):
        whole = " ".join(text for _i, name, text in rows if name == label and text is not None)
        assert found[label] == whole[:50]


def test_topic_texts_come_in_ordered_blocks(spark):
    df = spark.range(100).select(
        F.col("id").alias("conv_id"), (F.col("id") % 2).alias("topic"),
        F.col("id").cast("string").alias("text"),
    )
    rows = insights.texts_per_topic(df, "topic", "text", block=10).orderBy("topic", "block").collect()
    whole = " ".join(r["text"] for r in rows if r["topic"] == 1)
    assert whole == " ".join(str(i) for i in range(1, 100, 2))


def test_topic_order_with_ties_and_missing_scores(spark):
    scores = spark.createDataFrame(
        [("b", 2.0), ("a", 2.0), ("c", None), ("d", 4.0)], "topic_label string, average_score double"
    )
    names = lambda which: [r["topic_label"] for r in insights.select_topics(scores, 4, which).collect()]
    assert names("worst") == ["a", "b", "d", "c"]
    assert names("best") == ["d", "a", "b", "c"]
    with pytest.raises(ValueError):
        insights.select_topics(scores, 1, "middling")


def topic_rows(spark, *terms):
    rows = [(i, f"Topic{i}", list(words)) for i, words in enumerate(terms, start=1)]
    return spark.createDataFrame(rows, "topic int, topic_key string, terms array<string>")


def test_equal_keyword_labels_get_another_term(spark):
    table = topic_rows(spark, ["a_b", "c", "d", "e"], ["a", "b", "c", "d", "x"], ["a_b", "c", "d", "y"])
    found = {r["topic"]: r["topic_label"] for r in labels.keyword_labels(table).collect()}
    assert found == {1: "A B C D", 2: "A B C", 3: "A B C D Y"}


def test_naming_sees_earlier_names_and_improvements(spark):
    table = topic_rows(spark, ["x{0}", "y"], ["z", "w"])
    seen = []

    def namer(instruction, request):
        seen.append((instruction, request))
        named = request.startswith("Keywords")
        return f" \"name\"  number {len(seen)}" if named else f"'final' {len(seen)}"

    found = {r["topic"]: r["topic_label"] for r in labels.name_topics(table, namer, "tests").collect()}
    assert found == {1: "Final 3", 2: "Final 4"}
    assert "\"name\" Number 1" in seen[1][0] and "none" in seen[0][0]
    assert "Final 3" in seen[3][0] and "x{0}, y" in seen[3][0]
    echoed = labels.name_topics(table, echo_namer, "tests").orderBy("topic").collect()
    assert [r["topic_label"] for r in echoed] == ["X{0} Y", "Z W"]


def test_samples_repeat_and_take_all_of_a_small_table(spark):
    df = spark.range(50).select(F.col("id").alias("conv_id"), F.lit("t").alias("conversation"))
    one = {r["conv_id"] for r in sampling.sample_rows(df, 10).collect()}
    two = {r["conv_id"] for r in sampling.sample_rows(df.repartition(5), 10).collect()}
    assert one == two and len(one) == 10
    assert sampling.sample_rows(df, 10, seed=8).count() == 10
    assert sampling.sample_rows(df, 500).count() == 50
    assert [r["conv_id"] for r in sampling.tail_rows(df, 2).collect()] == [48, 49]


def test_sources(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as out:
        out.write('question,answer,n\n"a, ""b""\nc",d,1\ne,,2\n')
    df = tables.read_csv(spark, path)
    assert df.dtypes == [("question", "string"), ("answer", "string"), ("n", "int")]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [('a, "b"\nc', "d", 1), ("e", None, 2)]
    with open(tmp_path / "page.json", "w") as out:
        json.dump({"rows": [{"row": {"q": "x", "n": 1}}, {"row": {"q": "y", "n": 2}}]}, out)
    assert tables.read_json_pages(spark, str(tmp_path / "page.json")).count() == 2
    tables.write_table(df, str(tmp_path / "table"))
    assert tables.read_parquet(spark, str(tmp_path / "table")).count() == 2


def test_topics_with_the_same_terms_get_names_of_their_own(spark):
    rows = [(i, f"Topic{i}", ["a", "b", "c"]) for i in range(1, 5)] + [(5, "Topic5", ["a", "b", "c", "x", "y"])]
    df = spark.createDataFrame(rows, "topic int, topic_key string, terms array<string>")
    names = [r["topic_label"] for r in labels.keyword_labels(df).collect()]
    assert len(set(names)) == 5 and all(name == name.strip() for name in names)
    assert "A B C" in names


def test_staged_tables_are_released(spark):
    with StagingArea(spark) as area:
        staged = area.stage(spark.range(5).toDF("x"), "numbers")
        assert staged.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(staged.inputFiles()[0])


def test_whole_analysis(spark):
    rng = random.Random(9)
    sides = [[f"ship{i}" for i in range(15)], [f"plane{i}" for i in range(15)]]
    rows = [(i, " ".join(rng.choice(sides[i % 2]) for _ in range(25))) for i in range(120)]
    rows += [(500, ""), (501, None), (502, "the of 12")]
    # Words that the vocabulary does not keep: no topic, so never part of the sample.
    rows += [(600 + i, "rare" + "abcdefghij"[i % 10] * (2 + i // 10)) for i in range(60)]
    rows = [(key, text, f"side{key % 2}") for key, text in rows]
    df = spark.createDataFrame(rows, "conv_id long, conversation string, category string")
    settings = Settings(start_topics=2, end_topics=3, passes=6, sample_size=40, insight_topics=1)
    analysis = ConversationAnalysis(
        settings, scorer=text_scorer, summarizer=text_scorer, carry=["category"], with_bound=True,
        insights_for="best",
    )
    for name in ("topics_df", "corpus_topic_df", "coherence_df", "assessed_df", "final_insights"):
        with pytest.raises(ValueError):
            getattr(analysis, name)
    analysis.fit(df)
    assert analysis.best_num_topics in (2, 3) and analysis.best_coherence is not None
    assert analysis.coherence_df.count() == 2
    assert analysis.coherence_chart.where("is_best").count() == 1
    assert analysis.topics_df.columns == ["topic_key", "topic_label", "terms"]
    assert analysis.topics_as_list.count() == analysis.best_num_topics
    found = {r["conv_id"]: r for r in analysis.corpus_topic_df.collect()}
    assert len(found) == 183
    assert all(found[i]["dominant_topic"] is None for i in (500, 501, 502, *range(600, 660)))
    assert all(r["category"] == f"side{i % 2}" for i, r in found.items())
    assert all((r["topic_desc"] is None) == (r["dominant_topic"] is None) for r in found.values())
    assert analysis.coherence_df.where("log_perplexity_bound IS NULL").count() == 0
    assert analysis.assessed_df.where("dominant_topic IS NULL OR topic_label IS NULL").count() == 0
    assert analysis.final_insights.where("topic_label IS NULL").count() == 0
    assert abs(sum(r["percentage"] for r in analysis.topic_distribution.collect()) - 100) < 1e-9
    assert analysis.assessed_df.count() == 40
    assert analysis.final_insights.count() == 1 and analysis.criteria_chart.count() == 1
    assert "Assessment" in analysis.final_insights.first()["summary"]
    assert analysis.execution_time > 0
    analysis.release()
    with pytest.raises(ValueError):
        ConversationAnalysis().assessed_df


def test_joined_texts_equal_a_plain_join(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 6 + ["cold", None]), rng.choice([0, 0, 1]), i // 2, "x" * rng.randrange(0, 9) + str(i)) for i in range(900)]
    rows += [("cold", 0, 5, None), ("copies", 0, 1, "same"), ("long", 0, 1, "y" * 500)] + [("copies", 0, 2, "again")] * 400
    df = spark.createDataFrame(rows, "topic string, part int, conv_id int, remark string").repartition(7)
    for limit in (1, 7, 120):
        found = {r["topic"]: r["text"] for r in insights.joined_texts(df, ["topic"], "remark", ["part", "conv_id"], limit, "text").collect()}
        for topic in {row[0] for row in rows}:
            texts = {}
            for _, part, key, text in sorted((row for row in rows if row[0] == topic and row[3] is not None), key=lambda row: row[1:]):
                texts.setdefault((part, key), []).append(text)
            # Texts of one place may stand in any order.
            want = " ".join(text for held in texts.values() for text in held)[:limit]
            assert len(found[topic]) == len(want)
            at = 0
            for held in texts.values():
                size = sum(map(len, held)) + len(held)
                if at + size > limit:
                    break
                assert sorted(found[topic][at:at + size - 1].split(" ")) == sorted(held)
                at += size
    plan = insights.joined_texts(df, ["topic"], "remark", ["conv_id"], 50, "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert insights.joined_texts(df.limit(0), ["topic"], "remark", ["conv_id"], 50, "text").count() == 0


@pytest.mark.parametrize("last,bits", [(10_000, 16), (3, 4), (1, 8)])
def test_samples_end_where_the_ordered_draws_do(spark, monkeypatch, last, bits):
    import hashlib

    monkeypatch.setattr(sampling, "LAST_ROWS", last)
    monkeypatch.setattr(sampling, "COUNTED_BITS", bits)
    df = spark.range(500).selectExpr("id AS conv_id", "concat('text ', id) AS text")
    order = sorted(range(500), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    for n in (0, 1, 17, 250, 499, 500, 501):
        found = sampling.sample_rows(df, n).collect()
        assert sorted(r["conv_id"] for r in found) == sorted(order[:n])
        assert all(r["text"] == f"text {r['conv_id']}" for r in found)
    assert sampling.sample_rows(df.limit(0), 5).count() == 0

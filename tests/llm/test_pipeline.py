"""The corpus pipeline against brute force, stage by stage, on documents with copies and shared lines."""

import collections
import hashlib
import random

import corpus_pipeline
import pytest
from test_corpus import plain_lines, plain_near, plain_targets, varied
from test_documents import plain_measure

from chatterloom.llm import bpe, quality

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts_of():
    chance = random.Random(21)
    prose = lambda n: " ".join(f"{chance.choice('abcdefgh')}{chance.randrange(900)}x".replace("0", "o").translate(str.maketrans("123456789", "ijklmnpqr")) for _ in range(n))
    passage = prose(60)
    texts = ["\n".join(prose(chance.randrange(9, 40)) for _ in range(3)) for _ in range(50)]
    texts += [text + "\n" + passage for text in texts[:8]]
    texts += [varied(chance, text.replace("\n", " "), 1) for text in texts[10:20]]
    texts += [texts[30], texts[31], None, "", "short", "word " * 200, "## " * 40, passage]
    chance.shuffle(texts)
    return texts


def test_stages_equal_brute_force(spark):
    texts = texts_of()
    rows = [(i, text, "en", f"s{i % 3}", None) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS)

    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert good.schema == docs.schema
    want = [i for i, text in enumerate(texts) if not quality.failures(*plain_measure(text))]
    assert sorted(row.doc_id for row in good.collect()) == want and len(want) < len(texts) - 3

    held = [texts[i] if i in set(want) else None for i in range(len(texts))]
    drop = plain_lines(held)
    lined = corpus_pipeline.line_dedup(spark, good, "")
    cleaned = {}
    for i in want:
        text = "\n".join(line for n, line in enumerate(held[i].split("\n")) if (i, n) not in drop)
        if text.strip():
            cleaned[i] = text
    found = {row.doc_id: row.text for row in lined.collect()}
    assert found == cleaned and drop
    assert all(row.n_chars == len(row.text) for row in lined.collect())

    ids = sorted(cleaned)
    _, groups = plain_near([cleaned[i] for i in ids], 5, 80)
    kept = [i for place, i in enumerate(ids) if groups[place] == place]
    near = corpus_pipeline.near_dedup(spark, lined, "")
    assert sorted(row.doc_id for row in near.collect()) == kept and len(kept) < len(ids)

    mixed = [(row.doc_id, row.source) for row in corpus_pipeline.source_mix(spark, near, "").collect()]
    size = {i: len(cleaned[i].split()) for i in kept}
    sizes = collections.Counter()
    for i in kept:
        sizes[f"s{i % 3}"] += size[i]
    taken = collections.Counter()
    for i, source in mixed:
        taken[source] += size[i]
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= max(size.values()) / 2 + 1e-6
    assert max(collections.Counter(i for i, _ in mixed).values()) <= 3

    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(bpe.multilingual_path()).ranks, special_tokens={}
    )
    for row in corpus_pipeline.token_ids(spark, near, "").collect():
        ids = library.encode_ordinary(cleaned[row.doc_id])
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(cleaned[row.doc_id].encode()).hexdigest()


def test_all_stages_run_in_turn(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "source mix", "token ids"]
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and found.count() > 50


def test_stages_take_empty_tables_and_more_columns(spark):
    for docs in (
        spark.createDataFrame([], COLUMNS),
        spark.createDataFrame([(None, None, None, None, None, "a", 1), (1, "", None, None, None, "a", 1)], COLUMNS + ", ids string, n long"),
    ):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, "")
            assert found.count() <= docs.count(), name
            if name != "token ids":
                assert found.columns == docs.columns, name


def test_token_ids_hold_one_python_worker_per_task(spark):
    """Each Python step in a task has a worker of its own, and executors keep them."""
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "x " * 30_000, "en", "s", 60_000), (2, None, "en", "s", None)], COLUMNS)
    found = corpus_pipeline.token_ids(spark, docs, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted((row.doc_id, row.n_tokens, len(row.ids)) for row in found.collect())[::2] == [(1, 2, 2), (2, 30_001, 30_001)]


def test_classes_of_code_points_take_little_memory():
    import tracemalloc

    import regex

    tracemalloc.start()
    table = bpe._classes.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    kinds = {bpe._LETTER: r"\p{L}", bpe._NUMBER: r"\p{N}", bpe._SPACE: r"\p{White_Space}"}
    for code in [*range(0x3000), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0x1D7CE, 0x20000, 0x10FFFF]:
        want = next((kind for kind, pattern in kinds.items() if regex.match(pattern, chr(code))), bpe._OTHER)
        assert table[code] == want


@pytest.mark.parametrize("name", ["op5_topk", "op6_mixing", "op7_quality"])
def test_queries_with_sql_are_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and name in __spark_entry__.oracle_sql()

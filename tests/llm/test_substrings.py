"""Substring dedup against a window by window comparison."""

import hashlib
import random
import re

import numpy as np
import pytest

from chatterloom.llm import substrings
from chatterloom.llm.common import word_hashes

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id bigint, text string, lang string, least string, start string, gone string"


def docs_of(spark, rows):
    return spark.createDataFrame([(key, text, "en", "clash", "clash", "clash") for key, text in rows], DOCS)


def plain(rows, width):
    """What is left of each row, all windows compared."""
    split = [(key, re.findall(WORD, text or "")) for key, text in rows]
    first = {}
    for key, tokens in split:
        for i in range(len(tokens) - width + 1) if key is not None else ():
            window = tuple(tokens[i:i + width])
            first[window] = min(first.get(window, (key, i)), (key, i))
    found = []
    for key, tokens in split:
        gone = set()
        for i in range(len(tokens) - width + 1) if key is not None else ():
            if first[tuple(tokens[i:i + width])] != (key, i):
                gone.update(range(i, i + width))
        left = [token for i, token in enumerate(tokens) if i not in gone]
        found.append((key, len(tokens), len(gone), " ".join(left)))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(5)
    few = [f"w{i}" for i in range(30)]
    word = lambda: f"v{chance.randrange(3000)}"
    passage = [word() for _ in range(70)]
    texts = []
    for _ in range(60):
        tokens = [word() for _ in range(chance.randrange(0, 90))]
        at = chance.randrange(len(tokens) + 1)
        cut = chance.randrange(50)
        copy = passage[cut:cut + chance.randrange(10, 70)]
        if chance.random() < 0.5 and copy:
            copy[chance.randrange(len(copy))] = word()
        texts.append(" ".join(tokens[:at] + copy + tokens[at:]))
    texts += [" ".join(chance.choice(few[:2]) for _ in range(chance.randrange(20, 120))) for _ in range(6)]
    texts += ["a " * n for n in (5, 19, 20, 21, 33, 34, 35, 60)] + ["a b c " * 30, "x\ty\nz " * 25, "  é " * 30]
    texts += [None, "", " \n ", "one", texts[3], texts[3], " ".join(passage), " ".join(passage)]
    keys = list(range(100, 100 + len(texts)))
    chance.shuffle(keys)
    made = list(zip(keys, texts))
    # Repeated rows, and rows without a key that repeat others.
    return made + made[:4] + made[-1:] + [(None, texts[3]), (None, " ".join(passage)), (None, None)]


@pytest.mark.parametrize("hot,bucket", [(2_000, 4_096), (2_000, 1), (1, 4_096)])
def test_equals_all_windows(spark, rows, monkeypatch, hot, bucket):
    monkeypatch.setattr(substrings, "HOT_VARIANTS", hot)
    monkeypatch.setattr(substrings, "BUCKET_ROWS", bucket)
    found = substrings.without_substrings(docs_of(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept.decode()) for r in found), key=str)
    want = plain(rows, 20)
    assert got == want
    assert sum(row[2] for row in want) > 500


def test_other_widths(spark, rows):
    found = substrings.without_substrings(docs_of(spark, rows), width=9).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept.decode()) for r in found), key=str) == plain(rows, 9)


def test_super_kmers_cover_every_window_once():
    chance = np.random.default_rng(3)
    for size in (0, 19, 20, 21, 200, 5_000):
        hashes = word_hashes([b"%d" % i for i in chance.integers(0, 400, size)])
        start, windows, least, _, _ = substrings.super_kmers(hashes)
        assert windows.sum() == max(size - 19, 0)
        assert (start == np.cumsum(windows) - windows).all() and (least[1:] != least[:-1]).all()


def test_different_windows_of_one_hash(monkeypatch):
    monkeypatch.setattr(substrings, "_FACTOR", np.uint64(0))
    texts = [b" ".join(b"%d" % (i + k) for k in range(20)) for i in (0, 1, 0, 2, 1)]
    row, begin, end = substrings.later_windows(np.arange(5), np.zeros(5, np.int64), texts)
    assert row.tolist() == [2, 4] and begin.tolist() == [0, 0] and end.tolist() == [20, 20]


def test_no_rows_and_a_very_long_text(spark):
    assert substrings.without_substrings(docs_of(spark, [])).count() == 0
    long = " ".join(f"q{i % 70_000}" for i in range(200_000)) + " " + "z" * 300_000
    rows = [(1, long), (2, "z " * 100_000), (3, long[:400])]
    found = {r.doc_id: r for r in substrings.without_substrings(docs_of(spark, rows)).collect()}
    assert (found[1].n_words, found[1].n_removed) == (200_001, 130_000)
    assert (found[2].n_removed, found[3].n_removed) == (99_999, len(re.findall(WORD, long[:400])) - (not long[400].isspace() and long[399] != " "))
    digest = hashlib.sha256(found[2].kept).hexdigest()
    assert digest == hashlib.sha256(b"z").hexdigest()

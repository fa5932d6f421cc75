"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from chatterloom.llm import variants
from chatterloom.sources.staging import StagingArea

DOCS = "doc_id bigint, text string, lang string, word string, n string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(key, text, "en", "clash", "clash", "clash") for key, text in rows], DOCS)


def at_distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {word: n for word, n in counts.items() if n >= 3 and len(word) >= 5}
    near = {word: [other for other in words if at_distance_one(word, other)] for word in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda other: (-words[other], other), default=None)
        form[word] = best if best is not None and words[best] >= 2 * words[word] else None
    found = set()
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        found.add((word, n, len(near[word]), form[word], form[word] and words[form[word]], root))
    return found


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(8)
    parts = ["tion", "en", "er", "ou", "la", "é", "ña", "st", "qu", "x", "Ü", "a", "aa", "b"]
    base = ["".join(chance.choice(parts) for _ in range(chance.randrange(2, 6))) for _ in range(60)]
    letters = "abcdexyzéÿ"

    def edited(word):
        at = chance.randrange(len(word) + 1)
        return chance.choice([word[:at] + chance.choice(letters) + word[at:], word[:at] + word[at + 1:],
                              word[:max(at - 1, 0)] + chance.choice(letters) + word[at:]])

    known = base + [edited(word) for word in base for _ in range(4)] + [edited(edited(word)) for word in base]
    known += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa", "aaaab", "baaaa", "xaaaa", "aaaax", "aaxaa"]
    texts = [" ".join(chance.choice(known) * 1 for _ in range(chance.randrange(0, 120))) for _ in range(120)]
    texts += ["Aaaaa AAAAA aaaaa, Ünder×word÷x 9letters9", None, "", " \n", texts[0], texts[0]]
    texts += [" ".join([word] * chance.choice([1, 2, 3, 6, 12, 24])) for word in known]
    made = list(enumerate(texts, 1000))
    return made + made[:5] + [(None, texts[1]), (None, None)]


def told(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_equals_all_pairs(spark, rows):
    found = variants.spelling_forms(docs_of(spark, rows))
    assert found.count() == len(plain(rows))
    assert told(found) == plain(rows)
    assert sum(1 for row in told(found) if row[3]) > 30 and max(row[2] for row in told(found)) > 3


def test_long_words_have_the_same_result(spark, rows, monkeypatch):
    monkeypatch.setattr(variants, "LONG_CHARS", 8)
    assert told(variants.spelling_forms(docs_of(spark, rows))) == plain(rows)
    assert all(variants.one_apart(a, b) == at_distance_one(a, b) for a in ("abcd", "abbcd", "") for b in ("abc", "abcd", "abbd", "xabcd", "abcdd", "a"))


def test_flushed_counts_are_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED_WORDS", 1)
    assert told(variants.spelling_forms(docs_of(spark, rows))) == plain(rows)


def test_pivots_are_the_cheapest_that_do_not_overlap():
    chance = random.Random(4)
    for _ in range(300):
        prefix = [(i, chance.randrange(50)) for i in sorted(chance.sample(range(12), 6))]
        pairs = [(a[1] + b[1], a[0], b[0]) for a in prefix for b in prefix if b[0] >= a[0] + 2]
        chosen = variants.pivots_of(prefix)
        assert len(chosen) == 2 and chosen[1] >= chosen[0] + 2
        assert sum(dict(prefix)[at] for at in chosen) == min(pairs)[0]


def test_every_edit_is_found_through_a_pivot():
    chance = random.Random(6)
    for _ in range(3_000):
        a = "".join(chance.choice("abc") for _ in range(chance.randrange(5, 12)))
        at = chance.randrange(len(a) + 1)
        b = chance.choice([a[:at] + "d" + a[at:], a[:at] + a[at + 1:], a[:max(at - 1, 0)] + "d" + a[at:]])
        if len(b) < 5 or not at_distance_one(a, b):
            continue
        ranks = {x + y: (chance.randrange(5), x + y) for x in "abcd" for y in "abcd"}

        def meet(s, r):
            own = {k for p in variants.pivots_of(variants.prefix_of(s, ranks)) for k in variants.surviving_keys(s, p, len(s))}
            other = {
                k for p, _ in variants.prefix_of(r, ranks) for size in range(len(r) - 1, len(r) + 2)
                for k in variants.surviving_keys(r, p, size)
            }
            return own & other

        assert meet(a, b) or meet(b, a), (a, b, ranks)


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)]
    ends = variants.roots(spark.createDataFrame(chain, "word string, form string"), StagingArea(spark)).collect()
    assert {r.word: r.root for r in ends} == {word: "w070" for word, _ in chain}


def test_tables_of_words_are_not_sent_to_the_tasks(spark, rows, monkeypatch):
    plans, stage = [], StagingArea.stage

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(StagingArea, "stage", lambda self, df, name: stage(self, planned(df), name))
    planned(variants.spelling_forms(docs_of(spark, rows)))
    assert sum("SortMergeJoin" in plan for plan in plans) >= 4
    assert not any("Broadcast" in plan for plan in plans)


def test_no_words(spark):
    assert variants.spelling_forms(docs_of(spark, [])).count() == 0
    assert variants.spelling_forms(docs_of(spark, [(1, None), (2, "")])).count() == 0
    long = "abcdefghij" * 30_000
    other = long[:70_000] + long[70_001:]
    found = told(variants.spelling_forms(docs_of(spark, [(1, f"{long} {long} {long} {other} {other}"), (2, f"{other} " * 5)])))
    assert found == {(long, 3, 1, other, 7, other), (other, 7, 1, None, None, other)}

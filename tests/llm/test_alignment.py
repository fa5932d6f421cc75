"""Alignment of two tokenizers against whole texts, byte by byte."""

import collections
import hashlib
import random

import numpy as np
import pytest

from chatterloom.llm import alignment

DOCS = "doc_id bigint, text string, lang string, groups string, n_a string, rare string"


def docs_of(spark, rows):
    return spark.createDataFrame([(key, text, "en", "clash", "clash", "clash") for key, text in rows], DOCS)


@pytest.fixture(scope="module")
def pair():
    return alignment.tokenizers_of(*alignment.public_paths())


def tokens_of(pair, text):
    """Ids and bytes of both, from the whole text at once."""
    if not text:
        return [], []
    whole = " " + text
    a = pair.a.encode(whole, add_special_tokens=False).ids
    b = pair.b.encode(text)
    from tokenizers.decoders import ByteLevel
    assert ByteLevel().decode([pair.a.id_to_token(i) for i in a]) == whole
    raw = b"".join(bytes([int(pair.b.id_to_piece(i)[3:5], 16)]) if pair.b.is_byte(i) else pair.b.id_to_piece(i).replace("▁", " ").encode() for i in b)
    return (a, b) if raw == whole.encode() else ([], [])


def plain(pair, rows):
    placed = []
    for key, text in rows:
        sides = []
        for ids, sizes in zip(tokens_of(pair, text), (pair.a_size, pair.b_size)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + int(sizes[i]), i))
                at = spans[-1][1]
            sides.append(spans)
        a, b = sides
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] if len(a) < 400 else None
        if links is None:  # a step along both
            links, j = [], 0
            for x in a:
                while b[j][1] <= x[0]:
                    j += 1
                k = j
                while k < len(b) and b[k][0] < x[1]:
                    links.append((x[2], b[k][2]))
                    k += 1
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(t[2]) for t in side if low < t[1] <= end) for side in (a, b)))
            low = end
        placed.append((key, a, b, groups, links))
    counts = collections.Counter(link for row in placed for link in row[4])
    highest = collections.defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted((
        (key, len(a), len(b), len(groups), len(links), sum(counts[link] == highest[link[1]] for link in links),
         sum(counts[link] for link in links), ";".join(groups)) for key, a, b, groups, links in placed
    ), key=str)


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(12)
    parts = ["the", "of", "Éauouon", "lettre", "thorough", "ing", ".", ", ", " ", "  ", "\n", "\n\n", "\r\n", "\t", "7", "2024", "don't", "'s", "-", "日本語", "한국",
             "🙂", "é", "é", "\xa0", "　", "​", "\x00", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "Å", "\x1c", " ", "a", "x" * 30]
    texts = ["".join(chance.choice(parts) + chance.choice(["", " ", "\n", " "]) for _ in range(chance.randrange(1, 25))) for _ in range(150)]
    texts += [None, "", " ", "  ", "\n", "a", " a", "a ", "\na", "a\n", "a\n b", "a \nb", "▁", "x ▁y", "The quick brown fox.\nJumps over", texts[0], texts[0]]
    texts += [" ".join(chance.choice(["Enpaeux", "elle", "un", "thinking"]) for _ in range(900))]
    made = list(enumerate(texts, 50))
    return made + made[:4] + [(None, texts[1]), (None, None)]


def told(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()), key=str)


@pytest.mark.parametrize("table_pairs", [1_000_000, 40, 0])
def test_equals_whole_texts(spark, pair, rows, table_pairs):
    found = alignment.alignments(docs_of(spark, rows), *alignment.public_paths(), table_pairs=table_pairs)
    assert told(found) == plain(pair, rows)


def test_a_small_memory_gives_the_same(spark, pair, rows):
    known = alignment.Aligned(pair)
    all_at_once = [text for _, text in rows]
    want = [";".join(known.groups[i] for i in at) for at in known.places(all_at_once)]
    limit, alignment.REMEMBERED_PIECES = alignment.REMEMBERED_PIECES, 3
    try:
        small = alignment.Aligned(pair)
        for text, groups in zip(all_at_once, want):
            (at,) = small.places([text])
            assert ";".join(small.groups[i] for i in at) == groups
        assert small.renumbered > 10
    finally:
        alignment.REMEMBERED_PIECES = limit


def test_coalescing_equals_common_ends():
    chance = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.append(np.sort(chance.choice(np.arange(1, 40), chance.integers(1, 20), replace=False)), 40) for _ in range(2))
        a_start, b_start = np.append(0, a[:-1]), np.append(0, b[:-1])
        a_group, b_group, link_a, link_b = alignment.coalesced(a_start, a, b_start, b)
        ends = np.intersect1d(a, b)
        assert (a_group == np.searchsorted(ends, a)).all() and (b_group == np.searchsorted(ends, b)).all()
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if a_start[i] < b[j] and b_start[j] < a[i]]
        assert list(zip(link_a.tolist(), link_b.tolist())) == want


def test_digests_no_rows_and_long_texts(spark, pair, tmp_path):
    assert alignment.alignments(docs_of(spark, []), *alignment.public_paths()).count() == 0
    long = [(1, "word " * 60_000), (2, "x" * 20_000), (3, "\n" * 5_000), (4, None)]
    docs_of(spark, long).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in alignment.op12_alignment(spark, str(tmp_path)).collect()}
    want = {row[0]: row for row in plain(pair, long[1:])}
    for key in (2, 3, 4):
        groups = want[key][7]
        assert found[key].groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert (found[key].n_a, found[key].n_b, found[key].n_links) == (want[key][1], want[key][2], want[key][4])
    assert found[1].n_groups >= 60_000 and found[4].groups_sha256 == ""

"""Operators that compare rows with each other: lines, near-duplicates, search, mixing, quotes, templates."""

import collections
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterloom.llm import lines, minhash, mixing, quotes, templates, topk
from chatterloom.llm.components import components
from chatterloom.sources.staging import StagingArea

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, kept string, size string"


def docs_of(spark, texts, sources=None):
    rows = [(i, text, "en", sources[i] if sources else "s", 1, "clash", "clash", "clash") for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- components and near-duplicates ------------------------------------------------------------


def plain_components(nodes, edges):
    parent = {node: node for node in nodes}

    def root(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {node: root(node) for node in nodes}


def test_components_equal_union_find(spark):
    chance = random.Random(2)
    edges = [(chance.randrange(60), chance.randrange(60)) for _ in range(40)]
    edges += [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 40)] + [(5, 5), (5, 6), (6, 5)]
    found = components(spark.createDataFrame(edges, "u bigint, v bigint"), StagingArea(spark), "test").collect()
    linked = {node for a, b in edges if a != b for node in (a, b)}
    want = plain_components(linked, [(a, b) for a, b in edges if a != b])
    assert {row.node: row.component for row in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "u bigint, v bigint"), StagingArea(spark), "none").count() == 0


def plain_shingles(text, width):
    tokens = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return set()
    return {tuple(tokens[i:i + width]) for i in range(max(1, len(tokens) - width + 1))}


def plain_near(texts, width, percent):
    sets = [plain_shingles(text, width) for text in texts]
    edges = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    return sets, plain_components(range(len(texts)), edges)


def varied(chance, text, changes):
    tokens = text.split()
    for _ in range(changes):
        tokens[chance.randrange(len(tokens))] = f"w{chance.randrange(10**6)}"
    return " ".join(tokens)


@pytest.fixture(scope="module")
def copies():
    """A large group of copies that are like each other to unlike degrees, chains, and odd texts."""
    chance = random.Random(11)
    word = lambda: f"v{chance.randrange(4000)}"
    base = " ".join(word() for _ in range(120))
    texts = [varied(chance, base, chance.randrange(9)) for _ in range(120)]
    chain = " ".join(word() for _ in range(200))
    for _ in range(12):
        texts.append(chain)
        chain = varied(chance, chain, 3)
    texts += [" ".join(word() for _ in range(chance.randrange(1, 90))) for _ in range(60)]
    texts += [None, "", "  \n", "one", "ONE", "one two", "one  two", "É b c", "é b c", base, base, base.upper(), "Kelvin K k"]
    chance.shuffle(texts)
    return texts


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, copies, width, percent):
    sets, want = plain_near(copies, width, percent)
    rows = minhash.near_duplicates(docs_of(spark, copies), width=width, percent=percent).collect()
    assert len(rows) == len(copies)
    for row in rows:
        assert row.n_shingles == len(sets[row.doc_id])
        assert row.component_id == want[row.doc_id], row
        assert row.kept == (row.doc_id == row.component_id)
        assert row.class_id == min(i for i, held in enumerate(sets) if i == row.doc_id or held and held == sets[row.doc_id])


def test_blocks_find_what_stars_miss(spark, copies, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    _, want = plain_near(copies, 3, 85)
    rows = minhash.near_duplicates(docs_of(spark, copies), width=3, percent=85).collect()
    assert {row.doc_id: row.component_id for row in rows} == want


def test_one_of_each_group_stays(spark, copies):
    df = docs_of(spark, copies)
    _, want = plain_near(copies, 5, 80)
    doubled = df.union(df.where("doc_id % 7 = 0")).union(spark.createDataFrame([(None, copies[0], *[None] * 6)], DOCS))
    kept = minhash.one_of_each(doubled)
    assert kept.schema == df.schema
    assert sorted(row.doc_id for row in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(want.values()))
    assert kept.where("doc_id IS NULL").count() == 1
    nothing = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(nothing).count() == minhash.one_of_each(nothing).count() == 0


# --- lines -------------------------------------------------------------------------------------


def plain_lines(texts):
    """Lines to drop: lines as they stand, lines but for digits, and templates of every leaf."""
    mask = lambda token: lines.WILDCARD if re.search("[0-9]", token) else token
    raw = [(i, n, tuple(re.findall(WORD, line))) for i, text in enumerate(texts) for n, line in enumerate((text or "").split("\n"))]
    raw = [entry for entry in raw if entry[2]]
    drop = set()

    def docs(places):
        return len({i for i, _ in places})

    def apply(places):
        drop.update(set(places) - {min(places)})

    def enough(tokens):
        return 10 if len(tokens) < 8 else 2

    same, alike, leaves = (collections.defaultdict(list) for _ in range(3))
    for i, n, tokens in raw:
        masked = tuple(map(mask, tokens))
        if any(token != lines.WILDCARD for token in masked):
            alike[masked].append((i, n))
            if masked != tokens:
                same[tokens].append((i, n))
    for tokens, places in same.items():
        if docs(places) >= enough(tokens):
            apply(places)
    for tokens, places in alike.items():
        constant = sum(token != lines.WILDCARD for token in tokens)
        able = constant >= 8 and constant >= 0.6 * len(tokens)
        if docs(places) >= enough(tokens) if constant == len(tokens) else able and docs(places) >= 3:
            apply(places)
        if able:
            leaves[len(tokens), tokens[:3]].append(tokens)
    for held in leaves.values():
        count = collections.Counter((at, token) for tokens in held for at, token in enumerate(tokens) if token != lines.WILDCARD)
        for least in (2, max(2, len(held) // 2 + 1)):
            groups = collections.defaultdict(list)
            for tokens in held:
                left = tuple(token if count[at, token] >= least else None for at, token in enumerate(tokens))
                constant = sum(token is not None for token in left)
                if len(held) > 1 and constant >= 8 and constant >= 0.6 * len(tokens):
                    groups[left] += alike[tokens]
            for places in groups.values():
                if docs(places) >= 3:
                    apply(places)
    return drop


def line_texts():
    chance = random.Random(4)
    prose = lambda n: " ".join(chance.choice("alpha beta gamma delta rho tau phi chi".split()) + chance.choice("xyzuvw") for _ in range(n))
    passage = prose(60)
    log = "Posted in the forum by member {} from the city of {} on page {}"
    notice = "To all who ask {} this house at the market of {} is closed from monday on until all pipes are mended and {} is back"
    texts = []
    for i in range(40):
        own = [prose(chance.randrange(1, 14)) for _ in range(chance.randrange(1, 5))]
        if i % 3 == 0:
            own.insert(0, passage)
        if i % 4 == 0:
            own.append(log.format(chance.choice(["ann", "bob", "cyd"]), chance.choice(["ulm", "rom"]), chance.randrange(999)))
        if i % 2 == 0:
            own.append("Share this page")
        if i % 5 == 0:  # a field in each part, and one of a pool
            own.append(notice.format(f"name{chr(97 + i % 26)}x", prose(1) + chr(97 + i % 24), chance.choice(["ann", "bob"])))
        if i == 7:
            own.append("To all who live here " + prose(19))
        if i % 9 == 0:
            own.append("Total 12 15 18 22 30 31 44" if i % 2 else "Total 9 8 7 6 5 4 3")
        texts.append("\n".join(own))
    return [*texts, None, "", "\n\n", texts[5], texts[5], "a\n" * 50 + passage, "1 2 3 4 5 6 7 8 9", "2 3 4 5 6 7 8 9 10", "x " * 3000]


def test_dropped_lines_equal_plain_comparison(spark):
    texts = line_texts()
    df = docs_of(spark, texts)
    want = plain_lines(texts)
    assert {(row.doc_id, row.line_no) for row in lines.line_ledger(df).collect()} == want and len(want) > 30
    rows = {row.doc_id: row for row in lines.cleaned(df, dropped="gone").collect()}
    for i, text in enumerate(texts):
        kept = None if text is None else "\n".join(
            line for n, line in enumerate(text.split("\n")) if (i, n) not in want
        )
        assert rows[i].text == kept
    left = lines.without_repeats(df)
    assert left.schema == df.schema
    gone = {i for i, _ in want if not re.search(WORD, rows[i].text)}
    assert sorted(row.doc_id for row in left.collect()) == sorted(set(range(len(texts))) - gone)


def test_hashing_lines_takes_no_step_per_token():
    def calls(texts):
        count = 0

        def seen(_frame, event, _arg):
            nonlocal count
            count += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            lines.Lines(texts)
        finally:
            sys.setprofile(None)
        return count

    texts = [f"zeile {i} w{i}x wort{'a' * (i % 7)}".encode() for i in range(20)]
    lines.Lines(texts)
    assert calls([b" ".join([text] * 30) for text in texts]) < calls(texts) + 30


def test_hashes_of_lines_tell_tokens_apart():
    texts = [b"a b\nab", b"ab\r\n \na\tb\x00", None, b"", b"n1 b\nn2 b\n<*> b\n n1\x0bb", b"x" * 999 + b"\n" + b"x" * 1000]
    found = lines.Lines(texts)
    assert list(zip(found.place.tolist(), found.number.tolist(), found.size.tolist(), found.constant.tolist())) == [
        (0, 0, 2, 2), (0, 1, 1, 1), (1, 0, 1, 1), (1, 2, 2, 2),
        (4, 0, 2, 1), (4, 1, 2, 1), (4, 2, 2, 1), (4, 3, 2, 1), (5, 0, 1, 1), (5, 1, 1, 1),
    ]
    line = found.line.tolist()
    assert line[1] == line[2] and line[4] == line[5] == line[6] == line[7] and len(set(line)) == 6
    raw = found.raw.to_pylist()
    assert raw[:4] == [None] * 4 and raw[6] is None and raw[4] == raw[7] != raw[5]
    assert not len(lines.Lines([]).line) and not len(lines.Lines([None, b" \n"]).raw)


def test_lines_of_odd_tables(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert lines.without_repeats(nothing).count() == 0
    # Rows that repeat a key are one document, rows without a key are left alone.
    line = "the same line of more than eight tokens in a row"
    rows = [(1, line), (1, line), (None, line), (None, line)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(row.text for row in lines.without_repeats(df).collect()) == [line] * 4


def test_rows_of_numbers_are_no_repeats(spark):
    """Lines that agree in a word and in where digits stand are not the same line, unless the digits are."""
    notice = "page {} of the rules that all who post in this forum have to read"
    texts = [
        "Total 12 15 18 22 30 31 44", "Total 9 8 7 6 5 4 3\n" + notice.format(1), "Total 9 8 7 6 5 4 3\n" + notice.format(2),
        "Total 1 1 1 1 1 1 2\n" + notice.format(3),
    ]
    found = lines.line_ledger(docs_of(spark, texts)).collect()
    assert {(row.doc_id, row.line_no) for row in found} == {(2, 0), (2, 1), (3, 1)}


def test_a_notice_with_fields_in_any_place(spark):
    notice = "To all friends of {} we are glad that you came to the fair of {} and hope to see you there next year again with {} friends"
    names, towns, many = "ann bob cyd dora eve fay gus hal".split(), "ulm rom bonn genf graz wien bern jena".split(), "few two six ten".split()
    texts = [notice.format(a, b, c) for a, b, c in zip(names, towns, many * 2)]
    found = lines.line_ledger(docs_of(spark, texts)).collect()
    assert {(row.doc_id, row.line_no) for row in found} == {(i, 0) for i in range(1, 8)}


def test_a_line_unlike_the_others_does_not_hide_their_template(spark):
    """Both have the opening of the notice, and one has nothing else in common with it."""
    start = "This notice was put up by the board of the house so that all who live here know"
    end = "when the water will be turned off by {} some day of this week"
    texts = [f"{start} {end.format(name)}" for name in ("ann", "bob", "cyd", "dora", "eve")]
    other = start + " " + " ".join(f"other{chr(97 + i)}" for i in range(len(end.split())))
    found = lines.line_ledger(docs_of(spark, [*texts, other])).collect()
    assert {(row.doc_id, row.line_no) for row in found} == {(i, 0) for i in range(1, len(texts))}


# --- search ------------------------------------------------------------------------------------


def test_search_equals_all_scores(spark):
    chance = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.round(chance.normal(size=6) * (chance.random(6) < 0.6), 1)], "x") for i in range(150)]
    rows += [(150, rows[3][1], "x"), (151, rows[3][1], "x"), (200, [], "x"), (201, None, "x"), (202, [1.0, None], "x")]
    rows += [(203, [float("nan")], "x"), (204, [float("inf"), 1.0], "x"), (None, [1.0] * 6, "x"), (100, rows[7][1], "x"), (250, [0.5] * 9, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string")
    usable = [
        (i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = collections.Counter()
    lists = collections.defaultdict(list)
    for i, q in usable:
        if i % 50 == 0:
            scored = [(-int(np.dot(q[:len(c)], c[:len(q)])), j) for j, c in usable if j != i]
            lists[i] += scored
    for i, scored in lists.items():
        want.update((i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:5], 1))
    for sizes in ((8192, 512), (16, 2)):
        found = topk.search(df, F.col("vec_id") % 50 == 0, slice_rows=sizes[0], block_rows=sizes[1]).collect()
        assert collections.Counter(map(tuple, found)) == want
    empty = spark.createDataFrame([], df.schema)
    assert topk.search(empty, F.col("vec_id") % 50 == 0).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Targets by giving up excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        room = total - sum(fixed.values())
        target = {s: room * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if target[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **target}
        fixed.update({s: 3 * sizes[s] for s in above})


def test_mix_meets_targets_and_caps(spark):
    chance = random.Random(8)
    names = ["b", "a", None, "Z", "é", "tiny", "blank"]
    sources = [chance.choices(names, [300, 20, 40, 60, 30, 2, 3])[0] for _ in range(900)]
    texts = [None if s == "blank" else "w " * int(chance.lognormvariate(3, 1)) for s in sources]
    df = docs_of(spark, texts, sources)
    rows = mixing.plan_mix(df).collect()
    size = [len(re.findall(WORD, text or "")) for text in texts]
    sizes = collections.Counter()
    for s, n in zip(sources, size):
        sizes[s] += n
    want = plain_targets(sizes)
    taken, longest = collections.Counter(), collections.Counter()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.size == size[row.doc_id] and row.source_size == sizes[row.source]
        assert row.target == pytest.approx(want[row.source])
        assert row.taken == row.copies * row.size <= 3 * row.size
        taken[row.source] += row.taken
        longest[row.source] = max(longest[row.source], row.size)
    for source in names:
        assert abs(taken[source] - want[source]) <= longest[source] / 2 + 1e-6, source
    again = mixing.plan_mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in rows)
    mixed = mixing.mixed(df)
    assert mixed.schema == df.schema
    counts = collections.Counter(row.doc_id for row in mixed.collect())
    assert counts == {r.doc_id: r.copies for r in rows if r.copies}


def test_chances_differ_and_are_met(spark):
    """Longer documents are likelier, and shares taken follow the inclusion odds."""
    texts = ["w " * (4 if i % 2 else 64) for i in range(4000)]
    df = docs_of(spark, texts, ["a" if i % 4 < 2 else "b" for i in range(4000)])
    rows = [row for row in mixing.plan_mix(df).collect() if row.source == "a"]
    share = lambda n: np.mean([row.copies for row in rows if row.size == n])
    assert share(64) / share(4) == pytest.approx((1 + 6 * mixing.LENGTH_BONUS) / (1 + 2 * mixing.LENGTH_BONUS), rel=0.1)


def test_mix_of_odd_tables(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert mixing.plan_mix(nothing).count() == mixing.mixed(nothing).count() == 0
    blank = docs_of(spark, [None, "", " "], ["a", None, "a"])
    assert {(row.taken, row.target) for row in mixing.plan_mix(blank).collect()} == {(0, 0.0)}
    same = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b", None)], "doc_id bigint, text string, source string")
    rows = mixing.plan_mix(same).collect()
    assert len(rows) == 3 and all(row.taken <= 3 * row.size for row in rows)


# --- quotes ------------------------------------------------------------------------------------

MESSAGES = "conv_id bigint, turn bigint, role string, text string, passages string"


def test_quotes_are_linked_and_removed(spark):
    first = "Where is the parcel that I ordered?\n\nIt should have come on Monday."
    rows = [
        (1, 0, "user", first),
        (1, 1, "user", "Another question altogether about refunds."),
        (1, 2, "assistant", "On Tuesday, Ann wrote:\n> Where is the parcel\n> that I ordered?\n\nIt is on its way.\n    indented stays"),
        (1, 5, "user", ">> It should have come on MONDAY!\n> It is on its way.\nThank you."),
        (1, 7, "assistant", "> Another question altogether\n> about refunds.\nYes, refunds are paid."),
        (2, 0, "user", "> Yes, refunds are paid.\nIs this so? Nobody wrote:\nnothing"),
        (2, 1, "user", "> a passage that nobody has ever written here\nhm"),
        (3, 0, "user", None), (3, 1, None, ""), (3, 1, "user", "x > y"), (None, 1, "user", "lost"), (3, None, "user", "lost"),
    ]
    df = spark.createDataFrame([(*row, "clash") for row in rows], MESSAGES)
    found = quotes.conversations(df).orderBy("conv_id", "position").collect()
    told = [(r.conv_id, r.position, r.turn, r.reply_conv, r.reply_turn, r.quote_depth) for r in found]
    assert told == [
        (1, 0, 0, None, None, 0), (1, 1, 2, 1, 0, 1), (1, 2, 5, 1, 2, 2), (1, 3, 1, None, None, 0), (1, 4, 7, 1, 1, 1),
        (2, 0, 0, 1, 7, 1), (2, 1, 1, None, None, 0), (3, 0, 0, None, None, 0), (3, 1, 1, None, None, 0), (3, 2, 1, None, None, 0),
    ]
    texts = [r.text for r in found]
    assert texts[0] == first and texts[1] == "It is on its way.\n    indented stays" and texts[2] == "Thank you."
    assert texts[5] == "Is this so? Nobody wrote:\nnothing" and texts[9] == "x > y"
    assert found[2].formatted == "<|im_start|>user\nThank you.<|im_end|>\n"
    plan = quotes.parse(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_quotes_and_originals_elsewhere_are_linked(spark):
    rows = [
        (1, 0, "user", "Yes, go on"), (1, 1, "user", "Something else"), (1, 2, "assistant", "> Yes, go on\nI will."),
        (2, 0, "user", "> Yes, go on\nA short one is not looked for elsewhere."),
        (3, 0, "user", "> The parcel is on its way to you\nIs it?"), (3, 1, "user", "The parcel is on its way to you"),
        (4, 0, "user", "The parcel is on its way to you"),
    ]
    found = quotes.conversations(spark.createDataFrame([(*row, "clash") for row in rows], MESSAGES)).collect()
    told = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in found if r.reply_conv is not None}
    assert told == {(1, 2): (1, 0), (3, 0): (4, 0)}


def plain_passages(text):
    found, run, level = [], [], None
    own = []
    for line in (text or "").split("\n"):
        marks = re.match(r"[ \t]*(?:>[ \t]?)+", line)
        depth, body = (marks[0].count(">"), line[marks.end():]) if marks else (0, line)
        if not depth:
            own.append(body)
        found.append((depth, body))
        if run and (not body.strip(" ") or depth != level):
            found.append((level, " ".join(run)))
            run = []
        if body.strip(" "):
            run, level = [*run, body], depth
    if run:
        found.append((level, " ".join(run)))
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    told = {(depth, plain(body)) for depth, body in [*found, (0, "\n".join(own))]}
    return {(depth, body) for depth, body in told if len(body) >= quotes.MIN_PASSAGE}


def test_passages_equal_reading_line_by_line(spark):
    chance = random.Random(9)
    parts = ["> ", ">", ">> ", " > > ", "", "", "\t> "]
    texts = [
        "\n".join(chance.choice(parts) + " ".join(chance.choice(["parcel", "monday", "Refund", "12", ">", "é"]) for _ in range(chance.randrange(4))) for _ in range(chance.randrange(9)))
        for _ in range(200)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    import hashlib

    for row in quotes.parse(df).collect():
        want = {(depth, hashlib.md5(body.encode()).hexdigest()) for depth, body in plain_passages(texts[row.i])}
        assert {(p.level, p.digest) for p in row.passages} == want, texts[row.i]


def test_long_conversation_is_in_order(spark):
    rows = [(1, i * 3, "user", f"message number {i} of many", "x") for i in range(500)]
    df = spark.createDataFrame(rows, MESSAGES).repartition(5)
    found = quotes.conversations(df).collect()
    assert sorted((r.position, r.turn) for r in found) == [(i, i * 3) for i in range(500)]
    assert quotes.conversations(spark.createDataFrame([], MESSAGES)).count() == 0


# --- templates ---------------------------------------------------------------------------------


def article_page(i, body):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p><p>no</p>';</script></head><body class='has-sidebar'>"
        f"<header class='site'><a>Home</a></header><div id=cookie-notice>We use cookies {i}</div><nav><ul><li>A<li>B</ul></nav>"
        f"<div class='ads-top'>Buy {i}</div>{body}<aside>More {i}</aside><form><input><button>Go</button></form>"
        f"<section class=\"comments\"><article class='comment'><p>nice {i} {'x ' * 80}</p></article></section><footer>&copy; {i}</footer>"
    )


def test_article_without_its_surroundings(spark):
    rows, want = [], {}
    for i in range(6):
        body = f"<article><header><h1>Title {i} &amp; more</h1></header><p><b>One {i}<br>two<p>Three&nbsp; <i>f</i>our &lt;b&gt; {i}<p>Share this with friends</p><ul><li>x{i}<li>y{i}</ul></article>"
        rows.append((i, f"https://ann@news.example:80/{i}", article_page(i, body)))
        want[i] = f"Title {i} & more\n\nOne {i} two\n\nThree four <b> {i}\n\nx{i}\n\ny{i}"
    for i in range(10, 14):
        body = f"<div class='page'><div class='text-{i % 1}'><h2>Head {i}</h2><div><p>{'long words here ' * 30}{i}</p></div></div></div>"
        rows.append((i, f"http://plain.example/{i}", article_page(i, body)))
        want[i] = f"Head {i}\n\n{('long words here ' * 30)}{i}"
    rows += [(20, "http://one.example/", article_page(20, "<main><p>Alone.</p></main>")), (21, None, None), (22, "", ""), (23, "x", "just text &eacute; < 3")]
    want |= {20: "Alone.", 21: "", 22: "", 23: "just text é < 3"}
    rows.append(rows[0])
    df = spark.createDataFrame([(*row, "clash") for row in rows], "page_id bigint, url string, html string, template string")
    found = templates.extract(df).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.text == want[row.page_id], row.page_id
        assert row.n_chars == len(row.text)
    assert templates.extract(spark.createDataFrame([], df.schema)).count() == 0


def test_all_parts_of_an_article_are_kept(spark):
    """Parts split by tags that every page has, second articles, and a title beside the inner element of the text."""
    body, rows, want = "words of the body " * 30, [], {}
    for i in range(4):
        marked = f"<div><h1>Title {i}</h1><div class=x><p>{body}{i}</p></div><h2>More {i}</h2><p>Short end {i}</p></div>"
        rows.append((i, f"http://split.example/{i}", f"<html><body><p>Our site</p>{marked}</body></html>"))
        want[i] = f"Title {i}\n\n{body}{i}\n\nMore {i}\n\nShort end {i}"
    rows.append((10, "http://a.example/", f"<body><article><p>{body}</p></article><article><p>Update.</p></article></body>"))
    rows.append((11, "http://b.example/", f"<body><main><h1>Head</h1><p>Lead.</p><div class=content><p>{body}</p></div></main></body>"))
    want |= {10: f"{body.strip()}\n\nUpdate.", 11: f"Head\n\nLead.\n\n{body.strip()}"}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {row.page_id: row.text for row in templates.extract(df).collect()} == want


def test_copies_are_no_template_and_long_notices_are(spark):
    body = "words of the body " * 30
    page = "<body><article><p>{0}</p><p>Lead of {0}.</p><p>{1}</p><p>End of {0}.</p></article></body>"
    rows = [(i, f"http://copies.example/{i}", page.format("one", body)) for i in range(5)]
    rows += [(i, f"http://copies.example/{i}", page.format(f"other {i}", body + str(i))) for i in range(5, 9)]
    want = {i: f"one\n\nLead of one.\n\n{body.strip()}\n\nEnd of one." for i in range(5)}
    want |= {i: f"other {i}\n\nLead of other {i}.\n\n{body}{i}\n\nEnd of other {i}." for i in range(5, 9)}
    notice = "this site is run by people who like it and all that is said here is their own view and of nobody else at all"
    for i in range(20, 24):
        rows.append((i, f"http://notice.example/{i}", f"<body><div><p>Text number {i}</p></div><div class=x><p>{notice}</p></div></body>"))
        want[i] = f"Text number {i}"
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {row.page_id: row.text for row in templates.extract(df).collect()} == want


def test_broken_markup_is_read_to_the_end():
    for source in ("<p", "<p class='x", "<!-- never closed <p>a", "</p></div>text", "<script>x", "a<b<c", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep", "<>" * 50):
        templates.main_text(templates.parse(source), None)
    assert templates.main_text(templates.parse("<p>a<script>if(x<y)'</p>'</script>b</P><p>c"), None) == "ab\n\nc"


def test_pages_equal_a_plain_reading_of_their_articles(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    text = {row.page_id: row.text for row in templates.extract(pages).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", body))
        assert text[row.page_id] == "\n\n".join(filter(None, blocks))


def test_equal_vectors_form_nested_classes():
    entries = [(1, 7, 9, 0.0), (2, 7, 9, 5.0), (3, 7, 9, 9.0), (4, 8, 6, 6.0), (5, 8, 6, 7.0), (6, 8, 6, 8.0), (7, 9, 5, 4.0), (8, 9, 5, 7.5), (9, 9, 5, 8.5)]
    template = templates.Template(entries)
    assert list(template.order) == [1, 2, 4, 5, 6, 3]  # the last class crosses gaps, so it is not valid
    page = templates.Page(tokens=[1, 50, 4, 2, 5, 51, 3])
    assert template.slots(page) == {0: 0, 2: 2, 4: 3, 6: 5}

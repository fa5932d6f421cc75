"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes, a blank and then the text. The tokens of both are sorted by start; the running
maximum of their ends tells where a token starts at or behind all ends before it, and there a group ends. Within
a group every token of the one is linked to the tokens of the other that its bytes overlap.

Both tokenizers always cut before a single blank and around a single line feed between visible characters, and before a
full stop or comma that ends a word, so a text is a sequence of pieces that are aligned on their own, all new ones of a
batch in one sort. A worker remembers a bounded number of them and keeps the most used. Whether the vocabularies allow
this is seen from them, and else a text is one piece.

How often two ids are linked in the corpus is counted inside the tasks and then summed. Counts of at most
TABLE_PAIRS pairs of ids, the most common ones, are sent to all tasks, with the highest count of each id of
the second vocabulary; links of other pairs meet their counts in a join.

Defined results: a null or empty text, and one that a tokenizer does not give back byte for byte, has no
tokens; repeated rows count each; a null key is kept; an empty table gives an empty one. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import area_for, prepare, read_table, rows_of
from chatterloom.sources.staging import StagingArea

#: Pairs of ids whose counts are sent to all tasks: 16 MB at most.
TABLE_PAIRS = 1_000_000
#: Distinct pieces that a worker remembers, and pairs that a task counts before it hands them on.
REMEMBERED_PIECES, COUNTED_PAIRS = 500_000, 500_000
_BLANK = "▁"
#: A full stop or comma behind one of these letters is a piece of its own.
_STOPS, _LAST_LETTER = frozenset(".,"), "\u024f"
_LETTER_AND_STOP = re.compile("[A-Za-z\u00c0-\u024f][.,]")
#: A single blank or line feed between visible characters.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space that touches another, that is none of the two, or that ends the text.
_IRREGULAR = re.compile(r"\s\s|[^\S \n]|\s\Z")


class Pair:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # Byte-level tokens show visible bytes as the characters of their numbers, the others as those from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [byte for byte in range(256) if byte not in shown]
        byte_of = {chr(byte): byte for byte in shown} | {chr(256 + i): byte for i, byte in enumerate(hidden)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            self.a_bytes[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(_BLANK, " ").encode() for i, piece in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.array([len(raw) for raw in held], np.int64) for held in (self.a_bytes, self.b_bytes))
        # No piece goes on behind a blank, holds a line feed or a stop behind a letter: both tokenizers cut there.
        self.can_cut = not any(_BLANK in piece.lstrip(_BLANK) or "\n" in piece or _LETTER_AND_STOP.search(piece) for piece in pieces)
        self.a_shown, self.b_shown = (
            [np.array([*(f"{i}{mark}" for i in range(len(held))), None], object)[:-1] for mark in (",", "|", ";", "")]
            for held in (self.a_bytes, self.b_bytes)
        )

    def pieces(self, text: str) -> list[str]:
        """The pieces of a blank and `text`, the blank before a word with the word."""
        whole = " " + text
        if not self.can_cut:
            return [whole]
        found: list[str] = []
        if _IRREGULAR.search(whole):
            for part in _CUT.split(whole):
                if part[0] == "\n" and len(part) > 1 and not part[1].isspace():
                    found.append("\n")
                    part = part[1:]
                self.add(part, found)
            return found
        # The common case, without looking around at every place.
        put = found.append
        mark = " "
        for line in text.split("\n"):
            if found:
                put("\n")
            for word in line.split(" "):
                last = word[-1]
                if (last == "." or last == ",") and word[-2:-1].isalpha() and word[-2] <= _LAST_LETTER:
                    put(mark + word[:-1])
                    put(last)
                else:
                    put(mark + word)
                mark = " "
            mark = ""
        return found

    @staticmethod
    def add(part: str, found: list[str]) -> None:
        if part[-1] in _STOPS and part[-2:-1].isalpha() and part[-2] <= _LAST_LETTER:
            found.append(part[:-1])
            found.append(part[-1])
        else:
            found.append(part)

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [found.ids for found in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        # The second tokenizer puts a blank first. Where the text has none, a line feed keeps the blank apart.
        b = self.b.encode([piece[1:] if piece[0] == " " else "\n" + piece for piece in pieces], num_threads=1)
        return a, [ids if piece[0] == " " else ids[2:] for piece, ids in zip(pieces, b)]

    def given_back(self, pieces: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether both tokenizers give back each piece byte for byte."""
        raw = [piece.encode() for piece in pieces]
        whole, sizes = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))

        def all_same(side: list[list[int]], held: list[bytes], size: np.ndarray) -> bool:
            ids = list(itertools.chain.from_iterable(side))
            piece = np.repeat(np.arange(len(side)), [len(found) for found in side])
            return (np.bincount(piece, size[ids], len(side)) == sizes).all() and b"".join(map(held.__getitem__, ids)) == whole

        # Pieces of the right sizes that are right end to end are right each.
        if all_same(a, self.a_bytes, self.a_size) and all_same(b, self.b_bytes, self.b_size):
            return [True] * len(pieces)
        sides = [[b"".join(map(held.__getitem__, ids)) for ids in side] for side, held in ((a, self.a_bytes), (b, self.b_bytes))]
        return [x == y == z for x, y, z in zip(raw, *sides)]


@functools.lru_cache(maxsize=2)
def tokenizers_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def coalesced(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray):
    """`(group of each A, group of each B, A of each link, B of each link)` of two sequences of intervals."""
    start, end = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.concatenate((np.ones(min(1, len(order)), bool), start[order][1:] >= reach[:-1]))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    # Overlaps of an A are the B from the first that ends behind its start to the last that starts before its end.
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    many = np.maximum(high - low, 0)
    link_a = np.repeat(np.arange(len(a_start)), many)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return group[:len(a_start)], group[len(a_start):], link_a, link_b


class Aligned:
    """Remembered pieces: for each its numbers, its groups as text and its links as codes of two ids."""

    def __init__(self, pair: Pair):
        self.pair = pair
        #: How often pieces have been numbered anew.
        self.renumbered = 0
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        #: Tokens of A, tokens of B, groups, links, and whether the piece is given back byte for byte.
        self.counts = np.zeros((0, 5), np.int64)
        self.codes = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the half of the memory that was used most."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[:REMEMBERED_PIECES // 2])
        names = list(self.number)
        self.number = {names[i]: place for place, i in enumerate(keep.tolist())}
        self.groups = [self.groups[i] for i in keep.tolist()]
        held = np.zeros(len(self.used), bool)
        held[keep] = True
        self.codes = self.codes[np.repeat(held, self.counts[:, 3])]
        self.counts, self.used = self.counts[keep], self.used[keep] // 2
        self.offsets = np.append(0, np.cumsum(self.counts[:, 3]))
        self.renumbered += 1

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of the pieces of each text; none for a text without tokens."""
        if len(self.number) > REMEMBERED_PIECES:
            self.forget()
        cut = [self.pair.pieces(text) if text and _BLANK not in text else [] for text in texts]
        new = list(set().union(*cut).difference(self.number))
        for start in range(0, len(new), 20_000):
            self.learn(new[start:start + 20_000])
        found = [np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces)) for pieces in cut]
        self.used += np.bincount(np.concatenate(found), minlength=len(self.used))
        return [at if self.counts[at, 4].all() else at[:0] for at in found]

    def learn(self, pieces: list[str]) -> None:
        a, b = self.pair.encode(pieces)
        good = self.pair.given_back(pieces, a, b)
        a, b = ([ids if ok else [] for ids, ok in zip(side, good)] for side in (a, b))
        a_ids, b_ids = (np.fromiter(itertools.chain.from_iterable(side), np.int64) for side in (a, b))
        # Pieces stand one behind the other, so that one sort aligns them all.
        a_end, b_end = np.cumsum(self.pair.a_size[a_ids]), np.cumsum(self.pair.b_size[b_ids])
        a_start, b_start = a_end - self.pair.a_size[a_ids], b_end - self.pair.b_size[b_ids]
        a_group, b_group, link_a, link_b = coalesced(a_start, a_end, b_start, b_end)
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        a_piece = np.repeat(np.arange(len(pieces)), n_a)
        n_groups = np.bincount(a_piece[np.flatnonzero(np.diff(a_group, prepend=-1))], minlength=len(pieces))
        n_links = np.bincount(a_piece[link_a], minlength=len(pieces))
        self.number.update(zip(pieces, range(len(self.groups), len(self.groups) + len(pieces))))
        self.groups += self._texts(a_ids, b_ids, a_group, b_group, n_a + n_b)
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, n_groups, n_links, np.array(good, np.int64)), 1)))
        self.codes = np.concatenate((self.codes, a_ids[link_a] << 32 | b_ids[link_b]))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(n_links)))
        self.used = np.concatenate((self.used, np.zeros(len(pieces), np.int64)))

    def _texts(self, a_ids, b_ids, a_group, b_group, n_tokens) -> list[str]:
        """The groups of each piece as text: A before B in each, every id with the mark that follows it."""
        group = np.concatenate((a_group, b_group))
        order = np.argsort(group, kind="stable")  # A comes first where groups are equal
        of_b = (order >= len(a_ids)).astype(np.int64)
        group = group[order]
        # After an id: "," in the same side, "|" before B, ";" before the next group, nothing behind a piece.
        mark = np.full(len(order), 3)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(of_b[1:] != of_b[:-1], 1, 0))
        ends = np.cumsum(n_tokens)
        mark[ends[n_tokens > 0] - 1] = 3
        shown = np.empty(len(order), object)
        ids = np.concatenate((a_ids, b_ids))[order]
        for side, tables in enumerate((self.pair.a_shown, self.pair.b_shown)):
            for kind, table in enumerate(tables):
                at = np.flatnonzero((of_b == side) & (mark == kind))
                shown[at] = table[ids[at]]
        parts = shown.tolist()
        return ["".join(parts[low:high]) for low, high in zip((ends - n_tokens).tolist(), ends.tolist())]


@functools.lru_cache(maxsize=2)
def remembered(a_path: str, b_path: str) -> Aligned:
    return Aligned(tokenizers_of(a_path, b_path))


def link_counts(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """`(a, b, n)`: how many links of all texts hold the two ids linked."""
    prepare(df.sparkSession)

    def told(codes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(codes >> 32, pa.int32()), pa.array(codes & 0xFFFFFFFF, pa.int32()), pa.array(times, pa.int64())],
            names=["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(a_path, b_path)
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in rows_of(batches):
            found = known.places(batch.column(0).to_pylist())
            often = np.bincount(np.concatenate(found), minlength=len(known.groups))
            weight = np.repeat(often, known.counts[:, 3])
            used = weight > 0
            codes, place = np.unique(np.concatenate((codes, known.codes[used])), return_inverse=True)
            summed = np.zeros(len(codes), np.int64)
            np.add.at(summed, place, np.concatenate((times, weight[used])))
            times = summed
            if len(codes) > COUNTED_PAIRS:
                yield told(codes, times)
                codes, times = codes[:0], times[:0]
        yield told(codes, times)

    parts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "a int, b int, n bigint")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _common_pairs(pairs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """`(codes, counts, whether these are all)` of at most `limit` pairs, the most common ones."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((row.level, row.n) for row in pairs.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    held, least = 0, None
    for at, n in sizes:
        if held + n > limit:
            break
        held, least = held + n, at
    table = pairs.where(level >= least if least is not None else F.lit(False)).toArrow()
    codes = table.column("a").to_numpy().astype(np.int64) << 32 | table.column("b").to_numpy().astype(np.int64)
    order = np.argsort(codes)
    return codes[order], table.column("n").to_numpy()[order], held == sum(n for _, n in sizes)


def alignments(
    df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", area: StagingArea | None = None,
    table_pairs: int = TABLE_PAIRS,
) -> DataFrame:
    """`(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)` of every row.

    `groups` lists the ids of A and B of each group, `a1,a2|b1;a3|b2,b3`. `count_sum` sums over the links how often
    their ids are linked in the corpus; `n_best` counts links whose id of B is linked with no id more often.
    """
    area = area_for(df, area)
    prepare(df.sparkSession)
    pairs = area.stage(link_counts(df, a_path, b_path, text), "pairs")
    # One row per id of the second vocabulary, and a table of fixed size.
    best = {row.b: row.n for row in pairs.groupBy("b").agg(F.max("n").alias("n")).collect()}
    highest = np.zeros(max(best, default=0) + 1, np.int64)
    highest[list(best)] = list(best.values())
    codes, counts, complete = _common_pairs(pairs, table_pairs)
    shared = df.sparkSession.sparkContext.broadcast((codes, counts, highest))
    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "part", "row", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, highest = shared.value
        known = remembered(a_path, b_path)
        # Remembered pieces may be of other texts.
        highest = np.pad(highest, (0, len(known.pair.b_bytes) - len(highest)))
        renumbered, rated, n_best, count_sum, missing = -1, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), []
        part, row = TaskContext.get().partitionId(), 0
        for batch in rows_of(batches):
            found = known.places(batch.column(1).to_pylist())
            if known.renumbered != renumbered:
                renumbered, rated, n_best, count_sum, missing = known.renumbered, 0, n_best[:0], count_sum[:0], []
            if len(known.groups) > rated:  # what new pieces add
                new = known.codes[known.offsets[rated]:]
                at = np.minimum(np.searchsorted(codes, new), max(len(codes) - 1, 0))
                held = codes[at] == new if len(codes) else np.zeros(len(new), bool)
                n = np.where(held, counts[at], 0) if len(codes) else np.zeros(len(new), np.int64)
                top = held & (n == highest[new & 0xFFFFFFFF])
                piece = np.repeat(np.arange(rated, len(known.groups)), known.counts[rated:, 3]) - rated
                size = len(known.groups) - rated
                sums = np.zeros(size, np.int64)
                np.add.at(sums, piece, n)
                n_best = np.concatenate((n_best, np.bincount(piece[top], minlength=size)))
                count_sum = np.concatenate((count_sum, sums))
                lacking: list[list[int]] = [[] for _ in range(size)]
                for i in np.flatnonzero(~held).tolist():
                    lacking[piece[i]].append(int(new[i]))
                missing += lacking
                rated = len(known.groups)
            totals = np.array([known.counts[at, :4].sum(0) for at in found], np.int64).reshape(-1, 4)
            columns = [batch.column(0), *(pa.array(totals[:, i]) for i in range(4))]
            columns += [pa.array([int(held[at].sum()) for at in found], pa.int64()) for held in (n_best, count_sum)]
            columns.append(pa.array([";".join(map(known.groups.__getitem__, at.tolist())) for at in found], pa.string()))
            rare = [[code for i in at.tolist() for code in missing[i]] if not complete else [] for at in found]
            columns += [
                pa.array([part] * len(found), pa.int32()), pa.array(range(row, row + len(found)), pa.int64()),
                pa.array(rare, pa.list_(pa.int64())),
            ]
            row += len(found)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    told = narrow.mapInArrow(
        run, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string, "
        "part int, row bigint, rare array<bigint>",
    )
    if not complete:
        told = _with_rare(area.stage(told, "aligned"), pairs, area)
    return told.drop("part", "row", "rare").withColumnRenamed("key", key)


def _with_rare(told: DataFrame, pairs: DataFrame, area: StagingArea) -> DataFrame:
    """The counts of pairs that were not sent to the tasks, added to the rows that have them."""
    best = pairs.groupBy("b").agg(F.max("n").alias("highest"))
    rated = pairs.join(best, "b").select(
        F.shiftleft(F.col("a").cast("bigint"), 32).bitwiseOR(F.col("b").cast("bigint")).alias("code"), "n", (F.col("n") == F.col("highest")).alias("top")
    )
    lacking = told.select("part", "row", F.explode("rare").alias("code")).groupBy("part", "row", "code").agg(F.count(F.lit(1)).alias("times"))
    more = lacking.join(rated, "code").groupBy("part", "row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best")
    )
    joined = told.join(area.stage(more, "rare"), ["part", "row"], "left")
    return joined.withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
    }).drop("more_sum", "more_best")


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    found = alignments(read_table(spark, sf_dir, "documents"), *public_paths())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")

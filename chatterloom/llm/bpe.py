"""Byte-level BPE over overlapping chunks, and its inverse.

A long text is cut into chunks that overlap their successors. Chunks are cut into pre-tokens in
parallel, each from its own start. A pre-token depends only on the text from its start on, so once
two neighbouring chunks share a boundary they agree from there: the text is stitched at the first
boundary that both have in their overlap. Every pre-token is merged on its own, distinct ones once. Where an overlap has
no shared boundary (one pre-token longer than the overlap) the text is cut again in one piece.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated
rows; a null key is kept; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import read_table, rows_of, prepare

#: Characters of a chunk, and of its overlap with the next one.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Distinct pre-tokens whose ids a worker remembers; the memory is emptied when full.
REMEMBERED_PIECES = 150_000

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: What follows an apostrophe to make a pre-token of its own (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    import regex

    # Runs are matched in one text of all code points; a million objects would cost a worker 100 MB.
    codes = np.arange(0x110000, dtype="<u4")
    codes = codes[(codes < 0xD800) | (codes >= 0xE000)]
    every = codes.tobytes().decode("utf-32-le")
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            table[codes[run.start():run.end()]] = kind
    return table


def boundaries(text: str) -> np.ndarray:
    """Where the pre-tokens of `text` start, then its length.

    Pre-tokens are runs of letters, numbers or other visible characters with at most one blank before
    them, contractions, and white space without the blank that belongs to what follows.
    """
    size = len(text)
    if not size:
        return np.zeros(1, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[codes]
    starts = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
    run_kinds = kinds[starts]
    ends = np.append(starts[1:], size)
    # A white space run before something visible gives up its last character, which then stands
    # alone or, if it is a blank, opens the next pre-token.
    spaces = (run_kinds == _SPACE) & (ends < size)
    lasts = ends[spaces] - 1
    glued = codes[lasts] == 0x20
    drop = np.zeros(size + 1, bool)
    drop[ends[spaces][glued]] = True
    marks = np.zeros(size + 1, bool)
    marks[starts] = True
    marks[lasts] = True
    marks[drop] = False
    # Contractions: a lone apostrophe that opens a pre-token and is followed by one of their letters.
    lone = starts[(run_kinds == _OTHER) & (ends - starts == 1) & (ends < size)]
    lone = lone[(codes[lone] == 0x27) & marks[lone]]
    for at in lone.tolist():
        if kinds[at + 1] == _LETTER:
            for rest in CONTRACTIONS:
                if text.startswith(rest, at + 1):
                    marks[at + 1] = False
                    if at + 1 + len(rest) < size:
                        marks[at + 1 + len(rest)] = True
                    break
    marks[size] = True
    return np.flatnonzero(marks)


class Vocabulary(dict):
    """Pre-token -> its ids as little-endian 32-bit integers, found by merging and remembered."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        # Columns of objects, from which numpy gathers many at once.
        self.token_bytes = np.array([*tokens, None], object)[:-1]
        self.decimals = np.array([*(b"%d," % rank for rank in range(size)), None], object)[:-1]
        self.byte_ids = np.array([self.ranks[bytes([byte])] for byte in range(256)], np.int64)
        pairs = sorted(
            (self.ranks[token[:cut]] << 32 | self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items() for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        )
        self.pair_keys, self.pair_ids = np.array(pairs, np.int64).reshape(-1, 2).T.copy()

    def learn(self, pieces: Iterable[str]) -> None:
        """Find the ids of pre-tokens that are not remembered, all of one length at a time."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            if whole is not None:
                self[piece] = _packed(whole)
            elif len(raw) > LONG_PIECE:
                self[piece] = _packed(*self.merge_long(raw))
            else:
                by_size.setdefault(len(raw), []).append((piece, raw))
        for size, group in by_size.items():
            merged = self.merge(b"".join(raw for _, raw in group), size)
            for (piece, _), ids in zip(group, merged):
                self[piece] = ids

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that pairs merge into, NEVER for pairs that do not merge."""
        pairs = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == pairs, self.pair_ids[at], NEVER)

    def merge(self, raw: bytes, size: int) -> list[bytes]:
        """The ids of pre-tokens of `size` bytes each, written one after another.

        In each round every pre-token merges its pair of lowest rank, the leftmost of equals, so all
        rows shrink by one part; rows without a pair that merges are done.
        """
        parts = self.byte_ids[np.frombuffer(raw, np.uint8)].reshape(-1, size)
        where, found = np.arange(len(parts)), [b""] * len(parts)
        pairs = self.rank_of(parts[:, :-1], parts[:, 1:])
        while len(parts):
            rows, width = np.arange(len(parts)), parts.shape[1]
            best = pairs.argmin(1) if width > 1 else np.zeros(len(parts), np.int64)
            low = pairs[rows, best] if width > 1 else np.full(len(parts), NEVER)
            done = low == NEVER
            if done.any():
                for row, ids in zip(where[done].tolist(), parts[done].astype("<u4")):
                    found[row] = ids.tobytes()
                going = ~done
                parts, pairs, where = parts[going], pairs[going], where[going]
                best, low, rows = best[going], low[going], np.arange(len(parts))
            if not len(parts):
                break
            parts[rows, best] = low
            stay = np.ones(parts.shape, bool)
            stay[rows, best + 1] = False
            parts = parts[stay].reshape(len(parts), width - 1)
            stay = np.ones(pairs.shape, bool)
            stay[rows, best] = False
            pairs = pairs[stay].reshape(len(parts), width - 2)
            after = rows[best < width - 2]
            at = best[after]
            pairs[after, at] = self.rank_of(parts[after, at], parts[after, at + 1])
            before = rows[best > 0]
            at = best[before]
            pairs[before, at - 1] = self.rank_of(parts[before, at - 1], parts[before, at])
        return found

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one pre-token of any length, with a heap of pairs and linked parts."""
        ranks, size = self.ranks, len(piece)
        end = list(range(1, size + 1))  # of the part that starts here
        before = list(range(-1, size - 1))  # start of the part before
        heap = [
            (ranks[piece[i:i + 2]], i, i + 1, i + 2) for i in range(size - 1) if piece[i:i + 2] in ranks
        ]
        heapq.heapify(heap)
        alive = [True] * size
        while heap:
            _, left, middle, right = heapq.heappop(heap)
            if not (alive[left] and end[left] == middle and middle < size and alive[middle] and end[middle] == right):
                continue
            end[left], alive[middle] = right, False
            if right < size:
                before[right] = left
                rank = ranks.get(piece[left:end[right]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, right, end[right]))
            if left:
                rank = ranks.get(piece[before[left]:right])
                if rank is not None:
                    heapq.heappush(heap, (rank, before[left], left, right))
        ids, at = [], 0
        while at < size:
            ids.append(ranks[piece[at:end[at]]])
            at = end[at]
        return ids

    def encode(self, texts: list[tuple[str, np.ndarray]]) -> list[bytes]:
        """The ids of each text, given with its boundaries."""
        if len(self) > REMEMBERED_PIECES:
            self.clear()
        cut = [[text[a:b] for a, b in itertools.pairwise(marks.tolist())] for text, marks in texts]
        self.learn(set().union(*cut).difference(self))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.token_bytes[ids].tolist())

    def in_decimal(self, ids: np.ndarray) -> bytes:
        return b"".join(self.decimals[ids].tolist())[:-1]


NEVER = 1 << 62
#: Pre-tokens of more bytes are merged one at a time.
LONG_PIECE = 48


def _packed(*ids: int) -> bytes:
    return np.array(ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stitch(chunks: list[tuple[int, str, np.ndarray]]) -> np.ndarray | None:
    """The boundaries of a whole text from those of its chunks `(start, text, boundaries)`.

    None if some overlap has no boundary that both sides share. A boundary of the earlier chunk counts
    only if the pre-token that ends there cannot go on behind the chunk.
    """
    joined: list[np.ndarray] = []
    begin = 0
    for (start, text, marks), following in itertools.zip_longest(chunks, chunks[1:]):
        own = marks + start
        if following is None:
            joined.append(own[own >= begin])
            break
        safe = own[own < start + len(text) - 1]
        shared = np.intersect1d(safe, following[2] + following[0])
        shared = shared[shared >= begin]
        if not len(shared):
            return None
        joined.append(own[(own >= begin) & (own < shared[0])])
        begin = int(shared[0])
    return np.concatenate(joined)


def _without_overlaps(chunks: list[tuple[int, str, np.ndarray]]) -> str:
    return "".join(
        text if following is None else text[:following[0] - start]
        for (start, text, _), following in itertools.zip_longest(chunks, chunks[1:])
    )


def _encode_chunks(path: str, chunks: list[tuple[int, str, np.ndarray]]) -> bytes:
    vocab = vocabulary(path)
    text = _without_overlaps(chunks)
    marks = stitch(chunks)
    return vocab.encode([(text, boundaries(text) if marks is None else marks)])[0]


def encode(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """`(key, ids array<int>)`: the ids of every whole text.

    Texts of one chunk are encoded where they are read. Only longer ones are exploded into chunks,
    whose boundaries are found by different tasks and come together per text.
    """
    prepare(df.sparkSession)
    narrow = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ids array<int>"

    def ids_batch(keys: pa.Array, found: list[bytes]) -> pa.RecordBatch:
        values = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
        offsets = np.cumsum([0, *(len(ids) // 4 for ids in found)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
        return pa.RecordBatch.from_arrays([keys, lists], names=["key", "ids"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in rows_of(batches):
            found = vocab.encode([(value, boundaries(value)) for value in batch.column(1).to_pylist()])
            yield ids_batch(batch.column(0), found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            marks = [boundaries(value).tobytes() for value in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(marks, pa.binary())],
                names=["row_id", "key", "start", "text", "marks"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                chunks = sorted(
                    (part["start"], part["text"], np.frombuffer(part["marks"], np.int64))
                    for part in row.column(1).to_pylist()[0]
                )
                yield ids_batch(row.column(0), [_encode_chunks(path, chunks)])

    length = F.length("text")
    single = narrow.where(length <= chunk_chars).mapInArrow(short, schema)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk_chars))
    chunks = (
        narrow.where(length > chunk_chars)
        .withColumn("row_id", F.monotonically_increasing_id())
        .withColumn("start", F.explode(starts))
        .select(
            "row_id", "key", F.col("start").cast("bigint").alias("start"),
            F.substring(F.col("text"), F.col("start") + 1, F.lit(chunk_chars + overlap)).alias("text"),
        )
        .repartition(F.col("row_id"), F.col("start"))
    )
    stitched = (
        chunks.mapInArrow(cut, f"row_id bigint, key {kind}, start bigint, text string, marks binary")
        .groupBy("row_id")
        .agg(F.first("key").alias("key"), F.collect_list(F.struct("start", "text", "marks")).alias("parts"))
        .select("key", "parts")
        .mapInArrow(join, schema)
    )
    return single.unionByName(stitched).withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`(key, bytes binary)`: the raw bytes that the ids stand for, without regard to characters."""
    narrow = df.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in rows_of(batches):
            column = batch.column(1)
            found = [vocab.decode(_row(column, i)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "bytes"])

    return narrow.mapInArrow(run, f"key {kind}, bytes binary").withColumnRenamed("key", key)


def _row(column: pa.ListArray, i: int) -> np.ndarray:
    first, last = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    return column.values.slice(first, last - first).to_numpy(zero_copy_only=False)


def digests(
    encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", keep_ids: bool = False
) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids in decimal and of the decoded bytes, the ids if wanted."""
    narrow = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in rows_of(batches):
            column = batch.column(1)
            sizes, ids_digest, bytes_digest = [], [], []
            for i in range(batch.num_rows):
                row = _row(column, i)
                sizes.append(len(row))
                ids_digest.append(hashlib.sha256(vocab.in_decimal(row)).hexdigest())
                bytes_digest.append(hashlib.sha256(vocab.decode(row)).hexdigest())
            columns = [pa.array(sizes, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(bytes_digest, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(column)
                names.append("ids")
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return narrow.mapInArrow(
        run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    ).withColumnRenamed("key", key)


def multilingual_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    path = multilingual_path()
    return digests(encode(read_table(spark, sf_dir, "documents"), path), path)

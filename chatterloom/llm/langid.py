"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word
is the sum over all ways to cut it into pieces, found by the forward algorithm; that of a text is the
product over its words, since pieces do not cross words. The probabilities are fitted by expectation
maximisation on a bounded sample of labelled rows. Prediction reads every text whole.

Words are runs of letters in lower case behind a word mark. Stretches of MAX_LETTERS letters without a
break are words of their own. A letter that no piece covers costs UNKNOWN in every language.

Defined results: a null text, or one without a letter, is `und` with score 0, as is everything if no row
is labelled; a row without a key is never held out and never learned from; repeated rows give repeated
rows; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.bpe import _LETTER, _classes
from chatterloom.llm.common import prepare, read_table, rows_of

#: Bounds of the sample that the model is fitted on: languages (the ones with most labelled rows),
#: labelled rows of each, and distinct words of each (the commonest).
MAX_LANGUAGES, SAMPLE_ROWS, SAMPLE_WORDS = 200, 400, 20_000
ROUNDS = 3
SMOOTHING = 0.1
UNKNOWN = 1e-7
MAX_LETTERS = 32
#: Scores of distinct words, one per language, that a worker remembers; the memory is emptied when full.
REMEMBERED_SCORES = 1_000_000
#: Words times languages that are scored at once.
SCORED_AT_ONCE = 32_768
UNDETERMINED = "und"
_MARK = "▁"


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[str, ...]:
    """The pieces of letters of a vocabulary file, in lower case, with the word mark where they have it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = {
        model.id_to_piece(i).lower() for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }
    letters = lambda piece: all(_classes()[ord(c)] == _LETTER for c in piece.removeprefix(_MARK))
    return tuple(sorted(piece for piece in every if letters(piece)))


class Trie:
    """Pieces as arrays: edges (node, character) -> node, and the piece that ends at a node."""

    def __init__(self, held: tuple[str, ...]):
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(held):
            at = 0
            for character in piece:
                at = nodes.setdefault((at, ord(character)), len(nodes) + 1)
            ends[at] = number
        keys = np.array([node << 21 | code for node, code in nodes], np.int64).reshape(-1)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.targets = np.array(list(nodes.values()), np.int64).reshape(-1)[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.size = len(held)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node behind each edge, -1 where there is none."""
        wanted = nodes << 21 | codes
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], -1)


def arcs(trie: Trie, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """`(start, end, rows, pieces)` of all pieces in words of one length, in order of their starts."""
    found = []
    width = codes.shape[1]
    for start in range(width):
        rows, nodes = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for end in range(start, width):
            nodes = trie.step(nodes, codes[rows, end])
            alive = nodes >= 0
            rows, nodes = rows[alive], nodes[alive]
            if not len(rows):
                break
            piece = trie.piece[nodes]
            ends = piece >= 0
            if ends.any():
                found.append((start, end + 1, rows[ends], piece[ends]))
    return found


def forward(codes: np.ndarray, found: list, probability: np.ndarray) -> np.ndarray:
    """`(words, positions, languages)`: probability of all ways to reach a position."""
    alpha = np.zeros((len(codes), codes.shape[1] + 1, probability.shape[1]))
    alpha[:, 0] = 1
    by_start = {start: list(group) for start, group in itertools.groupby(found, lambda arc: arc[0])}
    for start in range(codes.shape[1]):
        alpha[:, start + 1] += alpha[:, start] * UNKNOWN
        for _, end, rows, piece in by_start.get(start, ()):
            alpha[rows, end] += alpha[rows, start] * probability[piece]
    return alpha


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`(places, codes)` of words behind the word mark, all of one length at a time."""
    sizes = np.array([len(word) for word in words])
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        text = "".join(_MARK + words[i] for i in places.tolist())
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        yield places, codes.reshape(len(places), size + 1)


def log_scores(trie: Trie, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """The log probability of every word in every language."""
    total = np.zeros((len(words), probability.shape[1]))
    for places, codes in by_length(words):
        step = max(1, SCORED_AT_ONCE // probability.shape[1])
        for start in range(0, len(places), step):
            part = codes[start:start + step]
            total[places[start:start + step]] = np.log(forward(part, arcs(trie, part), probability)[:, -1])
    return total


def fit_language(trie: Trie, counts: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities that make counted words likely, by expectation maximisation."""
    words = list(counts)
    weight = np.array([counts[word] for word in words], float)
    probability = np.full((trie.size, 1), 1 / max(trie.size, 1))
    groups = [(places, codes, arcs(trie, codes)) for places, codes in by_length(words)] if words else []
    for _ in range(rounds):
        expected = np.full(trie.size, SMOOTHING)
        for places, codes, found in groups:
            alpha = forward(codes, found, probability)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[:, -1] = 1
            backward = sorted(found, key=lambda arc: -arc[0])
            by_start = {start: list(group) for start, group in itertools.groupby(backward, lambda arc: arc[0])}
            for start in range(codes.shape[1] - 1, -1, -1):
                beta[:, start] += beta[:, start + 1] * UNKNOWN
                for _, end, rows, piece in by_start.get(start, ()):
                    beta[rows, start] += beta[rows, end] * probability[piece, 0]
            share = weight[places] / alpha[:, -1]
            for start, end, rows, piece in found:
                used = alpha[rows, start] * probability[piece, 0] * beta[rows, end] * share[rows]
                expected += np.bincount(piece, used, trie.size)
        probability = (expected / expected.sum())[:, None]
    return probability[:, 0]


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, longer ones in stretches."""
    if not text:
        return []
    text = text.lower()
    letters = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == _LETTER
    edges = np.flatnonzero(np.diff(letters, prepend=False, append=False)).tolist()
    found = []
    for start, end in zip(edges[::2], edges[1::2]):
        if end - start <= MAX_LETTERS:
            found.append(text[start:end])
        else:
            found += [text[i:min(i + MAX_LETTERS, end)] for i in range(start, end, MAX_LETTERS)]
    return found


class Model:
    """Languages and their piece probabilities; scores of words are remembered."""

    def __init__(self, path: str, languages: list[str], probability: np.ndarray):
        self.path, self.languages, self.probability = path, languages, probability
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)))

    def __getstate__(self):
        return self.path, self.languages, self.probability

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [words_of(text) for text in texts]
        if self.table.size > REMEMBERED_SCORES:
            self._forget()
        new = list(set().union(*cut).difference(self.places)) if self.languages else []
        if new:
            self.table = np.concatenate([self.table, log_scores(_trie(self.path), self.probability, new)])
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        found = []
        for words in cut:
            if not words or not self.languages:
                found.append((UNDETERMINED, 0.0))
                continue
            at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
            total = self.table[at].sum(0)
            best = int(total.argmax())
            found.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return found


@functools.lru_cache(maxsize=2)
def _trie(path: str) -> Trie:
    return Trie(pieces(path))


def fit(df: DataFrame, path: str, learn: Column, key: str, text: str, lang: str) -> Model:
    """A model from a bounded sample of the rows for which `learn` holds and the language is known."""
    prepare(df.sparkSession)
    labelled = df.where(learn & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    chosen = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    # The rows of least hash are taken. Of a language with many, those beyond a share that surely holds
    # them are left out before rows are ranked, so that one language is no burden to one task.
    share = F.xxhash64("key") / F.lit(2.0**64) + 0.5
    sample = (
        labelled.select("lang", "key").join(F.broadcast(chosen), "lang")
        .where(share * F.col("n") <= 8 * SAMPLE_ROWS)
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_ROWS)
        .select("lang", "key").distinct()
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            counts: Counter = Counter()
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update(zip(itertools.repeat(language), words_of(value)))
            languages, words = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(languages, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    texts = labelled.join(F.broadcast(sample), ["lang", "key"], "left_semi").select("lang", "text")
    counted = texts.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = counted.withColumn("place", F.row_number().over(top)).where(F.col("place") <= SAMPLE_WORDS).select("lang", "word", "n")
    counts: dict[str, dict[str, int]] = {}
    for row in rows.toLocalIterator():
        counts.setdefault(row.lang, {})[row.word] = row.n
    languages = sorted(counts)
    trie = _trie(path)
    columns = [fit_language(trie, counts[language]) for language in languages]
    return Model(path, languages, np.stack(columns, 1) if columns else np.zeros((trie.size, 0)))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(key, lang_pred, score)`: the likeliest language of every whole text and its posterior."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=["key", "lang_pred", "score"],
            )

    return narrow.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning; null for rows without a key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, pieces_path(), ~held_out(), "doc_id", "text", "lang")
    return identify(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )

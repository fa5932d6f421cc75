"""Secrets in texts: fixed patterns, and the guess cost of values that stand in a credential context.

The guess cost of a value is the least number of guesses, as a power of ten, over all ways to cut it
into dictionary words, dates, repeats, keyboard walks, letter or digit runs and brute-force spans; it
is found by dynamic programming over end positions. Values that would take many guesses are secrets;
placeholders such as "changeme" or "aaaa1111" are not.

Defined results: a null or empty text has no spans; repeated rows give repeated rows; a null key is
kept; an empty table gives an empty one; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import read_table, rows_of, prepare

#: Kinds of spans in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6

#: Further credential contexts, whose values may hold any printable character (fixed values).
_CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret)"""
    r"""[_-]?key|auth(?:orization)?|bearer|client[_-]?secret)["']?[\x20\t]*[:=][\x20\t]*(?ai:(?:bearer|basic)\x20+)?"""
    r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))"""
)
_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s:/@]+)@")
#: A context value must take at least 10 ** MIN_GUESSES guesses to be a secret.
MIN_GUESSES = 10.0

#: Words that people use in passwords and placeholders, commonest first (fixed values).
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "secret", "token", "letmein", "qwerty", "monkey",
    "dragon", "master", "test", "user", "guest", "root", "changeme", "default", "example", "sample",
    "demo", "public", "private", "access", "key", "none", "null", "true", "false", "your", "here",
    "insert", "enter", "value", "string", "replace", "placeholder", "redacted", "hidden", "xxxx",
    "love", "sunshine", "princess", "football", "baseball", "shadow", "superman", "batman",
    "freedom", "whatever", "trustno", "hello", "summer", "winter", "spring", "autumn", "monday",
    "friday", "january", "march", "april", "june", "july", "august", "company", "server", "system",
    "the", "and", "for", "with", "this", "that", "from", "my", "is", "of", "to", "in", "on", "new",
    "old", "pass", "word", "code", "auth", "bearer", "basic", "api", "client", "database", "db",
    "prod", "dev", "staging", "local", "service", "account", "email", "name", "house", "computer",
)
_RANK = {word: rank for rank, word in enumerate(COMMON_WORDS, 1)}
_LONGEST_WORD = max(map(len, COMMON_WORDS))
#: Characters often put in place of letters (fixed values).
_LEET = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
#: Rows of a keyboard (fixed values).
KEYBOARD_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {key: (row, place) for row, keys in enumerate(KEYBOARD_ROWS) for place, key in enumerate(keys)}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|"
                   r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
_REPEAT = re.compile(r"(.{1,8}?)\1+", re.S)
#: Cost of opening a brute-force span, and of each of its characters.
_OPEN, _PER_CHAR = 0.5, 1.0


def _runs(value: str, step) -> Iterator[tuple[int, int]]:
    """Maximal stretches of at least 3 characters of which `step` holds for all neighbours."""
    start = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not step(value[i - 1], value[i]):
            if i - start >= 3:
                yield start, i
            start = i


def _adjacent(a: str, b: str) -> bool:
    if a not in _KEY or b not in _KEY:
        return False
    (row, place), (other, at) = _KEY[a], _KEY[b]
    return abs(row - other) <= 1 and abs(place - at) <= 1


def segments(value: str) -> list[tuple[int, int, float]]:
    """`(start, end, log10 guesses)` of everything in `value` that can be guessed as one thing."""
    lower = value.lower()
    plain = lower.translate(_LEET)
    found = []
    for start in range(len(value)):
        for end in range(start + 2, min(start + _LONGEST_WORD, len(value)) + 1):
            rank = _RANK.get(lower[start:end])
            extra = 1
            if rank is None:
                rank, extra = _RANK.get(plain[start:end]), 4
            if rank is not None:
                upper = sum(map(str.isupper, value[start:end]))
                case = 1 if not upper else 2 if upper in (1, end - start) else 2 ** min(upper, 16)
                found.append((start, end, math.log10(rank * extra * case) if rank > 1 or extra * case > 1 else 0.1))
    for match in _DATE.finditer(value):
        found.append((*match.span(), math.log10(120 if len(match[0]) == 4 else 120 * 365)))
    for match in _REPEAT.finditer(value):
        unit = len(match[1])
        found.append((*match.span(), unit * _PER_CHAR + math.log10(len(match[0]) // unit)))
    for start, end in _runs(lower, _adjacent):
        found.append((start, end, math.log10(47 * 8 * (end - start))))
    for change in (1, -1):
        for start, end in _runs(value, lambda a, b, change=change: ord(b) - ord(a) == change):
            found.append((start, end, math.log10(26 * (end - start))))
    return found


def guess_cost(value: str) -> float:
    """The least log10 number of guesses over all segmentations of `value`."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in segments(value):
        ending.setdefault(end, []).append((start, cost))
    # best[j]: cheapest way to end at j; brute[j]: cheapest whose last span is brute force.
    best, brute = [0.0] * (len(value) + 1), [math.inf] * (len(value) + 1)
    for end in range(1, len(value) + 1):
        brute[end] = min(brute[end - 1], best[end - 1] + _OPEN) + _PER_CHAR
        best[end] = min(brute[end], *(best[start] + cost for start, cost in ending.get(end, ())), math.inf)
    return best[-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [
        (*match.span(), "assign") for match in _ASSIGN.finditer(text)
        if len(match[2]) >= MIN_ASSIGNED
    ]
    found += [(*match.span(), "access") for match in _ACCESS.finditer(text)]
    found += [(*match.span(), "hex") for match in _HEX.finditer(text)]
    return found


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values of credential contexts stand."""
    if ":" not in text and "=" not in text:
        return
    for match in _CONTEXT.finditer(text):
        yield match.span(match.lastindex)
    if "://" in text:
        for match in _LOGIN.finditer(text):
            yield match.span(1)


def scan(text: str, min_guesses: float = MIN_GUESSES) -> tuple[list, list, float | None]:
    """Base spans, all spans (`(start, end, kind)`, sorted), and the highest guess cost of a value."""
    base = base_spans(text)
    spans, highest = list(base), None
    taken = sorted(base)
    for start, end in sorted(set(context_values(text))):
        cost = guess_cost(text[start:end])
        highest = cost if highest is None else max(highest, cost)
        if cost >= min_guesses and not any(a < end and start < b for a, b, _ in taken):
            spans.append((start, end, "guess"))
            taken.append((start, end, "guess"))
    order = lambda span: (span[0], KINDS.index(span[2]), span[1])
    return sorted(base, key=order), sorted(spans, key=order), highest


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_guesses: float = MIN_GUESSES
) -> DataFrame:
    """Per row: counts per base kind, digest of the base spans, all spans, highest guess cost."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            counts, digests, every, costs = {k: [] for k in KINDS}, [], [], []
            for value in batch.column(1).to_pylist():
                base, spans, highest = scan(value or "", min_guesses)
                for kind in KINDS:
                    counts[kind].append(sum(span[2] == kind for span in spans))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                every.append(_joined(spans))
                costs.append(highest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(counts[kind], pa.int64()) for kind in KINDS[:3]),
                    pa.array(digests, pa.string()), pa.array(every, pa.string()),
                    pa.array(counts["guess"], pa.int64()), pa.array(costs, pa.float64()),
                ],
                names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guess_cost"],
            )

    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"key {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "spans string, n_guess bigint, max_guess_cost double",
    ).withColumnRenamed("key", key)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))

"""Vectorised word and hash work on a buffer of many texts.

Texts of a batch are laid end to end as UTF-8, a separator between them, and cut into words with byte tables; words get
64-bit polynomial hashes from one prefix sum. All arithmetic is modulo 2**64 with an odd base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHECK_BASE = 0xD1342543DE82EF95
CHECK_INVERSE = pow(CHECK_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 19
BATCH_ROWS = 512

_letter_values = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python workers at most ``BATCH_ROWS`` at a time: their memory is beside the executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry boolean table, true inside the given inclusive byte ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Words are maximal runs of bytes in these tables.
NOT_SPACE = ~table((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF), (0x41, 0x5A))
LETTERS = table((0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), base, U64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits of its input."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """P with P[i] = hash sum of raw[:i]; the hash of raw[s:e] is (P[e] - P[s]) / base**s."""
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(_letter_values[raw] * powers(len(raw)), out=out[1:])
    return out


def check_prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a second hash over ``raw``, of its 8-byte windows and so not a polynomial of its bytes: windows that begin in
    [s, e) add up to P[e] - P[s], which belongs to raw[s : e + 7]."""
    padded = np.concatenate([raw, np.zeros(7, np.uint8)])
    windows = np.ndarray((len(raw),), "<u8", padded.tobytes(), strides=(1,))
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(mix(windows + U64(BASE)) * powers(len(raw), CHECK_BASE), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    """Position-free hashes of the spans [start, end) of the buffer behind ``prefix``."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse)[start])


def chunks(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """Groups of encoded texts of about CHUNK_BYTES with the index of their first; a null is an empty text."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode() if t is not None else b""
        if held and total + len(b) > CHUNK_BYTES:
            yield first, held
            first, held, total = i, [], 0
        held.append(b)
        total += len(b) + 1
    if held:
        yield first, held


def words(encoded: list[bytes], is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text index of each word, hash of each word) over a chunk."""
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    if lower:
        raw = LOWER[raw]
    inside = is_word[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edges[0::2], edges[1::2]
    ends = np.cumsum(np.fromiter((len(b) + 1 for b in encoded), np.int64, len(encoded)))
    return np.searchsorted(ends, start, side="right"), span_hashes(prefix_hashes(raw), start, end)

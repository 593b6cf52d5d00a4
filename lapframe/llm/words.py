"""Vectorised word splitting and hashing over Arrow string buffers.

A task sees its texts as one UTF-8 buffer. White space is ``[\\x20\\x09-\\x0D]`` and
lower-casing touches A-Z only, so both work on bytes and need no decoding. Word and
phrase hashes are 64-bit polynomial hashes taken from running sums, mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; longer single texts form a piece of their own.
PIECE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL_BYTE = np.uint64(0x9E3779B97F4A7C15)
_MUL_WORD = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(mul: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mul**i and mul**-i modulo 2**64 for i < n."""
    have = _powers.get(int(mul))
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + 1024)
        inverse = np.uint64(pow(int(mul), -1, 2**64))
        tables = []
        for m in (mul, inverse):
            t = np.full(size, m, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 4 * PIECE_BYTES:
            return tables[0], tables[1]
        have = _powers[int(mul)] = (tables[0], tables[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about PIECE_BYTES. Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def split(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the first word of each row (one entry more than rows)."""
    sep = np.ones(len(data) + 2, bool)
    sep[1:-1] = is_sep[data]
    # A word ends at its row's end even where no separator follows.
    inner = offsets[1:-1]
    word = ~sep[1:-1]
    start = word & sep[:-2]
    end = word & sep[2:]
    cut = inner[(inner > 0) & (inner < len(data))]
    start[cut] |= word[cut]
    end[cut - 1] |= word[cut - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(_MUL_BYTE, len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * inverse[starts])


def phrase_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each n consecutive words: entry i covers words i to i+n-1, whatever row they are in."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = mix(hashes + np.uint64(seed)) if seed else hashes
    power, inverse = _power_tables(_MUL_WORD, len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=run[1:])
    return mix((run[n:] - run[:m]) * inverse[:m] + np.uint64(n))


def row_of_words(first_word: np.ndarray) -> np.ndarray:
    """Row of each word."""
    return np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))

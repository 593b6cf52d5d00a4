"""Token ids of whole texts, encoding each distinct piece of text once while it is remembered.

BPE never merges across the pieces that a tokenizer's own splitting rule makes, so a
text's ids are those of its pieces in turn, and pieces repeat far more than texts do.
Pieces are found on the bytes of a whole Arrow buffer at once and looked up by hash in
a table of fixed size; the ``tokenizers`` library encodes those that the table lacks.
Texts with bytes for which the byte rule isn't sure (letters beyond Latin-1, contractions,
literal added tokens), and any tokenizer with another rule, are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import mix, pieces, word_hashes

# The two splitting patterns as the tokenizer files give them.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Slots of a worker's table of pieces, and the ids it holds before it starts anew.
SLOTS, POOL_IDS = 1 << 20, 4_000_000

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: Bytes that the byte rule knows: printable ASCII, tab, line ends, and U+00C0 to U+00FF.
_SURE = np.zeros(256, bool)
_SURE[[0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Encoder:
    """Encodes Arrow string arrays with one tokenizer file."""

    def __init__(self, path: str, plain: bool = False):
        """``plain``: strings of special tokens inside texts are text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        split, norm, post = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("post_processor")
        self.rule = ""
        if spec["model"]["type"] == "BPE" and not spec["model"].get("byte_fallback") and (not post or post["type"] == "ByteLevel"):
            if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not norm:
                self.rule = "byte level"
            elif split.get("type") == "Sequence" and split["pretokenizers"][0].get("pattern") == {"Regex": WORD_END_PATTERN} and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.rule = "word end"
        self.symbols = np.array([ord(c) for c in byte_symbols()], "<u2")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.count = np.zeros(SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array):
        """Yields (first row, ids of a run of rows, offsets of each row in them). Null is empty."""
        for first, data, offsets in pieces(texts):
            yield first, *self._run(data, offsets)

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        odd = np.ones(n, bool) if not self.rule else self._odd_rows(data, offsets)
        if odd.all():
            ids, counts = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        else:
            ids, counts = self._by_piece(data, offsets)
        if odd.any():
            at = np.concatenate([[0], np.cumsum(counts)])
            parts = [self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()) if odd[i] else ids[at[i] : at[i + 1]] for i in range(n)]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odd = ~_SURE[data]
        after = np.append(data[1:], np.uint8(0x20))
        odd |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))
        odd |= (data == 0x27) & (_CLASS[after] == _LETTER)
        rows = np.zeros(len(offsets) - 1, bool)
        rows[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        for content in self.added:
            raw, i = data.tobytes(), -1
            while (i := raw.find(content, i + 1)) >= 0:
                rows[np.searchsorted(offsets, i, side="right") - 1] = True
        return rows

    def _by_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _CLASS[data]
        n = len(data)
        first = np.zeros(n + 1, bool)  # of a row
        first[offsets] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= first[:n]
        space = kind == _SPACE
        if self.rule == "byte level":
            start = change.copy()
            # A run of other bytes takes one blank before it.
            after_blank = np.zeros(n, bool)
            after_blank[1:] = change[1:] & ~space[1:] & (data[:-1] == 0x20) & ~first[1:n]
            start[after_blank] = False
            start[:-1] |= after_blank[1:]
            # The last byte of white space before another byte stands alone.
            alone = np.zeros(n, bool)
            alone[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
            start |= alone
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], n)
        else:
            data = _ASCII_LOWER[data]
            upper = np.zeros(n, bool)
            upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            data[upper] += 32
            start = (change | (kind == _DIGIT)) & ~space
            end = np.append(change[1:] | (kind[1:] == _DIGIT), True) & ~space
            starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        at, count = self._lookup(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(at - total[:-1], count) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each piece."""
        h = word_hashes(data, starts, ends, False) | np.uint64(1)
        slot = (mix(h) % np.uint64(SLOTS)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != h)
        if not len(missing):
            return self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        if self.used > POOL_IDS:
            self._clear()
            missing = np.arange(len(h))
        _, pick, back = np.unique(h[missing], return_index=True, return_inverse=True)
        pick = missing[pick]
        tokenize, text = self.tokenizer.model.tokenize, self.symbols[data].tobytes().decode("utf-16-le")
        made = [[t.id for t in tokenize(text[a:b])] for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
        counts = np.array([len(m) for m in made], np.int64)
        places = self.used + np.concatenate([[0], np.cumsum(counts)])
        while places[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : places[-1]] = np.fromiter(chain.from_iterable(made), np.uint32, int(counts.sum()))
        self.used = int(places[-1])
        at, count = self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        at[missing], count[missing] = places[:-1][back], counts[back]
        self.keys[slot[pick]], self.at[slot[pick]], self.count[slot[pick]] = h[pick], places[:-1], counts
        # Of two new pieces for one slot the last written one has it, in all three columns.
        return at, count


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

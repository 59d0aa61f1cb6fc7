"""Token ids of a byte-level BPE file with word ends, with a cache of words in front of the tokenizer.

The tokenizer normalises (NFC, white space, lower case), splits by a pattern and encodes each piece by itself, so
pieces can be cached. In texts of ASCII and accented Latin-1 letters, where NFC changes nothing and the pattern's
classes are known in full, pieces are found and hashed as byte runs of a whole chunk at once and only pieces not seen
before go to the tokenizer's model; all other texts, and those that hold the literal of an added token in any case, go to
the tokenizer whole. Pieces are known by 64-bit hashes.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from skyloom.llm.tokens import LOWER, span_hashes, utf8_view

#: Byte classes of the split pattern: space 0, letter 1, digit 2, other 3.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
#: The contractions that the pattern takes as pieces after an apostrophe.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pieces kept per process; when full, the cache starts anew.
CACHE_PIECES = 1_000_000


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self._clear()

    def _clear(self) -> None:
        # pieces in order of their hashes: where the ids of each begin in ids, and how many they are
        self.hashes, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 14, np.uint16), 0

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        tokenize, signs = self.tokenizer.model.tokenize, self.signs
        flat, count = [], []
        for piece in pieces:
            tokens = tokenize(piece.decode("latin-1") if piece.isalnum() else piece.decode("latin-1").translate(signs))
            flat += [t.id for t in tokens]
            count.append(len(tokens))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        n = np.array(count, np.int32)
        at = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(n, dtype=np.int32) - n)
        self.count = np.insert(self.count, at, n)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of texts, one after the other, and where each text's begin (and the end). Null is empty."""
        data, offsets = utf8_view(column)
        rows = len(column)
        high = data >= 0x80
        lead = data == 0xC3
        after = np.concatenate(([False], lead[:-1])) & high
        odd_byte = (high & ~lead & ~after) | (after & ((data == 0x97) | (data == 0xB7)))
        before = np.concatenate(([0], np.cumsum(odd_byte)))
        odd = before[offsets[1:]] > before[offsets[:-1]]
        data = LOWER[data]
        odd |= self._holds_added(data, offsets)
        data = data + np.where(after & (data < 0x9F), np.uint8(0x20), np.uint8(0))
        piece_hash, piece_row = self._pieces(data, offsets, odd)
        per_row = np.bincount(piece_row, self.count[piece_hash], rows).astype(np.int64) if len(piece_row) else np.zeros(rows, np.int64)
        n, begin = self.count[piece_hash].astype(np.int64), self.begin[piece_hash]
        at = np.cumsum(n) - n
        flat = self.ids[np.arange(int(n.sum())) + np.repeat(begin - at, n)]
        which = np.flatnonzero(odd)
        if not len(which):
            return flat, np.concatenate(([0], np.cumsum(per_row)))
        whole = self.tokenizer.encode_batch([column[int(i)].as_py() for i in which], add_special_tokens=False)
        cut = np.concatenate(([0], np.cumsum(per_row)))
        parts = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
        for i, e in zip(which, whole):
            parts[i] = np.array(e.ids, np.uint16)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _holds_added(self, data, offsets) -> np.ndarray:
        """Which rows hold the literal of an added token."""
        out, raw = np.zeros(len(offsets) - 1, bool), data.tobytes()
        for literal in filter(None, self.added):
            at = raw.find(literal)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                out[row] = True
                at = raw.find(literal, max(at + 1, int(offsets[row + 1]) - len(literal)))
        return out

    def _pieces(self, data, offsets, odd) -> tuple[np.ndarray, np.ndarray]:
        """The place in the cache and the row of every piece of the rows that are not odd."""
        none = np.zeros(0, np.int64)
        if not len(data):
            return none, none
        kind = _KIND[data]
        new = np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == 2)
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, "right") - 1
        self._contract(data, kind, starts, ends, row)
        ok = (kind[np.minimum(starts, len(data) - 1)] != 0) & ~odd[row] & (ends > starts)
        starts, ends, row = starts[ok], ends[ok], row[ok]
        if not len(starts):
            return none, none
        u, one, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(u) > CACHE_PIECES:
            self._clear()
        at = np.searchsorted(self.hashes, u)
        fresh = np.ones(len(u), bool)
        held = at < len(self.hashes)
        fresh[held] = self.hashes[at[held]] != u[held]
        if fresh.any():
            raw = data.tobytes()
            first = one[fresh]
            self._learn(u[fresh], [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            at = np.searchsorted(self.hashes, u)
        return at[back], row

    @staticmethod
    def _contract(data, kind, starts, ends, row) -> None:
        """Moves the letters of a contraction from the run after a lone apostrophe to the apostrophe, in place."""
        lone = np.flatnonzero((ends - starts == 1) & (data[starts] == 0x27))
        for i in lone.tolist():
            if i + 1 >= len(starts) or row[i + 1] != row[i] or kind[starts[i + 1]] != 1:
                continue
            rest = data[starts[i + 1] : min(ends[i + 1], starts[i + 1] + 2)].tobytes()
            for c in _CONTRACTIONS:
                if rest.startswith(c.encode()):
                    ends[i] += len(c)
                    starts[i + 1] += len(c)
                    break


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder and cache per process and file."""
    return Encoder(path)

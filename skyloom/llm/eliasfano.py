"""Monotone integer sequences in Elias-Fano form, in one memory-mapped block, searched many keys at a time, and the levels
of a trie made of them."""

from __future__ import annotations

import numpy as np

#: For each byte and k, flat, the place of its k-th set bit.
_PLACE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _PLACE[_b, _k] = _i
_PLACE = _PLACE.ravel()
_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
_PAIRS, _FOURS, _EIGHTS = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)


def select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each 64-bit word; every word has more than k set bits.

    All eight byte counts of a word are added up in one multiplication and compared with k in one subtraction."""
    k = k.astype(np.uint64)
    sums = words - (words >> _U(1) & _PAIRS)
    sums = (sums & _FOURS) + (sums >> _U(2) & _FOURS)
    sums = (sums + (sums >> _U(4)) & _EIGHTS) * _ONES
    shift = np.bitwise_count(((k * _ONES | _TOPS) - sums) & _TOPS).astype(np.uint64) << _U(3)
    inner = k - (sums << _U(8) >> shift & _U(255))
    octet = words >> shift & _U(255)
    return (shift + _PLACE[(octet << _U(3) | inner).astype(np.int64)]).astype(np.int64)


def encode(keys: np.ndarray, *payload: np.ndarray) -> bytes:
    """Increasing int64 keys and unsigned arrays that go along, as one block of bytes.

    Low bits are packed; high bits are unary in a bit vector whose zeros are counted at each 64-bit word, so that the
    run of keys with one high part is found without a scan. Keys may repeat where they are only read by number.
    """
    n = len(keys)
    base = int(keys[0]) if n else 0
    rel = (keys - base).astype(np.uint64)
    span = int(rel[-1]) + 1 if n else 1
    low_bits = max(0, (span // max(n, 1)).bit_length() - 1)
    high = (rel >> np.uint64(low_bits)).astype(np.int64)
    low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
    if low_bits and n:
        value = rel & np.uint64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.int64) * low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, word, value << off)
        over = np.flatnonzero(off + np.uint64(low_bits) > 64)
        np.bitwise_or.at(low, word[over] + 1, value[over] >> (np.uint64(64) - off[over]))
    place = high + np.arange(n)
    words = np.zeros((int(place[-1]) if n else 0) // 64 + 1, np.uint64)
    np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    ones = np.bitwise_count(words).astype(np.int64)
    zeros = 64 * np.arange(len(words)) - (np.cumsum(ones) - ones)
    head = np.array([n, base, low_bits, len(low), len(words), *(p.itemsize for p in payload), *[0] * (3 - len(payload))], np.int64)
    rest = [p.tobytes() + b"\0" * (-p.nbytes % 8) for p in payload]
    return b"".join([head.tobytes(), low.tobytes(), words.tobytes(), zeros.astype(np.int64).tobytes(), *rest])


def least_type(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


class Sequence:
    """A reader over the bytes that encode() made."""

    def __init__(self, raw: np.ndarray):
        n, base, low_bits, n_low, n_words, *sizes = raw[:64].view(np.int64).tolist()
        self.n, self.base, self.low_bits = n, base, low_bits
        at = 64
        # the eight bytes from each byte on: a key's low bits, up to 57 of them, lie in one of these
        self.low = raw[at : at + 8 * n_low].view(np.uint64)
        self.near = np.ndarray((max(8 * n_low - 7, 0),), "<u8", raw, at, (1,)) if n_low else self.low
        at += 8 * n_low
        self.words = raw[at : at + 8 * n_words].view(np.uint64)
        at += 8 * n_words
        self.zeros = raw[at : at + 8 * n_words].view(np.int64)
        at += 8 * n_words
        self.payload = []
        for size in filter(None, sizes):
            self.payload.append(raw[at : at + n * size].view(f"<u{size}"))
            at += n * size + -(n * size) % 8
        self.bytes = at
        self.all_zeros = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.words[-1])) if n_words else 0
        self._ones = None

    def _zero(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word and the bit of zero number k of the unary part, for k that it has."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word, select(~self.words[word], k - self.zeros[word])

    def _range(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the keys with each high part the first's number and that behind the last."""
        a, b = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        k = high - 1  # the zero that ends the part before
        ok = np.flatnonzero((k >= 0) & (k < self.all_zeros))
        word, bit = self._zero(k[ok])
        a[ok] = np.minimum(64 * word + bit - k[ok], self.n)
        a[k >= self.all_zeros] = self.n
        word, bit = _spread(len(high), ok, word), _spread(len(high), ok, bit, -1)
        # ones that follow in the same word; where they reach its end, the next zero is sought
        rest = ~(self.words[word] >> np.minimum(bit + 1, 63).astype(np.uint64))
        run = np.bitwise_count((rest & (~rest + _U(1))) - _U(1)).astype(np.int64)
        b[:] = np.minimum(a + run, self.n)
        far = np.flatnonzero((bit + 1 + run >= 64) & (k < self.all_zeros))
        if len(far):
            inside = high[far] < self.all_zeros
            b[far[~inside]] = self.n
            far = far[inside]
            word, bit = self._zero(high[far])
            b[far] = np.minimum(64 * word + bit - high[far], self.n)
        b[k >= self.all_zeros] = self.n
        return a, b

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        if self.low_bits <= 57:
            return self.near[at >> 3] >> (at & 7).astype(np.uint64) & _U((1 << self.low_bits) - 1)
        word, off = at >> 6, (at & 63).astype(np.uint64)
        over = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> off | over) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The keys at the given numbers."""
        i = np.asarray(i, np.int64)
        if self._ones is None:
            self._ones = 64 * np.arange(len(self.words)) - self.zeros
        word = np.searchsorted(self._ones, i, "right") - 1
        left = i - self._ones[word]
        high = 64 * word + select(self.words[word], left) - i
        return (high << self.low_bits) + self._low_at(i).astype(np.int64) + self.base

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the number of stored keys below it, and whether it is stored."""
        keys = np.asarray(keys, np.int64)
        inside = keys >= self.base
        rel = np.where(inside, keys - self.base, 0).astype(np.uint64)
        high = (rel >> np.uint64(self.low_bits)).astype(np.int64)
        want = rel & np.uint64((1 << self.low_bits) - 1)
        a, b = self._range(high)
        size, found = b - a, np.zeros(len(keys), bool)
        one = np.flatnonzero((size == 1) & inside)  # most runs have one key
        low = self._low_at(a[one])
        found[one] = low == want[one]
        a[one] += low < want[one]
        todo = np.flatnonzero((size > 1) & inside)
        if len(todo):
            lo, hi, need, at = a[todo], b[todo], want[todo], np.arange(len(todo))
            while len(at):
                mid = (lo[at] + hi[at]) >> 1
                less = self._low_at(mid) < need[at]
                lo[at] = np.where(less, mid + 1, lo[at])
                hi[at] = np.where(less, hi[at], mid)
                at = at[lo[at] < hi[at]]
            end = b[todo]
            a[todo] = lo
            some = np.flatnonzero(lo < end)
            found[todo[some]] = self._low_at(lo[some]) == need[some]
        return np.where(inside, a, 0), found


def _spread(n: int, at: np.ndarray, values: np.ndarray, other: int = 0) -> np.ndarray:
    """`values` at the places `at` of n, `other` elsewhere."""
    out = np.full(n, other, np.int64)
    out[at] = values
    return out


class Level:
    """Sequences over consecutive ranges of keys, as written by the tasks of a range sort; numbers run on through them."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]]):
        """parts: least key, number of keys and bytes of each, in order."""
        self.least = np.array([p[0] for p in parts], np.int64)
        self.offset = np.concatenate(([0], np.cumsum([p[1] for p in parts]))).astype(np.int64)
        self.parts = [Sequence(p[2]) for p in parts]

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: how many stored keys are below each, and whether it is stored."""
        at, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if not self.parts:
            return at, found
        cut = np.concatenate(([0], np.searchsorted(keys, self.least[1:], "left"), [len(keys)]))
        for i, part in enumerate(self.parts):
            own = slice(cut[i], cut[i + 1])
            if cut[i] < cut[i + 1]:
                a, found[own] = part.successor(keys[own])
                at[own] = a + self.offset[i]
        return at, found

    def payload(self, which: int, at: np.ndarray) -> np.ndarray:
        """The number that goes with each key's number; these are sorted."""
        out = np.zeros(len(at), np.int64)
        cut = np.searchsorted(at, self.offset[:-1])
        for i, part in enumerate(self.parts):
            own = slice(cut[i], cut[i + 1] if i + 1 < len(cut) else len(at))
            out[own] = part.payload[which][at[own] - self.offset[i]]
        return out


def encode_children(parents: int, parent: np.ndarray, child: np.ndarray) -> bytes:
    """The children of `parents` nodes: rows (parent, child) sorted, none twice.

    Pointers say where each node's children begin (and where the last end). Children become one monotone sequence: each
    node's are counted on from the last of the node before it.
    """
    pointers = np.searchsorted(parent, np.arange(parents + 1))
    some = np.flatnonzero(np.diff(pointers))
    last = np.zeros(parents, np.int64)
    last[some] = child[pointers[some + 1] - 1] + 1
    before = np.cumsum(last) - last
    return encode(pointers) + encode(before[parent] + child + 1)


class Children:
    """A reader over the bytes that encode_children() made."""

    def __init__(self, raw: np.ndarray):
        self.pointers = Sequence(raw)
        self.values = Sequence(raw[self.pointers.bytes :])

    def begin(self, parent: np.ndarray) -> np.ndarray:
        return self.pointers.access(parent)

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The number of each (parent, child), -1 if there is none; equal parents follow each other."""
        if not self.values.n or not len(parent):
            return np.full(len(parent), -1, np.int64)
        new = np.concatenate(([True], parent[1:] != parent[:-1]))
        one, back = parent[new], np.cumsum(new) - 1
        begin, end = self.begin(one), self.begin(one + 1)
        before = np.where(begin > 0, self.values.access(np.maximum(begin - 1, 0)), 0)
        at, found = self.values.successor(before[back] + child + 1)
        return np.where(found & (at >= begin[back]) & (at < end[back]), at, -1)

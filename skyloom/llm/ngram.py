"""An n-gram language model in a compact trie, and log-probabilities of whole texts under it.

Words (A-Z lower-cased, runs without white space) and one end per text are counted over all training rows. The words,
sorted by a 64-bit hash in Elias-Fano form, are the first level; a word's number is its place. Below each word its
successors, and below each pair its successors, are Elias-Fano sequences: monotone pointers say where the children of a
node begin, and children are numbers that rise from node to node. On the third level, where most nodes have one child or
none, pointer and child are one monotone number; a child is numbered relative to its context, by its place among the
successors of the pair's last word. All n-grams are kept, those seen once too.

Probabilities are interpolated by absolute discounting and, like back-off weights, kept in 65,536 equal steps of their
logarithm, so a token is off by 0.0001 at most a level. Tasks add up what they read and send it, packed, to the task
that writes that range of the trie in the shared folder; scoring tasks memory-map the levels.

Null text is empty and has the end alone. A text's probability includes its end; a text begins after an end. A null
doc_id is learned from. Extra columns are left alone, repeated rows are learned from and scored each; an empty table
gives an empty result, and a model without training rows knows no word. Rows of one text are cut from others, so a very
long text stands alone in memory.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.files import make_folder, map_bytes, open_fs, write_bytes
from skyloom.functions.shared import materialize, shared_path
from skyloom.llm import eliasfano
from skyloom.llm.eliasfano import least_type
from skyloom.llm.tokens import text_chunks, utf8_view, word_hashes

#: The end of a text among the hashes of words.
END = np.int64(-0x7E4D_454E_44FF_0001)
DISCOUNT = 0.75
#: Log10 probabilities are kept in equal steps from -16 to 0, back-off weights from -8 to 0.
_P_LOW, _B_LOW, _STEPS = -16.0, -8.0, 65535
_HELD = 1 << 22
_CHUNK = 1 << 22
#: So many of the most frequent words of each range shape the cuts of the next level.
_HEAVY = 64


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (word hashes, then END) of all texts of a chunk in a row, and where each text's begin (and the end)."""
    h, first = word_hashes(column)
    tokens = np.insert(h.view(np.int64), first[1:], END)
    return tokens, first + np.arange(len(first))


def quantise(p: np.ndarray, low: float) -> np.ndarray:
    """Steps of log10 p between `low` and 0."""
    return np.round((np.log10(np.clip(p, 10.0**low, 1)) / -low + 1) * _STEPS).astype(np.uint16)


def log_of(code: np.ndarray, low: float) -> np.ndarray:
    return low - low / _STEPS * code


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and where each value is among them; by a hash table, as most repeat."""
    back, found = pd.factorize(values)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[back]


def _sorted_unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _unique, by a sort: for values of which few repeat."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, bool)
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[head], np.add.reduceat(counts, head)


@dataclass
class NgramModel:
    """Where the levels are, a part for each range. words: (least hash, words, file). pairs: (least key, first word,
    pairs, file of children, file of codes). weights: (first word, words, file), the words' back-off weights.
    triples: (first pair, triples, file), in the parts of pairs; fan: the most successors that a word has."""

    order: int = 3
    tokens: int = 0
    types: int = 0
    fan: int = 1
    words: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    weights: list = field(default_factory=list)
    triples: list = field(default_factory=list)

    @property
    def grams(self) -> list:
        """The parts of the levels of two words and more: first, how many n-grams, file."""
        return [x for x in ([(k, n, path) for k, _, n, path, _ in self.pairs], self.triples) if x]


class Reader:
    """The memory-mapped levels of a model."""

    def __init__(self, model: NgramModel):
        self.model = model
        whole = lambda path: np.asarray(map_bytes(path))
        self.level = eliasfano.Level([(k, n, whole(f)) for k, n, f in model.words])
        self.least = np.array([p[0] for p in model.pairs], np.int64)
        self.first_word = np.array([p[1] for p in model.pairs], np.int64)
        self.first_pair = np.concatenate(([0], np.cumsum([p[2] for p in model.pairs]))).astype(np.int64)
        self.pairs = [eliasfano.Children(whole(p[3])) for p in model.pairs]
        self.codes = [whole(p[4]).view("<u2").reshape(2, -1) if p[4] else None for p in model.pairs]
        self.first_weight = np.array([p[0] for p in model.weights], np.int64)
        self.weights = [whole(p[2]).view("<u2") for p in model.weights]
        self.triples = [eliasfano.Sequence(whole(p[2])) for p in model.triples]

    def words(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each token's word, -1 if unknown, and its count."""
        u, back = _unique(tokens)
        at, found = self.level.successor(u)
        counts = np.zeros(len(u), np.int64)
        counts[found] = self.level.payload(0, at[found])
        return np.where(found, at, -1)[back], counts[back]

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """The counts of sorted word numbers."""
        return self.level.payload(0, ids)

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        """log10((c + 0.5) / (N + 0.5 (V + 1)))."""
        return np.log10((counts + 0.5) / (self.model.tokens + 0.5 * (self.model.types + 1)))

    def _cut(self, starts: np.ndarray, values: np.ndarray):
        """(part, slice) of sorted values for parts that begin at `starts`."""
        edge = np.concatenate(([0], np.searchsorted(values, starts[1:], "left"), [len(values)])) if len(starts) else [0]
        for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            if a < b:
                yield i, slice(a, b)

    def find_pairs(self, key: np.ndarray) -> np.ndarray:
        """The node of each pair of words; keys (first * types + second) sorted. -1 if there is none."""
        out = np.full(len(key), -1, np.int64)
        for i, own in self._cut(self.least, key):
            first, second = key[own] // self.model.types, key[own] % self.model.types
            parents = self.pairs[i].pointers.n - 1
            parent = first - self.first_word[i]
            at = self.pairs[i].find(np.clip(parent, 0, parents - 1), second)
            out[own] = np.where((at >= 0) & (parent >= 0) & (parent < parents), at + self.first_pair[i], -1)
        return out

    def first_successor(self, words: np.ndarray) -> np.ndarray:
        """The node of each word's first pair; words sorted. Every word of the model has one."""
        out = np.zeros(len(words), np.int64)
        for i, own in self._cut(self._begins(), words):
            out[own] = self.pairs[i].begin(words[own] - self.first_word[i]) + self.first_pair[i]
        return out

    def _begins(self) -> np.ndarray:
        """The first word that begins in each part: a word cut by ranges begins in the first that has it."""
        if not hasattr(self, "_first_begin"):
            last = [w + p.pointers.n - 2 for w, p in zip(self.first_word.tolist(), self.pairs)]
            self._first_begin = self.first_word + (self.first_word == np.array([-1, *last[:-1]][: len(last)], np.int64))
        return self._first_begin

    def pair_codes(self, which: int, nodes: np.ndarray) -> np.ndarray:
        """The quantised probabilities (0) or back-off weights (1) of sorted pairs."""
        out = np.zeros(len(nodes), np.uint16)
        for i, own in self._cut(self.first_pair[:-1], nodes):
            out[own] = self.codes[i][which][nodes[own] - self.first_pair[i]]
        return out

    def word_weight(self, words: np.ndarray) -> np.ndarray:
        """The quantised back-off weights of sorted words."""
        out = np.zeros(len(words), np.uint16)
        for i, own in self._cut(self.first_weight, words):
            out[own] = self.weights[i][words[own] - self.first_weight[i]]
        return out

    def triple_codes(self, pair: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the triple of each sorted pair and place among its last word's successors is known, and its code."""
        known, out = np.zeros(len(pair), bool), np.zeros(len(pair), np.uint16)
        for i, own in self._cut(self.first_pair[:-1], pair):
            at, known[own] = self.triples[i].successor((pair[own] - self.first_pair[i]) * self.model.fan + rank[own])
            if self.triples[i].n:
                out[own] = self.triples[i].payload[0][np.minimum(at, self.triples[i].n - 1)]
        return known, out

    def log_probabilities(self, ids: np.ndarray, base: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Log10 probability of each token, from the longest n-gram known and the back-off weights of longer contexts.

        start: places where a text begins, whose context is the end of the text laid before it and no more.
        """
        out = base.copy()
        if self.model.order < 2 or not self.pairs or len(ids) < 2:
            return out
        # the distinct pairs of words of the chunk and, for each, what is known of it; rows are places from 1
        ok = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        u, back = _sorted_unique(ids[ok] * self.model.types + ids[ok + 1])
        node = self.find_pairs(u)
        order = np.flatnonzero(node >= 0)  # nodes rise with their keys
        p, w = np.zeros(len(u)), np.zeros(len(u))
        p[order] = log_of(self.pair_codes(0, node[order]), _P_LOW)
        if self.model.order > 2:
            w[order] = log_of(self.pair_codes(1, node[order]), _B_LOW)
        pair = np.full(len(ids), -1, np.int64)  # the pair that ends at each place, by its number in the chunk
        pair[ok + 1] = back
        here = np.flatnonzero(pair >= 0)
        here = here[node[pair[here]] >= 0]
        out[here] = p[pair[here]]
        context = np.concatenate(([-1], ids[:-1]))
        known = np.zeros(len(ids), bool)
        known[here] = True
        at = np.flatnonzero(~known & (context >= 0))
        if len(at):
            v, b = _unique(context[at])
            out[at] += log_of(self.word_weight(v), _B_LOW)[b]
        if self.model.order > 2:
            before = np.concatenate(([-1], pair[:-1]))
            before[start] = -1
            at = np.flatnonzero(before >= 0)
            at = at[node[before[at]] >= 0]
            seen = np.zeros(len(ids), bool)
            both = at[known[at]]
            if len(both):
                first = u // self.model.types
                new = np.concatenate(([True], first[1:] != first[:-1]))
                rank = node - self.first_successor(first[new])[np.cumsum(new) - 1]
                one, two = node[before[both]], rank[pair[both]]
                order = np.argsort(one * self.model.fan + two)
                has, code = self.triple_codes(one[order], two[order])
                hit = both[order[has]]
                out[hit] = log_of(code[has], _P_LOW)
                seen[hit] = True
            rest = at[~seen[at]]
            out[rest] += w[before[rest]]
        return out


@lru_cache(maxsize=1)
def _reader(key: tuple) -> Reader:
    order, tokens, types, fan, *levels = key
    return Reader(NgramModel(order, tokens, types, fan, *map(list, levels)))


def reader(model: NgramModel) -> Reader:
    """The levels of a model, mapped once per process."""
    return _reader((model.order, model.tokens, model.types, model.fan, *(tuple(map(tuple, x)) for x in (model.words, model.pairs, model.weights, model.triples))))


def _ids(column: pa.Array, model: NgramModel) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the tokens of rows that number() made, one after the other, and where each row's begin."""
    raw, offsets = utf8_view(column)
    ids = raw.view("<u4").astype(np.int64) if model.types < 2**32 - 1 else raw.view("<i8")
    return np.where(ids == 2**32 - 1, -1, ids) if model.types < 2**32 - 1 else ids, offsets // (4 if model.types < 2**32 - 1 else 8)


def number(docs: DataFrame, model: NgramModel) -> DataFrame:
    """The rows of docs with ids in place of text: the numbers of the text's tokens, its end too; the last number stands
    for unknown words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        own, wide = reader(shared.value), 4 if shared.value.types < 2**32 - 1 else 8
        for batch in text_chunks(batches, limit=_CHUNK):
            tokens, first = sequence(batch.column("text"))
            if first[-1] * wide >= 1 << 31:
                raise ValueError("a text of so many tokens does not fit a row")
            ids = own.words(tokens)[0].astype("<u4" if wide == 4 else "<i8")
            made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((first * wide).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.record_batch([*(batch.column(c) for c in kept), made], [*kept, "ids"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{schema}{', ' if kept else ''}ids binary")


def _gathered(docs: DataFrame, tally, parts: int, write, schema: str) -> list:
    """Run tally(batches of docs) in tasks, which gives (part, arrays) packed, send these to the task of their part, run
    write(part, list of arrays) there, and return its rows: one for each part comes to the driver."""

    def pack(batches):
        for part, arrays in tally(batches):
            yield pa.record_batch([pa.array([part], pa.int32()), *(pa.array([least_type(a).tobytes()], pa.binary()) for a in arrays), pa.array([",".join(least_type(a).dtype.str for a in arrays)])], ["part", "a", "b", "c", "kind"])

    def unpack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["part"], []).append([np.frombuffer(r[x], k) for x, k in zip("abc", r["kind"].split(","))])
        for part, own in sorted(held.items()):
            yield pa.RecordBatch.from_pylist([{"part": part} | write(part, own)])

    packed = docs.mapInArrow(pack, "part int, a binary, b binary, c binary, kind string")
    return sorted(packed.repartitionById(parts, "part").mapInArrow(unpack, "part bigint, " + schema).collect(), key=lambda r: r["part"])


def _count_words(docs: DataFrame, parts: int, folder: str) -> list:
    """Write the first level: ranges of hashes, each word's count with it."""
    spread = np.uint64(parts)

    def send(held):
        k, c = _added(*(np.concatenate(x) for x in zip(*held)))
        place = ((k.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * spread >> np.uint64(32)
        cut = np.searchsorted(place, np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[i], cut[i + 1])
            yield i, [k[own].view(np.uint64), c[own].astype(np.uint64), np.zeros(0, np.uint64)]

    def tally(batches):
        held, size = [], 0
        for batch in text_chunks(batches, limit=_CHUNK):
            u, back = _unique(sequence(batch.column("text"))[0])
            held.append((u, np.bincount(back, minlength=len(u))))
            size += len(u)
            if size > _HELD:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    def write(part, own):
        k, c = _added(np.concatenate([x[0] for x in own]).astype(np.uint64).view(np.int64), np.concatenate([x[1] for x in own]).astype(np.int64))
        path = f"{folder}/words-{uuid.uuid4().hex}.bin"
        write_bytes(path, [eliasfano.encode(k, least_type(c))])
        heavy = np.sort(np.argsort(-c, kind="stable")[:_HEAVY])
        return {"least": int(k[0]), "n": len(k), "total": int(c.sum()), "path": path, "heavy": heavy.tolist(), "counts": c[heavy].tolist()}

    return _gathered(docs.select("text"), tally, parts, write, "least bigint, n bigint, total bigint, path string, heavy array<bigint>, counts array<bigint>")


def _pair_cuts(words: list, types: int, parts: int) -> np.ndarray:
    """Keys that cut the pairs of words into ranges of about equal occurrence, as if words followed each other by chance."""
    number, mass, offset = [], [], 0
    for r in words:  # heavy words one by one, the words between them as one step
        at, rest = 0, (r["total"] - sum(r["counts"])) / max(r["n"] - len(r["heavy"]), 1)
        for i, c in zip(r["heavy"], r["counts"]):
            if i > at:
                number.append(offset + at)
                mass.append(rest * (i - at))
            number.append(offset + i)
            mass.append(c)
            at = i + 1
        if at < r["n"]:
            number.append(offset + at)
            mass.append(rest * (r["n"] - at))
        offset += r["n"]
    number, mass = np.array([*number, types], np.int64), np.array(mass, float) / sum(mass)
    before = np.concatenate(([0], np.cumsum(mass)))

    def at(share: float) -> tuple[int, float, bool]:
        """The word at a share of the mass, how far into its step, and whether the step is one word."""
        i = min(int(np.searchsorted(before, share, "right")) - 1, len(mass) - 1)
        inside, wide = min(max((share - before[i]) / max(mass[i], 1e-300), 0.0), 1.0), int(number[i + 1] - number[i])
        return int(number[i]) + int(inside * wide) * (wide > 1), inside, wide == 1

    cuts = []
    for j in range(1, parts):
        word, inside, one = at(j / parts)
        cuts.append(min(word, types - 1) * types + (min(at(inside)[0], types - 1) if one else 0))
    return np.unique(np.array(cuts, np.int64))


def _count_pairs(numbered: DataFrame, model: NgramModel, cuts: np.ndarray, folder: str) -> list:
    """Write the second level's children and, beside them, what the later levels are made of: for each pair how many
    successors it has, and these with their counts."""
    shared = numbered.sparkSession.sparkContext.broadcast((model, cuts))

    def triples(pair, after, count):
        """Distinct (pair, after) in order with their counts: distinct pairs, successors of each, successors, counts."""
        order = np.argsort(pair)
        pair = pair[order]
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        u, rank = pair[new], np.cumsum(new) - 1
        base = rank * (shared.value[0].types + 1)
        key = base + after[order]
        if count is None:
            key.sort()  # places change within a pair only
        else:
            order = order[(again := np.argsort(key))]
            key = key[again]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        c = np.diff(np.append(head, len(key))) if count is None else np.add.reduceat(count[order], head)
        return u, np.bincount(rank[head], minlength=len(u)), (key - base)[head], c

    def send(held):
        u, n, after, c = triples(*(np.concatenate(x) for x in zip(*held)), None)
        place, begin = np.searchsorted(shared.value[1], u, "right"), np.concatenate(([0], np.cumsum(n)))
        edge = np.searchsorted(place, np.arange(len(shared.value[1]) + 2))
        for i in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[i], edge[i + 1]
            least = shared.value[1][i - 1] if i else 0
            own = slice(begin[a], begin[b])
            yield i, [np.diff(u[a:b], prepend=least), n[a:b], np.concatenate((after[own], c[own]))]  # steps between pairs are short

    def tally(batches):
        model, held, size = shared.value[0], [], 0
        for batch in text_chunks(batches, "ids", _CHUNK):
            ids, first = _ids(batch.column("ids"), model)
            ids = np.concatenate((ids[-1:], ids))  # an end stands before the first text as well
            after = np.append(ids[2:] + 1, 0)
            after[first[1:] - 1] = 0  # 0: nothing follows an end in its text
            held.append((ids[:-1] * model.types + ids[1:], after))
            size += len(after)
            if size > _HELD:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    def write(part, own):
        model = shared.value[0]
        least = int(shared.value[1][part - 1]) if part else 0
        pair = np.concatenate([np.repeat(least + np.cumsum(x[0].astype(np.int64)), x[1]) for x in own])
        half = [x[2].astype(np.int64).reshape(2, -1) for x in own]
        u, n, after, c = triples(pair, np.concatenate([h[0] for h in half]), np.concatenate([h[1] for h in half]))
        first, last = int(u[0] // model.types), int(u[-1] // model.types)
        name = uuid.uuid4().hex
        write_bytes(f"{folder}/pairs-{name}.bin", [eliasfano.encode_children(last - first + 1, u // model.types - first, u % model.types)])
        arrays = [least_type(x) for x in (n, after, c)]
        packed = [zstandard.compress(x.tobytes(), 1) for x in arrays]
        write_bytes(f"{folder}/raw-{name}.bin", [np.array([(len(x), a.itemsize) for x, a in zip(packed, arrays)], np.int64).tobytes(), *packed])
        kinds = np.bincount(u // model.types - first)
        return {"least": int(u[0]), "first": first, "last": last, "n": len(u), "of_first": int(kinds[0]), "of_last": int(kinds[-1]), "of_any": int(kinds.max()), "path": f"{folder}/pairs-{name}.bin", "raw": f"{folder}/raw-{name}.bin"}

    return _gathered(numbered.select("ids"), tally, len(cuts) + 1, write, "least bigint, first bigint, last bigint, n bigint, of_first bigint, of_last bigint, of_any bigint, path string, raw string")


def _raw(path: str) -> list[np.ndarray]:
    """Of each pair its count and how many successors it has; the successors and their counts."""
    raw, out, at = np.asarray(map_bytes(path)), [], 48
    for size, wide in raw[:48].view(np.int64).reshape(3, 2).tolist():
        out.append(np.frombuffer(zstandard.decompress(raw[at : at + size].tobytes()), f"<u{wide}").astype(np.int64))
        at += size
    n, after, c = out
    return [np.add.reduceat(c, np.cumsum(n) - n), n, after, c]


def _each(spark: SparkSession, rows: list, make) -> list:
    """What make(number of the row) gives for each row, in a task each."""

    def run(batches):
        for batch in batches:
            for i in batch.column("i").to_pylist():
                yield pa.record_batch([pa.array([i]), pa.array([make(i)])], ["i", "path"])

    todo = spark.createDataFrame([(i, i) for i in range(len(rows))], "i bigint, part int").repartitionById(max(len(rows), 1), "part").select("i")
    return [r["path"] for r in sorted(todo.mapInArrow(run, "i bigint, path string").collect())]


def _smooth_pairs(spark: SparkSession, model: NgramModel, rows: list, folder: str) -> None:
    """Write the codes of pairs and the back-off weights of words."""
    kinds: dict[int, int] = {}  # of words at the rim of a part, which another part may have too
    for r in rows:
        kinds[r["first"]] = kinds.get(r["first"], 0) + r["of_first"]
        if r["last"] != r["first"]:
            kinds[r["last"]] = kinds.get(r["last"], 0) + r["of_last"]
    begun, owned = -1, []
    for r in rows:  # a word belongs to the first part that has it
        owned.append((max(r["first"], begun + 1), r["last"]))
        begun = r["last"]
    shared = spark.sparkContext.broadcast((model, [r.asDict() for r in rows], kinds, owned))

    def make(i):
        model, rows, kinds, owned = shared.value
        own, r = reader(model), rows[i]
        count, n, after, c = _raw(r["raw"])
        level = own.pairs[i]
        pointers = level.pointers.access(np.arange(level.pointers.n))
        types = np.diff(pointers)
        for w in {r["first"], r["last"]}:
            types[w - r["first"]] = kinds[w]
        words = np.arange(r["first"], r["last"] + 1)
        weight = DISCOUNT * types / np.maximum(own.count_of(words), 1)
        first = np.repeat(words, np.diff(pointers)) - r["first"]
        values = level.values.access(np.arange(r["n"]))
        some = np.flatnonzero(np.diff(pointers))
        before = np.zeros(len(words), np.int64)
        before[some[1:]] = values[pointers[some[1:]] - 1]
        second = values - 1 - before[first]
        u, back = _unique(second)
        base = 10 ** own.base_log(own.count_of(u))
        p = (count - DISCOUNT) / own.count_of(words)[first] + weight[first] * base[back]
        kept = np.where(np.add.reduceat(after, np.cumsum(n) - n) > 0, DISCOUNT * n / count, 1.0)
        name = uuid.uuid4().hex
        write_bytes(f"{folder}/codes-{name}.bin", [quantise(p, _P_LOW).tobytes(), quantise(kept, _B_LOW).tobytes()])
        a, b = owned[i]
        if a <= b:
            write_bytes(f"{folder}/weights-{name}.bin", [quantise(weight[a - r["first"] :], _B_LOW).tobytes()])
        return name

    names = _each(spark, rows, make)
    model.pairs = [(k, f, n, path, f"{folder}/codes-{name}.bin") for (k, f, n, path, _), name in zip(model.pairs, names)]
    model.weights = [(a, b - a + 1, f"{folder}/weights-{name}.bin") for (a, b), name in zip(owned, names) if a <= b]


def _write_triples(spark: SparkSession, model: NgramModel, rows: list, folder: str) -> None:
    """Write the third level, numbered relative to contexts, with its codes."""
    shared = spark.sparkContext.broadcast((model, [r.asDict() for r in rows]))

    def make(i):
        model, rows = shared.value
        own, r = reader(model), rows[i]
        count, n, after, c = _raw(r["raw"])
        level = own.pairs[i]
        parent = np.repeat(np.arange(r["n"]), n)
        some = after > 0
        parent, after, c = parent[some], after[some] - 1, c[some]
        values = level.values.access(np.arange(r["n"]))
        pointers = level.pointers.access(np.arange(level.pointers.n))
        begin = np.repeat(pointers[:-1], np.diff(pointers))
        second = values - 1 - np.where(begin > 0, values[np.maximum(begin - 1, 0)], 0)
        u, back = _sorted_unique(second[parent] * model.types + after)
        node, first = own.find_pairs(u), u // model.types
        new = np.diff(first, prepend=-1) > 0
        rank = node - own.first_successor(first[new])[np.cumsum(new) - 1]
        lower = 10 ** log_of(own.pair_codes(0, node), _P_LOW)
        kept = DISCOUNT * n / count
        p = (c - DISCOUNT) / count[parent] + kept[parent] * lower[back]
        path = f"{folder}/triples-{uuid.uuid4().hex}.bin"
        write_bytes(path, [eliasfano.encode(parent * model.fan + rank[back], quantise(p, _P_LOW))])
        return f"{len(p)} {path}"

    made = (x.split(" ", 1) for x in _each(spark, rows, make))
    model.triples = [(int(a), int(n), path) for a, (n, path) in zip(np.cumsum([0, *(r["n"] for r in rows)]), made)]


def train(docs: DataFrame, order: int = 3) -> NgramModel:
    """Count over all rows of docs(text) and write the levels. `order` is 1, 2 or 3."""
    return train_numbered(docs.select("text").withColumn("learn", F.lit(True)), order)[0]


def train_numbered(docs: DataFrame, order: int = 3) -> tuple[NgramModel, DataFrame]:
    """The model of those rows of docs(text, learn, ...) that are to be learned from, and all rows as number() gives them,
    written to the shared folder: tokens are hashed and looked up once for counting and scoring."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    folder = shared_path(spark, "lm")
    make_folder(folder)
    words = _count_words(docs.filter("learn"), parts, folder)
    model = NgramModel(order, sum(r["total"] for r in words), sum(r["n"] for r in words), words=[(r["least"], r["n"], r["path"]) for r in words])
    if model.types >= 3_037_000_499:
        raise ValueError("more words than pairs of them can be numbered in 63 bits")
    numbered = materialize(number(docs, model), "lm-numbers", "zstd")
    if order == 1 or not words:
        return model, numbered
    rows = _count_pairs(numbered.filter("learn"), model, _pair_cuts(words, model.types, parts), folder)
    model.pairs = [(r["least"], r["first"], r["n"], r["path"], "") for r in rows]
    _smooth_pairs(spark, model, rows, folder)
    if order > 2:
        model.fan = _widest(rows)
        if sum(r["n"] for r in rows) * model.fan >= 1 << 63:
            raise ValueError("pairs and their successors cannot be numbered in 63 bits")
        _write_triples(spark, model, rows, folder)
    for r in rows:  # no level is made of these any more
        fs, path = open_fs(r["raw"])
        fs.delete_file(path)
    return model, numbered


def _widest(rows: list) -> int:
    """The most successors that a word has, those in several parts added up."""
    rim: dict[int, int] = {}
    for r in rows:
        rim[r["first"]] = rim.get(r["first"], 0) + r["of_first"]
        if r["last"] != r["first"]:
            rim[r["last"]] = rim.get(r["last"], 0) + r["of_last"]
    return max([*rim.values(), *(r["of_any"] for r in rows)])


def score(docs: DataFrame, model: NgramModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    return score_numbered(number(docs.select("doc_id", "text"), model), model)


def score_numbered(numbered: DataFrame, model: NgramModel) -> DataFrame:
    """score() of rows that number() made."""
    shared = numbered.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = reader(shared.value)
        for batch in text_chunks(batches, "ids", _CHUNK):
            ids, first = _ids(batch.column("ids"), own.model)
            ids = np.concatenate((ids[-1:], ids))
            u, back = _unique(ids)
            counts = np.zeros(len(u), np.int64)
            counts[u >= 0] = own.count_of(u[u >= 0])
            base = own.base_log(counts)[back]
            full = own.log_probabilities(ids, base, first[:-1] + 1)[1:]
            add = lambda x: np.add.reduceat(x, first[:-1])
            n = np.diff(first)
            cols = [pa.array(n), pa.array(add((ids[1:] >= 0).astype(np.int64))), pa.array(np.full(len(n), own.model.tokens)), pa.array(add(base[1:])), pa.array(add(full))]
            yield pa.record_batch([batch.column("doc_id"), *cols], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

"""Language identification of mixed-language text.

The script of each word, read from Unicode ranges, narrows its candidate languages; hashed byte n-grams give every
word a log-likelihood for each; Viterbi with a switching penalty labels spans; the language with the most letters is
the document's. Null or letterless text is `und` with score 0. Every other text gets a learned language, also in a
script that training never saw (then all languages are candidates). Extra columns are left alone, repeated rows are
scored alike, ties go to the language first in alphabetical order, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.tokens import CHUNK_BYTES, mix, span_hashes, spans, text_chunks, utf8_view

#: First code points of Unicode script ranges, from the Unicode block list.
SCRIPT_STARTS = {
    "latin": 0x0000, "greek": 0x0370, "cyrillic": 0x0400, "armenian": 0x0530, "hebrew": 0x0590, "arabic": 0x0600,
    "indic": 0x0900, "thai": 0x0E00, "lao": 0x0E80, "tibetan": 0x0F00, "burmese": 0x1000, "georgian": 0x10A0,
    "hangul_jamo": 0x1100, "ethiopic": 0x1200, "other": 0x1400, "latin_extended": 0x1E00, "greek_extended": 0x1F00,
    "symbols": 0x2000, "kana": 0x3040, "bopomofo": 0x3100, "cjk": 0x3400, "yi": 0xA000, "hangul": 0xAC00, "beyond": 0xD7B0,
}
_STARTS = np.array(list(SCRIPT_STARTS.values()))
_SAME = {"latin_extended": "latin", "greek_extended": "greek", "hangul_jamo": "hangul"}
_SCRIPT = np.array([list(SCRIPT_STARTS).index(_SAME.get(s, s)) for s in SCRIPT_STARTS])
N_SCRIPTS = len(SCRIPT_STARTS)

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
ORDERS = (1, 2, 3, 4)
BINS = 1 << 17


@dataclass
class Words:
    """The words of some texts: bounds, first word of each row (and the end), and for each word its place among the
    distinct ones; of these the script, and for each n-gram its word and bin."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    which: np.ndarray
    script: np.ndarray
    owner: np.ndarray
    bins: np.ndarray


def words_and_grams(column: pa.Array) -> Words:
    """Letter runs of the lower-cased texts. N-grams are made once for each distinct word of the chunk."""
    data, offsets = utf8_view(pc.utf8_lower(column.fill_null("")))
    starts, ends, first = spans(LETTER[data], offsets)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Words(starts, ends, first, none, none, none, none)
    _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    a, lens = starts[one], ends[one] - starts[one]
    room = lens + 2  # a space on both sides
    head = np.cumsum(room) - room
    flat = np.full(int(room.sum()), 0x20, np.uint64)
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    flat[inner + np.repeat(head + 1, lens)] = data[inner + np.repeat(a, lens)]
    word = np.repeat(np.arange(len(one)), room)
    pos = np.arange(len(flat)) - np.repeat(head, room)
    owners, bins, value = [], [], np.zeros(len(flat), np.uint64)
    for k in ORDERS:  # the n-gram that ends here, in the low bytes
        if k > 1:
            value[k - 1 :] |= flat[: len(flat) - k + 1] << np.uint64(8 * (k - 1))
        else:
            value |= flat
        ok = np.flatnonzero(pos >= max(k - 1, 1))
        owners.append(word[ok])
        bins.append((mix(value[ok] * np.uint64(8) + np.uint64(k)) % np.uint64(BINS)).astype(np.int64))
    return Words(starts, ends, first, which, _scripts(data, a), np.concatenate(owners), np.concatenate(bins))


def _scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word, by the code point at its start."""
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.int64)
    a, b, c = padded[starts], padded[starts + 1] & 63, padded[starts + 2] & 63
    cp = np.where(a < 0xC0, a & 0x7F, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, 0x10000)))
    return _SCRIPT[np.searchsorted(_STARTS, cp, "right") - 1]


@dataclass
class LanguageModel:
    """languages; grams: [bins, languages] log-probabilities less their mean; allowed: [scripts, languages]."""

    languages: list[str]
    grams: np.ndarray
    allowed: np.ndarray
    switch: float = 6.0


def train(docs: DataFrame, per_language: int = 2000, switch: float = 6.0) -> LanguageModel:
    """Fit on docs(doc_id, text, lang) with non-null lang and text.

    The documented bound: at most about `per_language` documents of each language, chosen by a hash of doc_id, whole
    texts. Languages are counted over all rows; the model has BINS numbers for each.
    """
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BINS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), switch)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20))
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        grams = np.zeros((len(languages), BINS), np.int64)
        scripts = np.zeros((len(languages), N_SCRIPTS), np.int64)
        for batch in text_chunks(batches):
            w = words_and_grams(batch.column("text"))
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            per_word = np.repeat(lang, np.diff(w.first))
            for k in np.unique(per_word):
                times = np.bincount(w.which[per_word == k], minlength=len(w.script))
                grams[k] += np.bincount(w.bins, times[w.owner], BINS).astype(np.int64)
                scripts[k] += np.bincount(w.script, times, N_SCRIPTS).astype(np.int64)
        both = np.concatenate((grams, scripts), axis=1)
        lang, at = np.nonzero(both)
        if len(lang):
            yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(both[lang, at])], ["lang", "at", "n"])

    got = chosen.mapInArrow(count, "lang int, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), BINS + N_SCRIPTS))
    table[got["lang"].to_numpy(np.int64), got["at"].to_numpy(np.int64)] = got["n"].to_numpy()
    grams = table[:, :BINS] + 0.3
    logs = np.log(grams / grams.sum(1, keepdims=True)).T
    scripts = table[:, BINS:]
    allowed = (scripts >= 0.01 * scripts.sum(1, keepdims=True)).T & (scripts.T > 0)
    allowed[~allowed.any(1)] = True
    return LanguageModel(languages, (logs - logs.mean(1, keepdims=True)).astype(np.float32), allowed, switch)


def emissions(model: LanguageModel, w: Words) -> np.ndarray:
    """[words, languages]: a bounded log-likelihood for each candidate, far below all of them for the others."""
    out = np.stack([np.bincount(w.owner, model.grams[w.bins, k], len(w.script)) for k in range(len(model.languages))], axis=1)
    out = np.clip(0.5 * (out - out.max(1, keepdims=True)), -8, 0)
    return np.where(model.allowed[w.script], out, -60.0)[w.which]


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word; first: where each text's words begin, and the end. All texts step together."""
    n, k = score.shape
    came = np.zeros((n, k), np.int8 if k < 128 else np.int32)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    longest, begins = length[order], first[:-1][order]
    alive = int((longest > 0).sum())
    if not alive:
        return np.zeros(0, np.int64)
    state = score[begins[:alive]].copy()
    own = np.arange(k)
    last = np.zeros(len(order), np.int64)
    live = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), "right")
    for t in range(1, longest[0] + 1):
        still = live[t] if t < longest[0] else 0
        last[still : len(state)] = state[still:].argmax(1)
        if not still:
            break
        state = state[:still]
        best = state.argmax(1)
        jump = state[np.arange(still), best] - switch
        stay = state >= jump[:, None]
        at = begins[:still] + t
        came[at] = np.where(stay, own[None, :], best[:, None])
        state = np.where(stay, state, jump[:, None]) + score[at]
    label = np.zeros(n, np.int64)
    now = last.copy()
    for t in range(longest[0] - 1, -1, -1):
        still = live[t]
        at = begins[:still] + t
        label[at] = now[:still]
        now[:still] = came[at, now[:still]]
    return label


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, lang_pred, score (the share of letters so labelled), n_spans, and spans of first word, words
    and language, one row per row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*keep, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"]

    def run(batches):
        m = shared.value
        for batch in text_chunks(batches, limit=2 * CHUNK_BYTES):
            w = words_and_grams(batch.column("text"))
            starts, ends, first = w.starts, w.ends, w.first
            names, scores, found = ["und"] * batch.num_rows, np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            if len(starts) and m.languages:
                label = viterbi(emissions(m, w), first, m.switch)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
                weight = np.bincount(doc * len(m.languages) + label, ends - starts, batch.num_rows * len(m.languages)).reshape(batch.num_rows, -1)
                letters = has_letters(batch.column("text"))
                top = weight.argmax(1)
                total = weight.sum(1)
                cut = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                for a, b in zip(cut, np.append(cut[1:], len(label))):
                    found[doc[a]].append({"first_word": int(a - first[doc[a]]), "n_words": int(b - a), "lang": m.languages[label[a]]})
                for i in np.flatnonzero((total > 0) & letters):
                    names[i] = m.languages[top[i]]
                    scores[i] = weight[i, top[i]] / total[i]
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
            extra = [pa.array(names), pa.array(scores), pa.array([len(x) for x in found], pa.int32()), pa.array(found, kind)]
            yield pa.record_batch([batch.column(c) for c in keep] + extra, [*keep, "lang_pred", "score", "n_spans", "spans"])

    return kept.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "n_spans int", "spans array<struct<first_word:int,n_words:int,lang:string>>"]))


def has_letters(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter; only texts without a-z and A-Z are looked at character by character."""
    plain = np.asarray(pc.fill_null(pc.match_substring_regex(column, "[A-Za-z]"), False))
    out = plain.copy()
    for i in np.flatnonzero(~plain):
        text = column[int(i)].as_py()
        out[i] = bool(text) and any(ch.isalpha() for ch in text)
    return out

"""Quality by nearest-neighbour voting in a latent-semantic space.

Hashed words, token shapes and repetition rates of a bounded labelled sample give a term-document matrix; a randomised
singular value decomposition gives few latent dimensions. The labelled vectors (bounded) are broadcast; each block of
documents is multiplied with all of them, exactly, and the nearest vote with weights of their similarity. A null,
empty or wholly unknown text has no neighbour and gets the share of label 1. Extra columns are left alone, repeated
rows are scored alike, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.tokens import LOWER, NOT_SPACE, span_hashes, spans, text_chunks, utf8_view
from skyloom.llm.training import labelled_sample

WORD_BINS, SHAPE_BINS, RATE_BINS = 4096, 4000, 96
BINS = WORD_BINS + SHAPE_BINS + RATE_BINS
_RATE_LEVELS = 16
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 1, 2, 3, 3


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (row, bin, value), sorted. Words and shapes weigh the root of their share, rates 1 for their level."""
    data, offsets = utf8_view(column)
    n_rows = len(column)
    starts, ends, first = spans(NOT_SPACE[data], offsets)
    count = np.diff(first)
    doc = np.repeat(np.arange(n_rows), count)
    word = span_hashes(LOWER[data], starts, ends)
    shape = _shapes(data, starts, ends)
    keys = np.concatenate((doc * BINS + (word % np.uint64(WORD_BINS)).astype(np.int64), doc * BINS + WORD_BINS + (shape % np.uint64(SHAPE_BINS)).astype(np.int64)))
    keys, n = np.unique(keys, return_counts=True)
    value = np.sqrt(n / np.maximum(count, 1)[keys // BINS])
    rates = _rates(data, offsets, doc, word, starts, ends, count)
    extra = np.concatenate([np.flatnonzero(count > 0) * BINS + WORD_BINS + SHAPE_BINS + _RATE_LEVELS * k + np.minimum((r[count > 0] * _RATE_LEVELS).astype(np.int64), _RATE_LEVELS - 1) for k, r in enumerate(rates)] or [np.zeros(0, np.int64)])
    keys, value = np.concatenate((keys, extra)), np.concatenate((value, np.full(len(extra), 0.7)))
    order = np.argsort(keys, kind="stable")
    return keys[order] // BINS, keys[order] % BINS, value[order].astype(np.float32)


def _shapes(data, starts, ends) -> np.ndarray:
    """Hash of each token's shape: runs of capitals, small letters and digits count as one sign, others as themselves."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind = _SHAPE[data]
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    new[starts] = True
    upto = np.concatenate(([0], np.cumsum(new)))
    return span_hashes(kind[new], upto[starts], upto[ends], salt=99)


def _rates(data, offsets, doc, word, starts, ends, count) -> list[np.ndarray]:
    """Per row, from 0 to 1: words equal to the one before; repeated words; repeated lines; capitals; bytes that are
    neither letters, digits nor space; words that are signs only."""
    n_rows = len(count)
    some = np.maximum(count, 1)
    same = np.concatenate(([False], (word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))) if len(word) else np.zeros(0, bool)
    line_a, line_b, line_first = spans(data != 10, offsets)
    lines = np.diff(line_first)
    line_doc = np.repeat(np.arange(n_rows), lines)
    row_of = np.repeat(np.arange(n_rows), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    kind = _SHAPE[data]
    per = lambda mask: np.bincount(row_of[mask], minlength=n_rows) / size
    letters = np.concatenate(([0], np.cumsum((kind >= 1) & (kind <= 3))))
    return [
        np.bincount(doc[same], minlength=n_rows) / some,
        1 - _distinct(doc, word, n_rows) / some,
        1 - _distinct(line_doc, span_hashes(data, line_a, line_b), n_rows) / np.maximum(lines, 1),
        per(kind == 2),
        per((kind > 32) & (kind < 128)),
        np.bincount(doc[letters[ends] == letters[starts]], minlength=n_rows) / some if len(starts) else np.zeros(n_rows),
    ]


def _distinct(doc, h, n_rows) -> np.ndarray:
    if not len(h):
        return np.zeros(n_rows)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])))
    return np.bincount(d[new], minlength=n_rows)


@dataclass
class QualityModel:
    """basis: [bins, dims] with inverse document frequencies; points: unit latent vectors; labels; share of label 1."""

    basis: np.ndarray
    points: np.ndarray
    labels: np.ndarray
    share: float


def times(ptr, cols, vals, dense, block: int = 1 << 16) -> np.ndarray:
    """A sparse matrix by rows times a dense one, in blocks of entries."""
    out = np.zeros((len(ptr) - 1, dense.shape[1]), np.float32)
    at = 0
    while at < len(ptr) - 1:
        end = max(at + 1, int(np.searchsorted(ptr, ptr[at] + block, "right")) - 1)
        a, b = ptr[at], ptr[end]
        own = np.flatnonzero(np.diff(ptr[at : end + 1])) + at
        if b > a:
            out[own] = np.add.reduceat(vals[a:b, None] * dense[cols[a:b]], ptr[own] - a, axis=0)
        at = end
    return out


def train(docs: DataFrame, labels: DataFrame, limit: int = 8000, dims: int = 64, seed: int = 5) -> QualityModel:
    """Fit on labels(doc_id, quality) and documents. Documented bound: about `limit` labelled rows, whole texts, whose
    sparse vectors (at most BINS numbers each) come to the driver."""
    sample = labelled_sample(docs, labels, "quality", limit).select("doc_id", "text", "y")

    def run(batches):
        for batch in text_chunks(batches):
            row, cols, vals = vectors(batch.column("text"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            ptr = pa.array(cut, pa.int32())
            bins = pa.ListArray.from_arrays(ptr, pa.array(cols.astype(np.int16)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), bins, pa.ListArray.from_arrays(ptr, pa.array(vals))], ["doc_id", "y", "bins", "vals"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {id_kind}, y int, bins array<smallint>, vals array<float>").toArrow()
    got = got.take(pa.array(np.argsort(np.asarray(got.column("doc_id")), kind="stable"))).combine_chunks()
    y = np.asarray(got.column("y")).astype(np.float32)
    if not len(y):
        return QualityModel(np.zeros((BINS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    bins, vals = got.column("bins").combine_chunks(), got.column("vals").combine_chunks()
    ptr = np.concatenate(([0], np.cumsum(np.asarray(bins.value_lengths())))).astype(np.int64)
    cols, vals = np.asarray(bins.flatten()).astype(np.int64), np.asarray(vals.flatten())
    df = np.bincount(cols, minlength=BINS)
    idf = np.where(df > 0, np.log((1 + len(y)) / (1 + df)) + 0.3, 0).astype(np.float32)
    idf[:WORD_BINS] *= 0.5
    vals = vals * idf[cols]
    by_col = np.argsort(cols, kind="stable")
    row_of = np.repeat(np.arange(len(y)), np.diff(ptr))[by_col]
    col_ptr = np.concatenate(([0], np.cumsum(df))).astype(np.int64)
    forth = lambda m: times(ptr, cols, vals, m)
    back = lambda m: times(col_ptr, row_of, vals[by_col], m)
    q = np.random.default_rng(seed).standard_normal((BINS, dims + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(forth(q))
        q, _ = np.linalg.qr(back(q))
    small = forth(q)
    _, _, vt = np.linalg.svd(small, full_matrices=False)
    basis = (q @ vt[:dims].T).astype(np.float32)
    return QualityModel(basis * idf[:, None], _unit(forth(basis)), y, float(y.mean()))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(model: QualityModel, latent: np.ndarray, neighbours: int, sharpness: float, block: int = 512) -> np.ndarray:
    """The weighted share of label 1 among the nearest labelled vectors by exact cosine; all that tie
    with the last of these vote as well."""
    out = np.full(len(latent), model.share)
    k = min(neighbours, len(model.labels))
    if not k:
        return out
    known = np.linalg.norm(latent, axis=1) > 1e-6
    latent = _unit(latent)
    for at in range(0, len(latent), block):
        cos = latent[at : at + block] @ model.points.T
        last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
        row, near = np.nonzero(cos >= last)
        w = np.maximum(cos[row, near], 0).astype(np.float64) ** sharpness + 1e-12
        own = np.bincount(row, w * model.labels[near], len(cos)) / np.bincount(row, w, len(cos))
        out[at : at + block] = np.where(known[at : at + block], own, model.share)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: QualityModel, neighbours: int = 15, sharpness: float = 8.0) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in text_chunks(batches):
            row, cols, vals = vectors(batch.column("text"))
            latent = times(np.searchsorted(row, np.arange(batch.num_rows + 1)), cols, vals, m.basis)
            yield pa.record_batch([batch.column("doc_id"), pa.array(vote(m, latent, neighbours, sharpness))], ["doc_id", "score"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, score double")

"""Toxic passages as maximum-scoring segments of token log-odds.

Every word has a log-odds of toxicity from its tokens in toxic and in other texts, under a Dirichlet prior whose mean is
that of its longest prefix, whose own prior is the next shorter one's, down to the base rate; so a word never seen takes
what its beginning suggests. All maximal scoring segments of a text are found in linear time; their scores are set
against the extreme-value law that clean texts follow, and the significant ones are aggregated and calibrated to a
probability. Null and empty texts have no segment and get the calibrated probability of that. Extra columns are left
alone, repeated rows are learned from and scored each, an empty table gives an empty result. Segments of equal score
each count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.language import LETTER
from skyloom.llm.tokens import span_hashes, spans, text_chunks, utf8_view
from skyloom.llm.training import labelled_sample

PREFIXES = (4, 5, 6)
PRIOR = 20.0
BIAS = 0.7
SIGNIFICANT = 0.05
_BIN = 0.05


@dataclass
class ToxicityModel:
    """hashes (sorted) and their log-odds; the law of clean texts (rate, log_k); the calibration's slope and offset."""

    hashes: np.ndarray
    odds: np.ndarray
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


def features(column: pa.Array):
    """Hashes of each word and its prefixes: [1 + prefixes, words], 0 where a word is no longer than the prefix; and
    per row the index of its first word."""
    data, offsets = utf8_view(pc.utf8_lower(column.fill_null("")))
    starts, ends, first = spans(LETTER[data], offsets)
    out = [span_hashes(data, starts, ends)]
    for p in PREFIXES:
        h = span_hashes(data, starts, np.minimum(ends, starts + p), salt=p * 0x5851F42D4C957F)
        out.append(np.where(ends - starts > p, h, np.uint64(0)))
    return np.stack(out), first


def _look_up(model: ToxicityModel, h: np.ndarray) -> np.ndarray:
    """Log-odds of each hash, NaN if unknown."""
    if not len(model.hashes):
        return np.full(h.shape, np.nan, np.float32)
    u, back = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(model.hashes, u), len(model.hashes) - 1)
    return np.where(model.hashes[at] == u, model.odds[at], np.float32(np.nan))[back].reshape(h.shape)


def word_scores(model: ToxicityModel, h: np.ndarray) -> np.ndarray:
    """A word's own log-odds, else those of its longest known prefix, else 0; less the bias that keeps chance below 0."""
    score = _look_up(model, h[0])
    for row in h[:0:-1]:
        todo = np.flatnonzero(np.isnan(score) & (row != 0))
        if len(todo):
            score[todo] = _look_up(model, row[todo])
    return np.nan_to_num(score, nan=0.0).astype(np.float64) - BIAS


def maximal_segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of one sequence, in linear time.

    Runs of positive scores enter as one. Each candidate remembers the nearest one to its left that starts lower, so
    the search for it skips what it has passed before.
    """
    positive = score > 0
    if not positive.any():
        return []
    total = np.concatenate(([0.0], np.cumsum(score)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], positive.astype(np.int8), [0]))))
    segs: list[list] = []  # low, high, start, end, index of the nearest lower one
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        low, high, start = float(total[a]), float(total[b]), a
        while True:
            j = len(segs) - 1
            while j >= 0 and segs[j][0] >= low:
                j = segs[j][4]
            if j < 0 or segs[j][1] >= high:
                segs.append([low, high, start, b, j])
                break
            low, start = segs[j][0], segs[j][2]
            del segs[j:]
    return [(hi - lo, s, e) for lo, hi, s, e, _ in segs]


def _statistic(model: ToxicityModel, segs: list, n: int) -> tuple[float, int]:
    """Nats by which significant segments exceed what n clean words would give, summed; and their number."""
    base = model.log_k + np.log(max(n, 1))
    over = [model.rate * s - base for s, _, _ in segs]
    over = [x for x in over if x > -np.log(SIGNIFICANT)]
    return sum(over), len(over)


def _best(segs: list) -> float:
    return max((s for s, _, _ in segs), default=0.0)


def parents(h: np.ndarray) -> np.ndarray:
    """The hash of the next shorter prefix of each word and prefix of features(); 0 for those whose prior is the base rate."""
    out = np.zeros_like(h)
    out[2:] = h[1:-1]
    for row in h[1:]:  # a word's is its longest
        out[0] = np.where(row != 0, row, out[0])
    return out


def posterior(h: np.ndarray, parent: np.ndarray, level: np.ndarray, n1: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Shares of toxic tokens: PRIOR tokens at the parent's share are added to each one's own; a parent's level is less."""
    order = np.argsort(h)
    at = order[np.minimum(np.searchsorted(h[order], parent), max(len(h) - 1, 0))] if len(h) else np.zeros(0, np.int64)
    share = np.full(len(h), base)
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        mean = np.where(parent[own] != 0, share[at[own]], base)
        share[own] = (n1[own] + PRIOR * mean) / (n[own] + PRIOR)
    return share


def train(docs: DataFrame, labels: DataFrame, limit: int = 20000) -> ToxicityModel:
    """Fit on labels(doc_id, toxic) and documents.

    Documented bound: about `limit` labelled rows; all words of these count, and so bound what comes to the driver. Odds
    are learned on 7 of 10 of them, the law and the calibration on the rest. Whole texts are read.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "toxic", limit).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)) < 7)

    def count(batches):
        for batch in text_chunks(batches):
            h, first = features(batch.column("text"))
            toxic = np.repeat(np.asarray(batch.column("y")) > 0, np.diff(first))
            kinds = np.repeat([len(h), *range(1, len(h))], h.shape[1])  # prefixes by length, then words
            flat, above, toxic = h.ravel(), parents(h).ravel(), np.tile(toxic, len(h))
            some = flat != 0
            u, one, back = np.unique(flat[some], return_index=True, return_inverse=True)
            n1, n = np.bincount(back, toxic[some], len(u)).astype(np.int64), np.bincount(back, minlength=len(u))
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(above[some][one].view(np.int64)), pa.array(kinds[some][one].astype(np.int32)), pa.array(n1), pa.array(n)], ["h", "parent", "level", "n1", "n"])

    got = (
        sample.filter("fit").select("text", "y").mapInArrow(count, "h bigint, parent bigint, level int, n1 bigint, n bigint")
        .groupBy("h").agg(F.max("parent").alias("parent"), F.max("level").alias("level"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
        .toArrow()
    )
    h, parent, level, n1, n = (np.asarray(got.column(c)) for c in ("h", "parent", "level", "n1", "n"))
    del got
    word = level == len(PREFIXES) + 1
    base = (n1[word].sum() + 0.5) / (n[word].sum() + 1)
    h, parent = h.astype(np.int64).view(np.uint64), parent.astype(np.int64).view(np.uint64)
    share = np.clip(posterior(h, parent, level, n1, n, base), 1e-4, 1 - 1e-4)
    odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
    order = np.argsort(h)
    model = ToxicityModel(h[order], odds[order].astype(np.float32))
    return _calibrate(spark, model, sample.filter("NOT fit").select("text", "y"))


def _calibrate(spark, model: ToxicityModel, rest: DataFrame) -> ToxicityModel:
    """The extreme-value law of clean texts, then a logistic fit of the summed excess. A bounded sample comes in."""
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in text_chunks(batches):
            h, first = features(batch.column("text"))
            s = word_scores(shared.value, h)
            out = []
            for i, y in enumerate(batch.column("y").to_pylist()):
                own = s[first[i] : first[i + 1]]
                at, n = np.unique(np.round(own / _BIN).astype(np.int64), return_counts=True)
                found = sorted((x for x, _, _ in maximal_segments(own)), reverse=True)
                out.append({"y": y, "n": len(own), "top": found, "bins": at.tolist() if y == 0 else [], "counts": n.tolist() if y == 0 else []})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("y", pa.int32()), ("n", pa.int64()), ("top", pa.list_(pa.float64())), ("bins", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))

    rows = rest.mapInArrow(measure, "y int, n bigint, top array<double>, bins array<bigint>, counts array<bigint>").collect()
    hist: dict[int, int] = {}
    for r in rows:
        for b, n in zip(r["bins"], r["counts"]):
            hist[b] = hist.get(b, 0) + n
    model.rate = _karlin_rate(hist)
    clean = [(r["top"][0], r["n"]) for r in rows if r["y"] == 0 and r["top"]]
    if clean:
        excess = np.array([model.rate * s - np.log(max(n, 1)) for s, n in clean])
        model.log_k = float(excess.mean() - 0.5772156649)
    x = np.array([np.log1p(_statistic(model, [(s, 0, 0) for s in r["top"]], r["n"])[0]) for r in rows])
    model.slope, model.offset = _logistic(x, np.array([float(r["y"] > 0) for r in rows]))
    return model


def _karlin_rate(hist: dict[int, int]) -> float:
    """The positive root of E[exp(rate * score)] = 1 over the scores of clean words; 1 if there is none."""
    if not hist or max(hist) <= 0:
        return 1.0
    s = np.array(list(hist)) * _BIN
    p = np.array(list(hist.values()), float)
    p /= p.sum()
    if p @ s >= 0:
        return 0.1
    low, high = 1e-6, 1.0
    while p @ np.exp(high * s) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return float(high)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method; the slope never turns negative."""
    if not len(x) or y.min() == y.max():
        return 1.0, -2.0
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, n_passages, passages): passages are the significant segments as first word, words, nats over."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("nats", pa.float64())]))

    def run(batches):
        m = shared.value
        for batch in text_chunks(batches):
            scores, passages = _score_rows(m, batch.column("text"))
            cols = [batch.column("doc_id"), pa.array(scores), pa.array([len(p) for p in passages], pa.int32()), pa.array(passages, kind)]
            yield pa.record_batch(cols, ["doc_id", "score", "n_passages", "passages"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, score double, n_passages int, passages array<struct<first_word:int,n_words:int,nats:double>>")


def _score_rows(m: ToxicityModel, column: pa.Array):
    h, first = features(column)
    s = word_scores(m, h)
    scores, passages = np.zeros(len(column)), []
    for i in range(len(column)):
        n = int(first[i + 1] - first[i])
        segs = maximal_segments(s[first[i] : first[i + 1]])
        base = m.log_k + np.log(max(n, 1))
        own = [{"first_word": a, "n_words": b - a, "nats": m.rate * x - base} for x, a, b in segs if m.rate * x - base > -np.log(SIGNIFICANT)]
        passages.append(own)
        scores[i] = 1 / (1 + np.exp(-np.clip(m.slope * np.log1p(sum(p["nats"] for p in own)) + m.offset, -30, 30)))
    return scores, passages


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept; decided row by row, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_chunks(batches):
            scores, _ = _score_rows(shared.value, batch.column("text"))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)

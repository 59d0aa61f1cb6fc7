"""SimHash fingerprints and their links within a Hamming distance, found by a generalised pigeonhole.

Null text counts as empty; an empty text has fingerprint zero and is linked like any other. Rows that repeat share a
fingerprint and so a class. A null doc_id still links others but is never the smallest id; a component of null ids
only has a null component_id. Extra columns are left alone: only doc_id and text are read. An empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.shared import materialize
from skyloom.llm.tokens import text_chunks
from skyloom.operators.components import connected_components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HIST_BITS = 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text: word shingles joined by a space, XXH64, and a bit is 1 if set in over half."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of docs."""

    def run(batches):
        for batch in text_chunks(batches):
            fp = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def bit_counts(classes: DataFrame) -> np.ndarray:
    """How often each pair of bits is set together, over all classes; 64 x 64. Each task sends one row of counts."""

    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            fp = np.asarray(batch.column("fp")).astype(np.int64).view(np.uint64)
            bits = _bits(fp).astype(np.float32)
            total += bits.T @ bits
        yield pa.record_batch([pa.array([total.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], ["counts"])

    summed = (
        classes.select("fp")
        .mapInArrow(run, "counts array<bigint>")
        .select(F.posexplode("counts").alias("at", "n"))
        .groupBy("at")
        .agg(F.sum("n").alias("n"))
        .collect()
    )  # 4,096 rows, whatever the input
    out = np.zeros(4096)
    for r in summed:
        out[r["at"]] = r["n"]
    return out.reshape(64, 64)


def _bits(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, lowest bit first."""
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partition the 64 bits into `parts` groups so that correlated bits share one: few skewed groups, not many."""
    p = together / max(n, 1)
    mean = np.diag(p)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    corr = np.abs((p - np.outer(mean, mean)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        # the most one-sided bit first: such bits select least, and gather in one group with their like
        seed = max(left, key=lambda b: (abs(mean[b] - 0.5), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def part_values(fp: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """The value of each group's bits, gathered into an integer."""
    bits = _bits(fp)
    return [bits[:, g].astype(np.int64) @ (np.int64(1) << np.arange(len(g), dtype=np.int64)) for g in groups]


def parts_for(n: int, distance: int) -> int:
    """Number of groups: one for each error and one more, fewer once their buckets would hold many classes."""
    parts = distance + 1
    while parts > 2 and n > 256 << (64 // parts):
        parts -= 1
    return parts


def candidate_costs(histograms: list[np.ndarray], groups: list[list[int]], distance: int) -> list[np.ndarray]:
    """For each group an array [threshold + 1, value's low bits] of estimated candidates plus probes; 0 for threshold -1."""
    out = []
    for hist, group in zip(histograms, groups):
        width = len(group)
        low = min(width, _HIST_BITS)
        scale = 1.0 / (1 << (width - low))
        values = np.arange(1 << low)
        cost = np.zeros((distance + 2, 1 << low), np.float32)
        near, probes = np.zeros(1 << low), 0
        for t in range(distance + 1):
            if t <= width:
                for flip in combinations(range(low), min(t, low)):
                    near = near + hist[values ^ sum(1 << b for b in flip)]
                probes += _choose(width, t)
            spread = probes / max(1, sum(_choose(low, j) for j in range(t + 1)))
            cost[t + 1] = near * scale * spread + probes
        out.append(cost)
    return out


def _choose(n: int, k: int) -> int:
    return len(list(combinations(range(n), k))) if k <= 3 else 0


def allocate(costs: np.ndarray, budget: int) -> np.ndarray:
    """Dynamic programming per row: thresholds of least total cost, each -1 or more, whose sum is `budget`.

    costs: [rows, groups, thresholds from -1]. By the generalised pigeonhole, two fingerprints at distance d or less
    have a group within its threshold if the thresholds sum to d - groups + 1.
    """
    rows, groups, levels = costs.shape
    spend = budget + groups  # thresholds counted from -1 as 0
    best = np.full((groups + 1, rows, spend + 1), np.inf)
    best[0, :, 0] = 0
    took = np.zeros((groups, rows, spend + 1), np.int8)
    for g in range(groups):
        for s in range(spend + 1):
            options = np.stack([best[g, :, s - t] + costs[:, g, t] for t in range(min(levels - 1, s) + 1)])
            took[g, :, s] = options.argmin(0)
            best[g + 1, :, s] = options.min(0)
    out = np.zeros((rows, groups), np.int8)
    at, every = np.full(rows, spend), np.arange(rows)
    for g in reversed(range(groups)):
        out[:, g] = took[g, every, at]
        at = at - out[:, g]
    return out - 1


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """(src, dst): every pair of distinct fingerprints of `classes(fp)` that differ in `distance` or fewer bits.

    Bits are grouped by correlation; each fingerprint gets its own thresholds from the bucket histograms and probes the
    values within them; the join checks the distance before it makes a row. No bucket is capped.
    """
    n = classes.count()
    groups = group_bits(bit_counts(classes), n, parts_for(n, distance))
    k = len(groups)
    spark = classes.sparkSession

    def keys(batches, make):
        for batch in batches:
            fp = np.asarray(batch.column("fp")).astype(np.int64)
            for at in range(0, len(fp), 1 << 13):
                yield from make(fp[at : at + (1 << 13)])

    def rows(part, key, fp):
        return pa.record_batch([pa.array(part.astype(np.int32)), pa.array(key), pa.array(fp)], ["part", "key", "fp"])

    def stored(batches):
        def make(fp):
            for g, v in enumerate(part_values(fp.view(np.uint64), groups)):
                yield rows(np.full(len(fp), g), v, fp)

        yield from keys(batches, make)

    index = classes.select("fp").mapInArrow(stored, "part int, key bigint, fp bigint")
    counted = index.groupBy("part", F.col("key").bitwiseAND((1 << _HIST_BITS) - 1).alias("low")).agg(F.count("*").alias("n"))
    hist = [np.zeros(1 << min(len(g), _HIST_BITS)) for g in groups]
    got = counted.toPandas()  # at most 65,536 rows for each of at most four groups
    for g in range(k):
        own = got[got.part == g]
        hist[g][own.low.to_numpy(np.int64)] = own.n.to_numpy()
    costs = spark.sparkContext.broadcast(candidate_costs(hist, groups, distance))

    def probed(batches):
        flips = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(g)), t)], np.int64) for t in range(distance + 1)] for g in groups]

        def make(fp):
            values = part_values(fp.view(np.uint64), groups)
            cost = np.stack([c[:, v & (c.shape[1] - 1)].T for c, v in zip(costs.value, values)], axis=1)
            level = allocate(cost, distance - k + 1)
            for g in range(k):
                for t in range(distance + 1):
                    own = np.flatnonzero(level[:, g] >= t)
                    if len(own):
                        for cut in np.array_split(own, max(1, len(own) * len(flips[g][t]) >> 17)):
                            key = (values[g][cut][:, None] ^ flips[g][t][None, :]).ravel()
                            yield rows(np.full(len(key), g), key, np.repeat(fp[cut], len(flips[g][t])))

        yield from keys(batches, make)

    probes = classes.select("fp").mapInArrow(probed, "part int, key bigint, fp bigint")
    a, b = probes.alias("a"), index.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    return (
        a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id that links reach."""
    fps = materialize(fingerprints(docs, width, seed), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    reach = connected_components(links(classes, distance)).withColumnRenamed("node", "fp")
    rooted = classes.join(reach, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = rooted.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")

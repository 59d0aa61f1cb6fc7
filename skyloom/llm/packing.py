"""Packing along a space-filling curve.

Each document is tokenised once; its hashed token vector is projected to few dimensions and gets a Hilbert key;
documents are range-sorted by that key and laid end to end along the curve, and the line is cut every 4,096 tokens. So
neighbours share sequences and only the last sequence is padded. Null text is empty and has the closing token alone.
Repeated rows are packed each. A sort key that many documents share is split between tasks by a hash of the id.
Extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.shared import materialize
from skyloom.llm.tokens import mix, text_chunks
from skyloom.llm.wordpieces import encoder

DIMS, BITS, BUCKETS = 4, 10, 1024


def projection(seed: int = 17) -> np.ndarray:
    """A fixed matrix of random signs, [buckets, dims]."""
    bits = mix(np.arange(BUCKETS * DIMS, dtype=np.uint64) + np.uint64(seed << 32))
    return np.where(bits >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMS).astype(np.float32)


def points(ids: np.ndarray, offsets: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """[rows, dims] integers below 2**BITS: projected directions of the hashed token vectors, spread evenly."""
    rows = len(offsets) - 1
    out = np.zeros((rows, DIMS), np.int64)
    bucket = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)[ids]
    for at in range(0, rows, 256):
        end = min(rows, at + 256)
        a, b = offsets[at], offsets[end]
        row = np.repeat(np.arange(end - at), np.diff(offsets[at : end + 1]))
        v = np.sqrt(np.bincount(row * BUCKETS + bucket[a:b], minlength=(end - at) * BUCKETS).reshape(end - at, BUCKETS)).astype(np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        z = v @ matrix  # about normal with unit variance
        share = 1 / (1 + np.exp(-1.702 * z))
        out[at:end] = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return out


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each point of an n-dimensional grid on its Hilbert curve, after Skilling's transform."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def tokenised(docs: DataFrame, tokenizer: str, closing: int) -> DataFrame:
    """(doc_id, key, salt, n, ids): ids as little-endian 16-bit numbers, the closing one included."""

    def run(batches):
        own, matrix = encoder(tokenizer), projection()
        for batch in text_chunks(batches):
            flat, cut = own.encode(batch.column("text"))
            flat = np.insert(flat, cut[1:], closing).astype("<u2")
            cut = cut + np.arange(len(cut))
            if cut[-1] >= 1 << 30:
                raise ValueError("a text of 2**30 tokens or more does not fit a row")
            key = hilbert_key(points(flat, cut, matrix))
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((cut * 2).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(key), pa.array(np.diff(cut)), ids], ["doc_id", "key", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key bigint, n bigint, ids binary")
    return made.withColumn("salt", F.xxhash64("doc_id", F.crc32("ids")))


def pack(docs: DataFrame, tokenizer: str, closing: int = 2, length: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids also ids (32-bit).

    The token table is written, range-sorted and written again to the shared folder, each task noting where in its part
    every document begins; sums of the parts (a row for each task) give the global place, and so the cuts.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lay(batches):
        at = 0
        for batch in batches:
            n = np.asarray(batch.column("n")).astype(np.int64)
            begins = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(begins), pa.array(n), batch.column("ids")], ["doc_id", "part", "begins", "n", "ids"])

    # written first: the range sort samples its input, which else would be tokenised once more
    ordered = materialize(tokenised(docs, tokenizer, closing), "tokenised", "zstd").repartitionByRange(tasks, "key", "salt").sortWithinPartitions("key", "salt", "doc_id")
    laid = materialize(ordered.select("doc_id", F.spark_partition_id().alias("part"), "n", "ids").mapInArrow(lay, f"doc_id {kind}, part int, begins bigint, n bigint, ids binary"), "laid", "zstd")
    totals = sorted((r["part"], r["n"]) for r in laid.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, so_far = {}, 0
    for part, n in totals:
        base[part] = so_far
        so_far += n

    def cut(batches):
        for batch in batches:
            doc, part, begins = batch.column("doc_id"), batch.column("part").to_pylist(), batch.column("begins").to_pylist()
            which, rows, chunks = [], [], []
            for i, (p, b, raw) in enumerate(zip(part, begins, batch.column("ids"))):
                ids = np.frombuffer(raw.as_buffer(), "<u2").astype("<u4")
                place, start = base[p] + b, 0
                while start < len(ids):
                    take = min(len(ids) - start, length - (place + start) % length)
                    piece = ids[start : start + take].tobytes()
                    which.append(i)
                    rows.append((start, take, zlib.crc32(piece), len(ids), (place + start) // length, (place + start) % length))
                    if with_ids:
                        chunks.append(np.frombuffer(piece, "<i4"))
                    start += take
            cols = np.array(rows, np.int64).reshape(-1, 6).T
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [doc.take(pa.array(which, pa.int32())), *(pa.array(c) for c in cols)]
            if with_ids:
                names.append("ids")
                arrays.append(pa.array(chunks, pa.list_(pa.int32())))
            yield pa.record_batch(arrays, names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return laid.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))

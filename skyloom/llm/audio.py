"""Chroma audio fingerprints of a media column, and recordings aligned by them.

A recording (WAV, 16-bit mono) becomes pitch-class frames; sixteen rectangle filters over their integral image, each
quantised to two bits, give one 32-bit integer for each place. Two recordings are aligned where the offsets of equal
integers pile up, and accepted by the share of unequal bits along that offset. Recordings with equal fingerprints form
a class; pairs are sought between classes only.

Null, broken or too short media have an empty fingerprint and match nothing. Rows that repeat an id or a recording
fall into a class. Extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.shared import materialize

RATE, FRAME, HOP = 8000, 2048, 683
LOW_HZ, HIGH_HZ = 28.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
SPAN = 8
#: The least number of equal integers at one offset, and the largest share of unequal bits, of a match.
MIN_VOTES, MAX_BIT_ERROR = 3, 0.2


def filters(n: int = 16) -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of each filter, dealt evenly over kinds, places and sizes."""
    return [(i % 4, (i * 7) % 12 // (1 + (i * 5) % 3), 3 + (i * 5) % 6, 2 + (i * 3) % (SPAN - 1)) for i in range(n)]


def _classes() -> np.ndarray:
    """[frequency bins, 12]: which pitch class a bin of the spectrum belongs to."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    ok = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    out[np.flatnonzero(ok), np.round(12 * np.log2(hz[ok] / 440.0)).astype(int) % 12] = 1
    return out


_CLASSES = _classes()
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """[frames, 12]: smoothed pitch-class energies of unit length."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    energy = np.empty((n, 12), np.float32)
    for at in range(0, n, 256):
        energy[at : at + 256] = np.abs(np.fft.rfft(frames[at : at + 256] * _HANN)) ** 2 @ _CLASSES
    m = n - len(SMOOTH) + 1
    smooth = sum(w * energy[i : i + m] for i, w in enumerate(SMOOTH))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-3, smooth / np.maximum(norm, 1e-9), 0).astype(np.float32)


def pack_filters(frames: np.ndarray) -> np.ndarray:
    """The 32-bit integers of pitch-class frames, by sums over rectangles of the integral image."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0, dtype=np.float64).cumsum(1)
    x = np.arange(n)
    area = lambda a, b, c, d: image[x + b, d] - image[x + a, d] - image[x + b, c] + image[x + a, c]
    out = np.zeros(n, np.uint32)
    for k, (kind, low, high, wide) in enumerate(filters()):
        top = min(12, low + high)
        mid, half = (low + top) // 2, wide // 2
        if kind == 0:  # a rectangle against the whole
            a, b = area(0, wide, low, top) * 12 / max(1, top - low), area(0, wide, 0, 12)
        elif kind == 1:  # lower against upper pitch classes
            a, b = area(0, wide, low, mid), area(0, wide, mid, top)
        elif kind == 2:  # before against after
            a, b = area(0, half, low, top) / half, area(half, wide, low, top) / (wide - half)
        else:  # crosswise
            a, b = area(0, half, low, mid) + area(half, wide, mid, top), area(half, wide, low, mid) + area(0, half, mid, top)
        v = np.log((1e-2 + a) / (1e-2 + b))
        level = (v > -0.7).astype(np.uint32) + (v > 0) + (v > 0.7)
        out |= (level ^ level >> 1).astype(np.uint32) << np.uint32(2 * k)
    return out


def fingerprint(media: bytes | None) -> np.ndarray:
    """The packed integers of a WAV recording; none if it is null, unreadable or too short."""
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            if w.getsampwidth() != 2 or w.getnchannels() != 1 or w.getframerate() != RATE:
                return np.zeros(0, np.uint32)
            samples = np.frombuffer(w.readframes(w.getnframes()), "<i2")
    except (wave.Error, EOFError):
        return np.zeros(0, np.uint32)
    return pack_filters(chroma(samples.astype(np.float32) / 32768))


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, fp): fp holds the packed integers, signed."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = [fingerprint(m).view(np.int32) for m in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(fp, pa.list_(pa.int32()))], ["id", "fp"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInArrow(run, f"id {kind}, fp array<int>")


def melody(vector: np.ndarray, step_s: float = 0.16) -> bytes:
    """A recording made from a vector: each pair of its numbers is a note, by fixed steps of pitch and loudness, so
    that near vectors sound alike."""
    step = int(RATE * step_s)
    pairs = np.nan_to_num(np.asarray(vector, np.float64))[: len(vector) // 2 * 2].reshape(-1, 2)
    note = np.clip(np.floor(18 + pairs[:, 0] * 48), 0, 35).astype(int)
    loud = np.clip(np.floor(6 + pairs[:, 1] * 16), 2, 10) / 16
    t = np.arange(step) / RATE
    fade = np.minimum(1, np.minimum(np.arange(step), np.arange(step)[::-1]) / 80)
    sounds = np.sin(2 * np.pi * (110 * 2 ** (np.arange(36) / 12))[:, None] * t) * fade
    pcm = np.clip(sounds[note] * loud[:, None] * 32767, -32768, 32767).astype("<i2").tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(pcm)
    return out.getvalue()


def with_recordings(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, media): the vectors as recordings. A null vector has none."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                media = [None if v is None else melody([x if x is not None else 0.0 for x in v]) for v in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(media, pa.binary())], [id_col, "media"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).mapInArrow(run, f"{id_col} {kind}, media binary")


def align(prints: DataFrame, is_query, min_votes: int = MIN_VOTES, max_bit_error: float = MAX_BIT_ERROR) -> DataFrame:
    """One row for each row of prints(id, fp): id, class_id (least id of equal fingerprints), n_prints, and at the class
    representative the matches of its class with query classes: query_id, offset, votes, bit_error.

    is_query: a condition on id; a class is a query if one of its rows is. Runs of equal integers vote once, by their
    start, so a held note does not multiply. Every offset with min_votes is verified; of those within the bit error the one
    with most votes stays.
    """
    prints = prints.withColumn("h1", F.xxhash64("fp")).withColumn("h2", F.xxhash64("fp", F.lit(1)))
    classes = materialize(
        prints.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.first("fp").alias("fp"), F.max(F.coalesce(is_query, F.lit(False))).alias("query")), "audio-classes"
    )
    heads = F.filter(F.transform("fp", lambda v, i: F.struct(v.alias("value"), i.alias("at"), F.when(i == 0, True).otherwise(F.col("fp")[i - 1] != v).alias("new"))), lambda s: s["new"])
    known = classes.filter("class_id IS NOT NULL AND size(fp) > 0")
    posted = known.select("class_id", "query", F.explode(heads).alias("p")).select("class_id", "query", "p.value", "p.at")
    asked = posted.filter("query").select(F.col("class_id").alias("query_id"), "value", F.col("at").alias("q_at"))
    votes = (
        asked.join(posted.select("class_id", "value", "at"), "value").filter("query_id != class_id")
        .groupBy("query_id", "class_id", (F.col("at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("votes"))
        .filter(F.col("votes") >= min_votes)
    )
    fp = known.select("class_id", "fp")
    q = fp.select(F.col("class_id").alias("query_id"), F.col("fp").alias("q_fp"))
    pairs = votes.join(fp, "class_id").join(q, "query_id")
    start, q_start = F.greatest(F.col("offset"), F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    length = F.least(F.size("fp") - start, F.size("q_fp") - q_start)
    wrong = F.aggregate(F.zip_with(F.slice("fp", start + 1, length), F.slice("q_fp", q_start + 1, length), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    found = pairs.withColumn("bit_error", F.round(wrong / (32 * length), 6)).filter(F.col("bit_error") <= max_bit_error)
    best = F.max_by(F.struct("offset", "votes", "bit_error"), F.struct("votes", -F.col("bit_error"), -F.abs("offset"), "offset"))
    found = found.groupBy("query_id", "class_id").agg(best.alias("best")).select("query_id", "class_id", "best.*")
    matches = found.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("query_id", "offset", "votes", "bit_error"))).alias("matches"))
    named = classes.join(matches, "class_id", "left").select("h1", "h2", "class_id", "matches")
    out = prints.join(named, ["h1", "h2"])
    mine = F.when(F.col("id") == F.col("class_id"), F.col("matches"))
    return out.select("id", "class_id", F.size("fp").alias("n_prints"), F.coalesce(mine, F.array().cast(named.schema["matches"].dataType)).alias("matches"))

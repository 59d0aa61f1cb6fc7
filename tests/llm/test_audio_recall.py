"""Altered recordings are found again at the production bounds."""

import io
import wave

import numpy as np

from skyloom.llm import audio


def _wav(samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(audio.RATE)
        w.writeframes(np.clip(samples, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def _samples(media):
    with wave.open(io.BytesIO(media)) as w:
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float)


def test_recall_of_altered_recordings(spark):
    rng = np.random.default_rng(9)
    originals = [audio.melody(rng.normal(0, 0.2, 128)) for _ in range(30)]
    rows, altered = [], {}
    for i, media in enumerate(originals):
        s = _samples(media)
        rows.append((i, media))
        noise = rng.normal(0, np.sqrt((s**2).mean() / 100), len(s))  # 20 dB below
        for kind, other in enumerate((s[audio.HOP * 6 :], s * 0.5, s + noise)):
            key = 1000 + 10 * i + kind
            altered[key] = i
            rows.append((key, _wav(other)))
    rows += [(5000, None), (5001, b"not a wav"), (5002, _wav(np.zeros(100)))]
    table = spark.createDataFrame(rows, "id long, media binary").withColumnRenamed("media", "h1")
    prints = audio.fingerprints(table, "id", "h1")
    got = {r["id"]: r for r in audio.align(prints, prints["id"] < 1000).collect()}
    found = {k: {m["query_id"] for m in got[got[k]["class_id"]]["matches"]} | {got[k]["class_id"]} for k in altered}
    assert np.mean([got[i]["class_id"] in found[k] for k, i in altered.items()]) >= 0.9
    assert np.mean([len(f - {got[altered[k]]["class_id"], k}) == 0 for k, f in found.items()]) >= 0.9
    assert all(got[k]["n_prints"] == 0 and got[k]["matches"] == [] for k in (5000, 5001, 5002))

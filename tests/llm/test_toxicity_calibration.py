"""Calibration sees every segment that scoring would sum."""

import numpy as np
import pyarrow as pa

from skyloom.llm import toxicity


def test_calibration_takes_all_segments(spark, monkeypatch):
    odds = {}
    for word, value in (("bad", 3.0), ("good", -4.0)):
        odds |= {int(h): value for h in toxicity.features(pa.array([word]))[0].ravel() if h}
    h = np.array(sorted(odds), np.uint64)
    model = toxicity.ToxicityModel(h, np.array([odds[int(x)] for x in h], np.float32))
    seen = []
    real = toxicity._statistic
    monkeypatch.setattr(toxicity, "_statistic", lambda m, segments, n: seen.append(len(segments)) or real(m, segments, n))
    text = " ".join(["bad", "good"] * 200)
    toxicity._calibrate(spark, model, spark.createDataFrame([(text, 1), ("good good", 0)], "text string, y int"))
    h, first = toxicity.features(pa.array([text]))
    assert max(seen) == len(toxicity.maximal_segments(toxicity.word_scores(model, h))) > 64

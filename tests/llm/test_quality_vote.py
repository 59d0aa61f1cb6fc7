"""The nearest-neighbour vote against a plain loop, with ties and without labels."""

import numpy as np

from skyloom.llm import quality


def _brute(model, x, k, sharpness):
    if not len(model.labels) or np.linalg.norm(x) <= 1e-6:
        return model.share
    cos = [float(np.float32(p @ (x / np.linalg.norm(x)))) for p in model.points]
    last = sorted(cos, reverse=True)[min(k, len(cos)) - 1]
    voting = [(max(c, 0) ** sharpness + 1e-12, y) for c, y in zip(cos, model.labels) if c >= last - 1e-6]
    return sum(w * y for w, y in voting) / sum(w for w, _ in voting)


def test_vote_equals_brute_force():
    rng = np.random.default_rng(4)
    points = quality._unit(rng.standard_normal((60, 5)).astype(np.float32))
    points[20:30] = points[3]  # ten that tie
    model = quality.QualityModel(np.zeros((1, 5), np.float32), points, rng.integers(0, 2, 60).astype(np.float32), 0.4)
    asked = np.concatenate((rng.standard_normal((40, 5)), points[3:4], np.zeros((1, 5)))).astype(np.float32)
    got = quality.vote(model, asked, 7, 8.0, block=16)
    assert np.allclose(got, [_brute(model, x, 7, 8.0) for x in asked], atol=1e-4)


def test_vote_without_labels_is_the_share():
    none = quality.QualityModel(np.zeros((1, 2), np.float32), np.zeros((0, 2), np.float32), np.zeros(0, np.float32), 0.5)
    assert quality.vote(none, np.ones((3, 2), np.float32), 5, 2.0).tolist() == [0.5] * 3

"""The true offset is found at the production bounds though repeated notes give another more votes."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import audio


def test_every_voted_offset_is_verified(spark):
    rng = np.random.default_rng(8)
    ints = lambda n: rng.integers(-(2**31), 2**31, n).tolist()
    votes = audio.MIN_VOTES
    chorus, rest = ints(votes + 4), ints(4 * votes + 40)
    query = chorus + rest
    noisy = [x ^ 1 for x in query]
    noisy[len(chorus) : len(chorus) + votes] = rest[:votes]
    other = noisy + chorus + ints(2 * len(query))
    prints = spark.createDataFrame([(100, query), (7, other)], "id long, fp array<int>")
    got = {r["id"]: r for r in audio.align(prints, F.col("id") % 100 == 0).collect()}
    match = got[7]["matches"]
    length = len(query)
    errors = {o: sum(((a ^ b) & 0xFFFFFFFF).bit_count() for a, b in zip(query, other[o:])) / (32 * length) for o in range(len(other) - length + 1)}
    assert [(m["query_id"], m["offset"], m["votes"]) for m in match] == [(100, min(errors, key=errors.get), votes)]
    assert abs(match[0]["bit_error"] - min(errors.values())) < 1e-6

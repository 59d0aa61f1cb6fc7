"""The language model against brute force: probabilities of texts, and sums over all next words."""

import re
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import eliasfano, ngram

TEXTS = ["a b a b c", "a b c", "b c a b", "A b a B c", "", "c c c c", "d", "a b a b c d a b"]


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), "</>"]


class Brute:
    def __init__(self, texts):
        self.c1, self.c2, self.c3 = Counter(), Counter(), Counter()
        for t in map(_tokens, texts):
            self.c1.update(t)
            self.c2.update(zip(["</>", *t], t))
            self.c3.update(zip(["</>", *t], t, t[1:]))
        self.n, self.v = sum(self.c1.values()), len(self.c1)

    def p(self, context, w):
        if not context:
            return (self.c1[w] + 0.5) / (self.n + 0.5 * (self.v + 1))
        table = (self.c2, self.c3)[len(context) - 1]
        own = {k[-1]: c for k, c in table.items() if k[:-1] == tuple(context)}
        total, lower = sum(own.values()), self.p(context[1:], w)
        return max(own.get(w, 0) - 0.75, 0) / total + 0.75 * len(own) / total * lower if total else lower

    def log(self, text):
        t = _tokens(text)
        return sum(np.log10(self.p((["</>", *t][i - 1 : i + 1] if i else ["</>"]), w)) for i, w in enumerate(t))


def _scores(spark, texts, model):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in ngram.score(rows, model).collect()}


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_scores_equal_brute_force(spark, parts):
    rng = np.random.default_rng(7)
    texts = TEXTS + [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 60)) if x < 400) for _ in range(60)]
    ask = [*texts, "zzz", "a zzz b", "w1 w1 w1 w2 zz w1", None, "w1 a w2 b w3 c"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        model = ngram.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
        got = _scores(spark, ask, model)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    brute = Brute(texts)
    for i, text in enumerate(ask):
        n = len(_tokens(text))
        assert abs(got[i]["score"] - brute.log(text)) < 4e-4 * n, text
        assert got[i]["n_tokens"] == n


def test_next_words_sum_to_one(spark):
    model = ngram.train(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    words = ["a", "b", "c", "d"]
    for context in ("", "a", "a b", "b c", "c c", "d a", "d d"):
        texts = [f"{context} {w}".strip() for w in [*words, "unknown"]] + [context]
        got = [r["score"] for _, r in sorted(_scores(spark, texts, model).items())]
        # a text's score is its words' and its end's: take the ends off by the texts' own contexts
        brute = Brute(TEXTS)
        ends = [np.log10(brute.p((["</>", *t][-2:]) if len(t) > 0 else ["</>"], "</>")) for t in (_tokens(x)[:-1] for x in texts)]
        own = brute.log(context) - ends[-1]
        total = sum(10 ** (s - e - own) for s, e in zip(got[:-1], ends)) + 10 ** (got[-1] - own)
        assert abs(total - 1) < 3e-3, context


def test_children_of_nodes():
    rng = np.random.default_rng(2)
    rows = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 900), rng.integers(0, 10**9, 900))} | {(3, 0), (49, 5)})
    parent, child = map(np.array, zip(*rows))
    level = eliasfano.Children(np.frombuffer(eliasfano.encode_children(60, parent, child), np.uint8))
    assert (level.find(parent, child) == np.arange(len(rows))).all()
    ask = np.sort(rng.integers(0, 60, 500)), rng.integers(0, 10**9, 500)
    assert [x >= 0 for x in level.find(*ask).tolist()] == [(a, b) in set(rows) for a, b in zip(*map(np.ndarray.tolist, ask))]
    assert (level.begin(np.arange(61)) == np.searchsorted(parent, np.arange(61))).all()

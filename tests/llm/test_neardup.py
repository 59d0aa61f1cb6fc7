"""The near_dedup stage of the pipeline against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from skyloom.llm import neardup, simhash


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def _kept(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d) for i, (d, _) in enumerate(rows) if d is None or least[find(i)] == d))


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows = [(900, ""), (901, None), (902, "one TWO"), (903, "One two"), (904, "one three"), (None, "one two")]
    for g in range(30):
        base = [word() for _ in range(rng.randrange(20, 200))] + passage * (g % 2)
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == _kept(rows)


def test_near_dedup_finds_copies_that_simhash_misses(spark):
    words = [f"w{i}" for i in range(60)]
    other = [*words[:30], "changed", *words[31:]]
    assert (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(other))).bit_count() > 3
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [1]


def _print(text):
    """SimHash over the set of five-word shingles."""
    ones = np.unpackbits(neardup.shingle_sets(pa.array([text]))[0].view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * ones.sum(0) > len(ones))


def test_near_dedup_finds_similar_sets_whose_simhashes_lie_far_apart(spark):
    rng, rows = random.Random(3), []
    while len(rows) < 20:
        words = [f"w{rng.randrange(10**6)}" for _ in range(20)]
        a, b = " ".join(words[:-2] + ["end"]), " ".join(words)
        if len(_shingles(a) & _shingles(b)) * 5 >= 4 * len(_shingles(a) | _shingles(b)) and np.unpackbits(_print(a) ^ _print(b)).sum() > 18:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(0, 20, 2))


def test_first_shingles_are_a_fifth_and_one_more():
    sets = neardup.shingle_sets(pa.array([" ".join(f"{d} {i}" for i in range(n)) for d, n in enumerate([0, 1, 5, 40, 700])]))
    known = np.sort(sets[3][::3])
    token, out = neardup.first_shingles(sets, known, np.full(len(known), 9))
    assert len(token) == len(out) == sum(len(s) // 5 + 1 for s in sets if len(s))
    assert not np.isin(token, known).any()  # frequent ones come last


def _long_lists(rng):
    """Texts that share frequent shingles, in several groups and none."""
    base, rows = [f"b{i}" for i in range(60)], []
    for g in range(2):
        kind = [w if rng.random() > 0.03 * g else f"g{g}-{i}" for i, w in enumerate(base)]
        for _ in range(250):
            copy = list(kind)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy[: rng.randrange(50, 61)])))
    return rows


def test_long_lists_lose_no_link(spark, monkeypatch):
    rows = _long_lists(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _kept(rows)
    for limit in (neardup._DRIVER_LINKS, 0):  # components by the driver, and by joins
        monkeypatch.setattr(neardup, "_DRIVER_LINKS", limit)
        assert sorted(str(r["doc_id"]) for r in neardup.keep_one_per_group(docs).collect()) == want
    met = neardup.candidates(docs, 10**4)
    assert not met.filter("members IS NOT NULL").isEmpty()


def test_near_copies_are_not_paired_again_in_each_task(spark):
    rng, rows = random.Random(4), []
    for g in range(30):
        words = [f"g{g}-{i}" for i in range(1000)]
        for _ in range(2):
            words[rng.randrange(1000)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        met = neardup.candidates(docs, 10**4).select("src", "dst").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(set(met)) == 30 and len(met) <= 30 * 2


def test_all_similar_sets_meet_in_some_list(monkeypatch):
    monkeypatch.setattr(neardup, "_LIST", 12)
    rng, texts = random.Random(6), []
    for g in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.choice([2, 3, 20])):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(copy) // 50)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(300)}"
            texts.append(" ".join(copy[rng.randrange(2) : len(copy) - rng.randrange(3)]))
    sets = {neardup._class(s): s for s in neardup.shingle_sets(pa.array(texts))}
    known, often = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    token, out = neardup.first_shingles(list(sets.values()), known, often)
    task, met, long = (token >> np.uint64(32)) % np.uint64(7), set(), 0
    dealt = neardup._dealt(out, task.astype(np.int64))
    rows = np.concatenate([neardup._shared(neardup._listed([dealt.slice(t, 1)])) for t in range(7)])
    rows = np.concatenate([neardup._chained(rows[rows["c"] % 5 == t]) for t in range(5)])
    for t in range(7):
        pairs, lists = neardup._meet(rows[(rows["list"] - 1) >> 32 == t])
        met |= {tuple(p) for p in pairs.tolist()}
        for x in lists:
            met |= {(a, b) for a in x["c"].tolist() for b in x["c"].tolist() if a < b}
        long += len(lists)
    names = sorted(sets)
    same = {(a, b) for a in names for b in names if a < b and 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert same <= met and len(same) > 300 and long

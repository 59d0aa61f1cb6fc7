"""Which rows each stage of the pipeline keeps, against plain Python on the smallest tables, and odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from skyloom.llm import neardup, queries, quality, secrets, toxicity
from skyloom.llm.wordpieces import encoder
from tests.llm.test_neardup import _kept

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _windows(words):
    n = min(13, len(words))
    return {(n, *words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _leaks(text, items):
    words = _words(text)
    return any(tuple(words[i : i + w[0]]) == w[1:] for w in items for i in range(len(words) - w[0] + 1))


def test_stages_keep_what_plain_python_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = stages["toxicity"](spark, docs, SF)
    scores = {r["doc_id"]: r["score"] for r in queries.op5_toxicity(spark, SF).collect()}
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert left == {i: t for i, t in rows.items() if scores[i] < 0.7} and len(left) < len(rows)
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    after = stages["near_dedup"](spark, kept, SF)
    assert sorted(str(r["doc_id"]) for r in after.collect()) == _kept(list(left.items()))
    kept = spark.createDataFrame(after.collect(), docs.schema)
    items = set().union(*(_windows(_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    after = stages["decontamination"](spark, kept, SF)
    want = {r["doc_id"] for r in kept.collect() if not _leaks(r["text"], items)}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) < kept.count()
    kept = spark.createDataFrame(after.collect(), docs.schema)
    after = {r["doc_id"]: r for r in stages["secrets"](spark, kept, SF).collect()}
    assert {i: r["text"] for i, r in after.items()} == {r["doc_id"]: secrets.redact_text(r["text"]) for r in kept.collect()}
    packed = Counter(r["doc_id"] for r in stages["packing"](spark, spark.createDataFrame(list(after.values()), docs.schema), SF).collect() for _ in range(r["length"]))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.word_tokenizer())
    assert packed == Counter({i: len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in after.items()})


def test_near_dedup_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (3, long), (3, "a text of its own that nobody else has"), (5, "twice"), (5, "twice"), (None, "lost"), (None, "lost"), (7, None), (8, ""), (9, "lost")]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).withColumnRenamed("n_chars", "th").withColumnRenamed("lang", "c")
    got = neardup.keep_one_per_group(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, long), (3, "a text of its own that nobody else has"), (5, "twice"), (None, "lost"), (None, "lost"), (7, None), (9, "lost")])
    assert neardup.keep_one_per_group(docs.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (5, "tie " * 3000), (6, "password=abcdefgh x")]
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {1, 3, None, 5, 6}


def test_words_take_the_share_of_their_prefix():
    h = np.array([5, 9, 2], np.uint64)  # a word, its prefix, and a prefix of that
    share = toxicity.posterior(h, np.array([9, 2, 0], np.uint64), np.array([4, 2, 1]), np.array([1.0, 3.0, 4.0]), np.array([1.0, 4.0, 10.0]), 0.1)
    two = (4 + 20 * 0.1) / 30
    nine = (3 + 20 * two) / 24
    assert np.allclose(share, [(1 + 20 * nine) / 21, nine, two])


def test_toxicity_counts_tokens_of_whole_texts(spark):
    rows = [(i, "vile vile vile day" if i % 2 else "fine day") for i in range(200)] + [(1000, "x " * 20000 + "vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    known = dict(zip(model.hashes.tolist(), model.odds.tolist()))
    vile, fine = (known[int(toxicity.features(pa.array([w]))[0][0, 0])] for w in ("vile", "fine"))
    assert vile > 0 > fine


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|STARTOFTEXT|>x<|endoftext|><|endoftext|>", "<|endoftext", "a<|endoftext|>"])
def test_added_tokens_are_read_as_the_tokenizer_reads_them(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.word_tokenizer())
    texts = ["before it", text, "behind it"]
    flat, cut = encoder(queries.word_tokenizer()).encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(cut, cut[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]

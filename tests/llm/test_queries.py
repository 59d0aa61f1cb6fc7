"""Operators on small tables against brute force, and their edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import audio, decontaminate, ngram, packing, queries, secrets, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD_DOCS = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "one", "en", None, 3), (3, "one", "en", None, 3), (None, "two words", "fr", "s", 9), (5, "tie " * 3000, "en", "s", 12000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_DOCS, SCHEMA).withColumn("fp", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("h", F.lit(3))


def test_simhash_components(spark, rows):
    got = {r["doc_id"]: r for r in queries.op2_simhash(spark, SF).collect()}
    fp = {i: simhash.fingerprint(t) for i, t in rows.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fp
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for i in ids:
        for j in ids:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in ids}


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 60)
    near = [int(np.int64(b) ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, rng.integers(1, 6)))) for b in base for _ in range(8)]
    fps = sorted({*map(int, base), *near})
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    u = np.array(fps).view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None]) <= 3, 1))
    assert got == {(fps[i], fps[j]) for i, j in zip(a, b)}


def test_classifiers_hold_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label in ((queries.op3_quality, "quality"), (queries.op5_toxicity, "toxic")):
        held = [r for r in query(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
        assert np.mean([r["predicted"] == truth[r["doc_id"]][label] for r in held]) > 0.9
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op1_language(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_decontamination_equals_sql(spark, tmp_path):
    docs = [(1, "a b c " + " ".join(f"w{i}" for i in range(20)) + " tail"), (2, None), (3, "Short Item here, again short item HERE"), (4, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 x"), (5, "é É-é"), (6, "")]
    items = [(1, " ".join(f"W{i}" for i in range(20))), (2, "short item here"), (3, ""), (4, None), (5, "É é"), (10, " ".join(f"w{i}" for i in range(3, 18)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for folder in (str(tmp_path), SF):
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}'")
        want = con.sql(queries.ORACLE_SQL["op6_decontamination"])
        cols = want.columns
        assert sorted(map(tuple, queries.op6_decontamination(spark, folder).select(*cols).collect())) == sorted(want.fetchall())


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a.com/x", "same"), (2, "http://b.com", "same"), (9, None, "same"), (4, "http://a.com/x", None), (5, "http://c.org/é", ""), (6, "http://www.a.com/y", "own é"), (None, "http://d.com", "same")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("x")).withColumn("first", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries.op7_warc(spark, str(tmp_path)).collect()), key=str)
    best = {}
    for p, _, h in pages:
        if p is not None:
            best[h or ""] = max(best.get(h or "", -1), p)
    want = []
    for p, _, h in pages:
        raw, top = (h or "").encode(), best[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == top else "revisit", None if p == top else top))
    assert got == sorted(want, key=str)
    index = warc.build_index(warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet")), block_lines=2)
    found = warc.lookup(index, spark.createDataFrame([(warc.surt("http://a.com/x"),), ("none)/",)], "key string")).collect()
    assert sorted(r["page_id"] for r in found) == [1, 4]


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.word_tokenizer())
    pieces = packing.pack(docs, queries.word_tokenizer(), with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and len(p["ids"]) == p["length"]
    for i, text in rows.items():
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert [x for p in own for x in p["ids"]] == [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert {p["doc_tokens"] for p in own} == {sum(p["length"] for p in own)}
    for s, own in by_seq.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 4096 or s == max(by_seq)


def test_language_model_base(spark, rows):
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), "\n"] for i, t in rows.items()}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    got = queries.op10_ngram(spark, SF).collect()
    for r in got:
        own = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in count for w in own), n)
        assert abs(r["base_score"] - sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_sums_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", "a b c", "b c a b", "a b a b c"] * 3)], "doc_id long, text string")
    model = ngram.train(docs)
    ask = [f"a b {w}" for w in ("a", "b", "c", "zzz")]
    got = {r["doc_id"]: r["score"] for r in ngram.score(spark.createDataFrame(list(enumerate(["a b", *ask])), "doc_id long, text string"), model).collect()}
    assert all(x < 0 for x in got.values()) and got[3] > got[4]  # c is likelier than an unknown word


def test_audio_alignment(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(0, 0.12, 64).tolist()
    other = rng.normal(0, 0.12, 64).tolist()
    near = v[:40] + other[40:]
    table = spark.createDataFrame([(100, v), (7, v), (8, near), (9, other), (10, None), (11, near[10:] + v[:10])], "vec_id long, embedding array<double>")
    prints = audio.fingerprints(audio.with_recordings(table, "vec_id", "embedding"), "vec_id", "media")
    got = {r["id"]: r for r in audio.align(prints, F.col("id") % 100 == 0, max_bit_error=0.35).collect()}
    assert got[100]["class_id"] == got[7]["class_id"] == 7 and got[10]["n_prints"] == 0
    assert [m["query_id"] for m in got[8]["matches"]] == [7] and got[8]["matches"][0]["offset"] == 0 and got[9]["matches"] == []


def test_odd_rows_do_not_break_operators(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "tie " * 20)], "item_id long, text string")
    n = len(ODD_DOCS)
    assert simhash.near_duplicates(odd).count() == n
    assert secrets.scan(odd).count() == n
    assert decontaminate.match(odd, bench).count() == n
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == n
    assert ngram.score(odd, ngram.train(odd)).count() == n
    assert packing.pack(odd, queries.word_tokenizer()).select("doc_id").count() >= n
    from skyloom.llm import language, quality

    assert quality.score(odd, quality.train(odd, labels)).count() == n
    found = language.identify(odd, language.train(odd)).collect()
    assert [r["lang_pred"] for r in found if r["doc_id"] in (1, 2)] == ["und", "und"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_pipeline_stages(spark, docs, rows):
    kept, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == names
        before, kept = kept, spark.createDataFrame(after.collect(), docs.schema)
        gone = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()}
        if name == "secrets":
            assert not gone and all(not secrets.base_spans(r["text"] or "") for r in kept.collect())
    packed = {r[0] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert packed == {r[0] for r in kept.select("doc_id").collect()}

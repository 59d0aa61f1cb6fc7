"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are maximal runs of letters and digits (any non-ASCII character counts as one) after A-Z is lower-cased. Each
text keeps the least k-gram hash of every sliding run of w k-grams, with k + w - 1 = 13, so two texts that share 13
consecutive words share a kept k-gram in that span. Kept k-grams of documents meet those of the items in one join; a
hit carries the word hashes around it on both sides and is extended word by word, so that only spans of whole windows
count. Items shorter than a window are matched by all word runs of their length, so they need no luck either.

Null and empty texts have no words, no hits and are not contaminated. Repeated rows each give a row. Null item ids
count for hits but are not listed. Items or documents without rows give empty findings. Words are compared by 64-bit
hashes. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.shared import materialize

WINDOW, GRAM = 13, 6
SLIDE = WINDOW - GRAM + 1
#: A kept k-gram's number: the upper bits are its hash, the lower its place, so the least is the leftmost of equals.
#: An array of a row holds fewer than 2**28 longs (2 GB), so the place always fits.
_PLACE_BITS = 28
#: Item fingerprints are broadcast up to this many rows (under 64 MB); beyond, the join is Spark's to choose.
BROADCAST_ROWS = 200_000
#: First words of short items are looked up in the plan up to this many; beyond, every run of their length is looked up.
FIRST_WORDS = 10_000


def words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _kept(df: DataFrame) -> DataFrame:
    """Adds n (words), hash (of each word) and kept (numbers of the k-grams that winnowing keeps)."""
    df = df.withColumn("hash", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    df = df.withColumn("n", F.size("hash"))
    gram = lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.slice("hash", i, GRAM)), _PLACE_BITS), _PLACE_BITS).bitwiseOR(i.cast("long"))
    df = df.withColumn("grams", F.when(F.col("n") >= GRAM, F.transform(F.sequence(F.lit(1), F.col("n") - GRAM + 1), gram)).otherwise(F.array().cast("array<bigint>")))
    m = F.size("grams")
    least = F.when(m >= SLIDE, F.transform(F.sequence(F.lit(1), m - SLIDE + 1), lambda i: F.array_min(F.slice("grams", i, SLIDE))))
    return df.withColumn("kept", F.array_distinct(F.coalesce(least, F.array(F.array_min("grams")))))


def _around(place: Column, kind: int, key: Column, before: int, after: int) -> Column:
    """A fingerprint with the word hashes around it: kind, key, at (its place), lead (words before it), around."""
    lead = F.least(place - 1, F.lit(before))
    return F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), place.alias("at"), lead.alias("lead"),
        F.slice("hash", place - lead, lead + after).alias("around"),
    )


def _fingerprints(lengths: dict[int, list[int]]) -> Column:
    """All fingerprints of a row with hash, n and kept; lengths: those of short items, matched by every run that begins
    as one of them."""
    place = lambda v: v.bitwiseAND((1 << _PLACE_BITS) - 1).cast("int")
    kept = F.transform(F.filter("kept", lambda v: v.isNotNull()), lambda v: _around(place(v), 0, F.shiftright(v, _PLACE_BITS), WINDOW - GRAM, WINDOW))
    parts = [kept]
    return F.concat(*parts, *(_runs(size, first) for size, first in sorted(lengths.items())))


def _runs(size: int, first: list[int]) -> Column:
    """Fingerprints of all word runs of one length that begin with one of the words; of all runs if no words are given."""
    places = F.sequence(F.lit(1), F.greatest(F.col("n") - size + 1, F.lit(1)))
    if first:
        places = F.filter(places, lambda i: F.try_element_at("hash", i).isin(first))
    made = F.transform(places, lambda i: _around(i, size, F.xxhash64(F.slice("hash", i, size), F.lit(size)), 0, size))
    return F.when(F.col("n") >= size, made).otherwise(F.slice(made, 1, 0))


def item_fingerprints(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, list[int]]]:
    """The kept k-grams of items of a window or more and the whole of shorter ones, once for each distinct context, by a
    number (print) of its own; the items of each (print, item); and the lengths of short items, twelve at most, with the
    words that these begin with (none where they are too many to be looked up in the plan)."""
    items = materialize(_kept(benchmark.select("item_id", "text")).filter("n > 0").select("item_id", "hash", "n", "kept"), "items")
    lengths: dict[int, list[int]] = {r["n"]: [] for r in items.filter(F.col("n") < WINDOW).select("n").distinct().collect()}
    begins = items.filter(F.col("n") < WINDOW).select("n", F.col("hash")[0].alias("first")).distinct()
    if begins.count() <= FIRST_WORDS:
        for r in begins.collect():
            lengths[r["n"]].append(r["first"])
    long = items.filter(F.col("n") >= WINDOW).select("item_id", F.explode(_fingerprints({})).alias("f"))
    one = F.lit(1)
    short = items.filter(F.col("n") < WINDOW).select(
        "item_id",
        F.struct(
            F.col("n").alias("kind"), F.xxhash64(F.slice("hash", one, F.col("n")), F.col("n")).alias("key"),
            one.alias("at"), F.lit(0).alias("lead"), F.col("hash").alias("around"),
        ).alias("f"),
    )
    both = long.unionByName(short).select("item_id", F.xxhash64("f.kind", "f.lead", "f.around").alias("print"), "f.kind", "f.key", F.col("f.lead").alias("i_lead"), F.col("f.around").alias("i_around"))
    both = materialize(both, "item-prints")
    prints = both.groupBy("print").agg(*(F.first(c).alias(c) for c in ("kind", "key", "i_lead", "i_around")))
    owners = both.filter("item_id IS NOT NULL").select("print", F.col("item_id").cast("string").alias("item")).distinct()
    return prints, owners, lengths


def _equal_run(steps: Column, same) -> Column:
    """How many of the steps 1, 2, ... hold without a break."""
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    grow = lambda s, j: F.when(s["on"] & same(j), F.struct(F.lit(True).alias("on"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), s["n"].alias("n")))
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, grow, lambda s: s["n"])).otherwise(F.lit(0))


def match(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_words, n_hit, n_items, items (sorted), items_sha256,
    contaminated."""
    prints, owners, lengths = item_fingerprints(benchmark)
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    rows = _kept(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")))
    rows = rows.select("doc_id", "text_hash", "n", "hash", "kept")
    # each row's own, of a kind that meets nothing; its key spreads it where the join shuffles
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.col("text_hash").alias("key"), F.lit(0).alias("at"), F.lit(0).alias("lead"), F.array().cast("array<bigint>").alias("around")))
    spread = rows.select("doc_id", "text_hash", "n", F.explode(F.concat(itself, _fingerprints(lengths))).alias("f")).select("doc_id", "text_hash", "n", "f.*")
    met = materialize(spread.join(prints, ["kind", "key"], "left").filter((F.col("kind") == -1) | F.col("i_around").isNotNull()), "met")

    left = _equal_run(F.least("lead", "i_lead"), lambda j: F.col("around")[F.col("lead") - j] == F.col("i_around")[F.col("i_lead") - j])
    right = _equal_run(
        F.least(F.size("around") - F.col("lead"), F.size("i_around") - F.col("i_lead")),
        lambda j: F.col("around")[F.col("lead") + j - 1] == F.col("i_around")[F.col("i_lead") + j - 1],
    )
    hits = (
        met.filter("kind >= 0").withColumn("left", left).withColumn("right", right)
        .filter(F.col("left") + F.col("right") >= F.when(F.col("kind") == 0, WINDOW).otherwise(F.col("kind")))
        .select("doc_id", "text_hash", F.struct((F.col("at") - F.col("left")).alias("a"), (F.col("at") + F.col("right")).alias("b")).alias("span"), "print")
    )
    key = ["doc_id", "text_hash"]
    spans = hits.select(*key, "span").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("span")).alias("spans"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n")), lambda s: s["n"])
    listed = hits.select(*key, "print").distinct().join(owners, "print").select(*key, "item").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = spans.select(*key, covered.alias("n_hit")).join(listed, _same(spans, listed, key), "left").select(spans["doc_id"], spans["text_hash"], "n_hit", "items")
    base = met.filter("kind = -1").groupBy(*key).agg(F.first("n").cast("bigint").alias("n_words"), F.count("*").alias("times"))
    out = base.join(found, _same(base, found, key), "left").select(
        base["doc_id"], base["text_hash"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy"),
    )
    return out.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """Equality of the keys in which null equals null."""
    return a[key[0]].eqNullSafe(b[key[0]]) & (a[key[1]] == b[key[1]])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a word of any benchmark window, all columns kept."""
    bad = match(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(p) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM d, ks, unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(p) WHERE len(w) >= k),
hit AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, k, p FROM hit), unnest(range(p, p + k)) AS t(q) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

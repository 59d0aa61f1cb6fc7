"""The thin queries of this subpackage: op1 to op10, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import audio, decontaminate, language, ngram, packing, quality, secrets, simhash, toxicity, warc
from skyloom.functions.shared import materialize
from skyloom.llm.training import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 5) == 0)
    model = language.train(docs.filter("NOT held_out"))
    return language.identify(docs, model, ("doc_id", "held_out")).drop("spans")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _scored(found: DataFrame, modulus: int, held: int) -> DataFrame:
    return found.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2))
    return _scored(quality.score(docs, model), 4, 2)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1))
    return _scored(toxicity.score(docs, model), 3, 1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.build_index(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.lookup(index, index.captures.select("key"))


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intended table is embeddings, each vector rendered as a recording; queries are the rows with vec_id % 100 = 0."""
    media = audio.with_recordings(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    prints = materialize(audio.fingerprints(media, "vec_id", "media"), "audio-prints")
    return audio.align(prints, F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) != 1).alias("learn"))
    model, numbered = ngram.train_numbered(docs)
    return ngram.score_numbered(numbered, model).select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_language": op1_language,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_chroma": op8_chroma,
    "op9_packing": op9_packing,
    "op10_ngram": op10_ngram,
}
ORACLE_SQL: dict[str, str] = {"op6_decontamination": decontaminate.ORACLE_SQL}

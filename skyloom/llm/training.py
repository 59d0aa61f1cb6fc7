"""Splits by a checksum of the id, and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as -1, in no split."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % modulus, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most about `limit` labelled rows, chosen by a hash of doc_id.

    `limit` is the documented bound of what a classifier is fitted on. The chosen labels are counted first, so what is
    broadcast is bounded; documents are scanned once and not shuffled. Null labels and ids are no examples.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
    n = rows.count()
    keep = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) < min(1.0, limit / max(n, 1)) * float(1 << 30)
    chosen = F.broadcast(rows.filter(keep).distinct())
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")

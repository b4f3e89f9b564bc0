"""Labelled documents, all of them or bounded, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """The remainder of crc32 of the id as text; null ids are in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds)), F.lit(-1))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with a row for each labelled id: of several labels the largest; rows without an id or a label don't count."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where: Column | None = None) -> DataFrame:
    """(text, label) of about ``limit`` labelled ids, those whose hash is below a share of all hashes.

    The share is ``limit`` by the number of labelled ids, so all ids are taken
    while there are fewer. Ids labelled more than once count with their largest
    label; rows without an id or a label don't count. The chosen ids are about
    ``limit`` rows of two numbers at most, so they are broadcast. Of documents
    that share an id one counts, with the least text, so the sample has no more
    rows than ids. ``where`` filters the labels.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, limit / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")

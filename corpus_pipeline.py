"""Five stages from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that
the stage before it kept. All but the last return the columns that ``docs``
has. ``run`` writes each stage's rows to the shared checkpoint folder and
reads them again, so a lost executor costs one stage at most; what a stage has
read is deleted once the next one's rows are there.

Defined results: a null text is scored as an empty one, and where it is kept
it stays null; of repeated rows, and of rows whose texts are near copies, the
one with the least ``doc_id`` stays, one without an id only where no other
has one; columns beyond those of documents pass through; an empty table of
documents gives no pieces, empty ``labels`` reject nothing and an empty
``benchmark`` hits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from payspark.llm import decontaminate, line_crf, near_copies, packing, pii
from payspark.llm.checkpoints import Scratch, saved  # noqa: F401 - tests save stages one by one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good."""
    return line_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of the documents' tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", sequences),
]

#: SQL expresses neither the classifier nor the labelers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.save(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)

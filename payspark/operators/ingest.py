"""Batches of documents into the store, every file with its outcome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from payspark.functions.validate import matches_net
from payspark.operators.dispatch import DEFAULT, Registry
from payspark.operators.parse import parse_documents
from payspark.schema import DUPLICATE_ID, MESSAGES, MISMATCH
from payspark.sources.checkpoints import settled
from payspark.sources.documents import TASK_FILES, UNNAMED, Extractor, extract_text, file_name, pdf_pages, read_folder, spread
from payspark.sources.commits import Version
from payspark.sources.store import DocumentStore, to_stored

LOADED, EXISTS, FAILED, MISMATCHED = "LOADED", "EXISTS", "ERROR", "DESCUADRE"


@dataclass
class Batch:
    """``outcome``: a row for each file with ``outcome`` and the parsed fields; ``summary``: one row of counts."""

    outcome: DataFrame
    summary: DataFrame

    @property
    def conflicts(self) -> DataFrame:
        """Files whose id exists; what is stored stays."""
        return self.outcome.where(F.col("outcome") == EXISTS)

    @property
    def rejected(self) -> DataFrame:
        return self.outcome.where(F.col("outcome") == FAILED)


#: Columns that a batch's rows have on the way.
NUMBER, READY, FIRST = "_number", "_ready", "_first"


def parsed_rows(documents: DataFrame, registry: Registry = DEFAULT, only: str | None = None, recheck: bool = False) -> tuple[DataFrame, int]:
    """``documents`` parsed once and kept, numbered, with whether each may be loaded; and how many there are.

    With ``recheck`` net pay is compared once more, as the companies' own
    scripts do.
    """
    agrees = matches_net(F.col("total_devengado"), F.col("total_deducir"), F.col("liquido_percibir")) if recheck else F.lit(True)
    ready = (F.col("status") == "OK") & agrees
    count = Observation()
    rows = parse_documents(documents, registry, only).withColumns({NUMBER: F.monotonically_increasing_id(), READY: ready})
    return settled(rows.observe(count, F.count("*").alias("n"))), count.get["n"]


def first_files(rows: DataFrame, order: str) -> DataFrame:
    """(id, number) of the first file of each id, by ``order`` and file name.

    The least file is an aggregate: a task sends one row of an id at most, so a
    month that a third of all files have is no hot key.
    """
    least = F.min(F.struct(*dict.fromkeys((order, "filename", NUMBER))))
    return settled(rows.where(READY).groupBy("id").agg(least[NUMBER].alias(FIRST)))


def decided(rows: DataFrame, first: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``outcome``: the first file of an id that is not ``known`` is loaded."""
    new = first.join(known, "id", "left_anti").select(FIRST)
    joined = rows.join(new, F.col(NUMBER) == F.col(FIRST), "left")
    failed, loaded = F.col("status") != "OK", F.col(FIRST).isNotNull()
    outcome = F.when(failed, FAILED).when(~F.col(READY), MISMATCHED).when(loaded, LOADED).otherwise(EXISTS)
    code = F.when(outcome == EXISTS, DUPLICATE_ID).when(outcome == MISMATCHED, MISMATCH).otherwise(F.col("error_code"))
    said = F.when(outcome == EXISTS, MESSAGES[DUPLICATE_ID]).when(outcome == MISMATCHED, MESSAGES[MISMATCH]).otherwise(F.col("error_message"))
    return joined.withColumns({"outcome": outcome, "error_code": code, "error_message": said}).drop(NUMBER, READY, FIRST, "status")


def outcomes(documents: DataFrame, ids: DataFrame, order: str, registry: Registry = DEFAULT, only: str | None = None, recheck: bool = False) -> DataFrame:
    """Parsed ``documents`` with ``outcome``.

    Of files with one id the first in ``order`` is loaded, unless ``ids`` has
    it. What ``recheck`` finds, see ``parsed_rows``, is out before that.
    """
    rows, _ = parsed_rows(documents, registry, only, recheck)
    return decided(rows, first_files(rows, order), ids.select("id"))


#: Counters of a batch and the outcomes that they count.
COUNTERS = {"loaded": LOADED, "failed": FAILED, "mismatched": MISMATCHED, "existing": EXISTS}


def counters() -> list:
    return [F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(n) for n, o in COUNTERS.items())]


def summary_of(outcome: DataFrame) -> DataFrame:
    """One row: files, and how many of them were loaded, failed, mismatched or existed."""
    return outcome.agg(*counters())


def parse_file(spark: SparkSession, source: str | bytes, filename: str | None = None, extractor: Extractor = pdf_pages, registry: Registry = DEFAULT) -> DataFrame:
    """One document, given by its path or its bytes, as one parsed row; ``extract_error`` says why it has no text."""
    if isinstance(source, str):
        files = spark.read.format("binaryFile").load(source).select((F.lit(filename) if filename else file_name("path")).alias("filename"), "content")
    else:
        files = spark.createDataFrame([(filename or UNNAMED, source)], "filename string, content binary")
    return parse_documents(extract_text(files, extractor), registry)


def ingest_folder(spark: SparkSession, folder: str, store: DocumentStore, key: str | None = None, extractor: Extractor = pdf_pages) -> Batch | None:
    """All PDF files of a folder, in the order of their paths; with ``key`` as its company's script would.

    Without any file nothing is done, not even a table created, and the result is None.
    """
    files = read_folder(spark, folder)
    if files.isEmpty():
        print(f"no PDF files in {folder}")
        return None
    texts = extract_text(spread(files, TASK_FILES), extractor)
    return ingest_company(texts, store, key, "path") if key else ingest_batch(texts, store, "path")


def ingest_batch(documents: DataFrame, store: DocumentStore, order: str = "filename", registry: Registry = DEFAULT, only: str | None = None, recheck: bool = False) -> Batch:
    """Parse ``documents`` (filename, text) and insert what is new.

    No file ends the batch. Documents are parsed once, as a table. The insert
    counts the outcomes as it writes; where tasks ran twice, so that more rows
    were counted than there are, they are counted anew. If another writer
    commits first, outcomes are decided again by what it has inserted.
    """
    store.init()
    rows, total = parsed_rows(documents, registry, only, recheck)
    first = first_files(rows, order)
    last: dict = {}

    def made(before: Version | None) -> DataFrame:
        seen = Observation()
        outcome = decided(rows, first, store.known(first.select("id"), before))
        if store.in_memory:
            outcome = settled(outcome)  # such a table has no versions
        last.update(seen=seen, outcome=outcome)
        return to_stored(outcome.observe(seen, *counters()).where(F.col("outcome") == LOADED))

    store.insert(made)
    counts = last["seen"].get
    if counts["total"] != total:
        counts = summary_of(last["outcome"]).first().asDict()
    return Batch(last["outcome"], summary_row(documents.sparkSession, counts))


def summary_row(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    names = ("total", *COUNTERS)
    return spark.createDataFrame([Row(*(counts[n] for n in names))], ", ".join(f"{n} long" for n in names))


def ingest_company(documents: DataFrame, store: DocumentStore, key: str, order: str = "filename") -> Batch:
    """The companies' scripts: one format for all files, with the second check; an existing id counts as failed there."""
    batch = ingest_batch(documents, store, order, only=key, recheck=True)
    outcome = batch.outcome.withColumn("outcome", F.when(F.col("outcome") == EXISTS, FAILED).otherwise(F.col("outcome")))
    counts = batch.summary.first().asDict()
    counts |= {"failed": counts["failed"] + counts["existing"], "existing": 0}
    return Batch(outcome, summary_row(documents.sparkSession, counts))


def report(outcome: DataFrame) -> DataFrame:
    """A line of text for each file."""
    loaded = F.concat(F.lit("[OK] "), "filename", F.lit(" -> "), "periodo", F.lit(" "), F.format_number("liquido_percibir", 2))
    other = F.concat(F.lit("["), "outcome", F.lit("] "), "filename", F.lit(": "), "error_message")
    return outcome.select("filename", F.when(F.col("outcome") == LOADED, loaded).otherwise(other).alias("line"))

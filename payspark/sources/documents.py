"""Documents from folders of files or from memory.

PDF text needs a library that turns bytes into the texts of pages; any can be
given as ``extractor``. The default uses pdfplumber where it is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a document to the texts of its pages, in order; a page without text is None or empty.
Extractor = Callable[[bytes], Iterable[str | None]]

UNNAMED = "document.pdf"
UPLOADS = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("filename", T.StringType()), T.StructField("content", T.BinaryType())])


def pdf_pages(content: bytes) -> list[str | None]:
    """Pages of a PDF; raises ImportError where pdfplumber is missing."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [page.extract_text() for page in pdf.pages]


#: Texts that one task parses, so many that the code of all stages, which each task writes anew, is little beside them.
TASK_ROWS = 500_000
#: Files that one task reads and turns into texts, which costs far more.
TASK_FILES = 100_000


def spread(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` dealt out evenly, to one task for each core and to as many rounds of them as there are rows for.

    Parsing a text costs far more than moving it. A file's partitions go by its
    bytes, and those of a file of few row groups are empty but for some, so
    their number says nothing; rows are counted, which reads no column.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, -(-rows.count() // (task_rows * cores))))


def file_name(path: str | Column) -> Column:
    """The last part of a path; a fixed name where there is none."""
    own = F.col(path) if isinstance(path, str) else path
    return F.coalesce(F.nullif(F.element_at(F.split(own, "/"), -1), F.lit("")), F.lit(UNNAMED))


def read_folder(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, filename, content) of the folder's own files that match; order by path where order counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    return files.select("path", file_name("path").alias("filename"), "content")


def uploads(spark: SparkSession, files: Iterable[tuple[str | None, bytes]]) -> DataFrame:
    """(idx, filename, content) of files in memory; names that don't end in .pdf are left out."""
    kept = [(k, name or UNNAMED, content) for k, (name, content) in enumerate(files) if (name or UNNAMED).lower().endswith(".pdf")]
    return spark.createDataFrame(kept, UPLOADS)


def extract_text(files: DataFrame, extractor: Extractor = pdf_pages) -> DataFrame:
    """``files`` with ``text`` (pages joined by line ends) instead of ``content``, and ``extract_error``.

    A file that the extractor rejects has no text and its error's words; the
    others go on. Arrow batches carry the files to Python, the only step that
    isn't a column expression.
    """
    given = [f for f in files.schema.fields if f.name != "content"]
    schema = T.StructType([*given, T.StructField("text", T.StringType()), T.StructField("extract_error", T.StringType())])

    def pages(content: bytes) -> tuple[str | None, str | None]:
        try:
            return "\n".join(page or "" for page in extractor(content)), None
        except Exception as error:  # noqa: BLE001 - one bad file must not end the batch
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [pages(bytes(c)) for c in batch["content"]]
            yield batch.drop(columns="content").assign(text=[t for t, _ in found], extract_error=[e for _, e in found])

    return files.mapInPandas(run, schema)

"""Folders of payslip files as a data source: ``spark.read.format("payslip_files")``.

Files are dealt to partitions by their sizes, the largest first, each to the
partition with the fewest bytes so far, so one huge file shares its task with
few others and thousands of small ones don't fill one task by number. Each file
is one row with its text or with the error that its extractor raised.

The folder may be in any store that ``pyarrow.fs`` opens by its URI. For those
that Spark alone can read ``documents.read_folder`` does the same without the
dealing.
"""

from __future__ import annotations

import fnmatch
import heapq
import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from payspark.sources.documents import Extractor, pdf_pages

FILES = "path string, filename string, length long, text string, extract_error string"
#: Bytes of a partition, and what opening a file costs in bytes.
TARGET, OPENING = 64 << 20, 1 << 16
#: Rows and bytes of text of one batch.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


@dataclass
class Files(InputPartition):
    """Paths and sizes of one task's files."""

    files: list[tuple[str, int]]


def balanced(files: list[tuple[str, int]], partitions: int) -> list[list[tuple[str, int]]]:
    """``files`` (path, size) dealt to at most so many partitions of about equal cost; the order of paths within one."""
    bins: list[list[tuple[str, int]]] = [[] for _ in range(min(partitions, len(files)))]
    least = [(0, k) for k in range(len(bins))]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        cost, k = heapq.heappop(least)
        bins[k].append((path, size))
        heapq.heappush(least, (cost + size + OPENING, k))
    return [sorted(b) for b in bins]


def opened(folder: str):
    """A folder's file system and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def listed(folder: str, glob: str) -> list[tuple[str, int]]:
    """The folder's own files that match, with their sizes."""
    from pyarrow import fs

    store, place = opened(folder)
    found = store.get_file_info(fs.FileSelector(place, recursive=False))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob))


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], extractor: Extractor | None):
        self.folder, self.glob = options["path"], options.get("glob", "*.pdf")
        self.count, self.target = int(options.get("partitions", 0)), int(options.get("target", TARGET))
        self.named, self.extractor = options.get("extractor"), extractor

    def partitions(self) -> list[InputPartition]:
        files = listed(self.folder, self.glob)
        cost = sum(size + OPENING for _, size in files)
        return [Files(own) for own in balanced(files, self.count or max(1, -(-cost // self.target)))] or [Files([])]

    def _extract(self) -> Extractor:
        if self.extractor is not None:
            return self.extractor
        if not self.named:
            return pdf_pages
        module, _, name = self.named.partition(":")
        return getattr(importlib.import_module(module), name)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("filename", pa.string()), ("length", pa.int64()), ("text", pa.string()), ("extract_error", pa.string())])
        extract, (store, _) = self._extract(), opened(self.folder)
        rows, held = [], 0
        for path, size in partition.files:
            text = error = None
            try:
                with store.open_input_stream(path) as file:
                    text = "\n".join(page or "" for page in extract(file.read()))
            except Exception as failed:  # noqa: BLE001 - one bad file must not end the batch
                error = f"{type(failed).__name__}: {failed}"
            rows.append((path, path.rsplit("/", 1)[-1], size, text, error))
            held += len(text or "")
            if len(rows) >= BATCH_ROWS or held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class PayslipFiles(DataSource):
    """Options: ``path`` (the folder), ``glob``, ``partitions`` or ``target`` (bytes of one), ``extractor`` (``module:function``)."""

    extractor: Extractor | None = None

    @classmethod
    def name(cls) -> str:
        return "payslip_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilesReader(dict(self.options), type(self).extractor)


def read_files(spark: SparkSession, folder: str, extractor: Extractor | None = None, glob: str = "*.pdf", partitions: int | None = None) -> DataFrame:
    """Texts of a folder's files, see ``FILES``; ``extractor`` turns a file's bytes into its pages' texts."""
    held = {} if extractor is None else {"extractor": staticmethod(extractor)}
    spark.dataSource.register(type("PayslipFiles", (PayslipFiles,), held))
    reader = spark.read.format(PayslipFiles.name()).option("glob", glob)
    return (reader.option("partitions", partitions) if partitions else reader).load(folder)

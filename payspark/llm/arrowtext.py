"""Vectorised text helpers for Arrow batches: byte maps, words, row annotation.

All helpers work on whole texts. A batch is cut into slices of a few MB so
that the memory of a task follows the slice (or the longest single text), not
the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: The same, and every byte outside 0-9, a-z and non-ASCII becomes a space.
LOWER_ALNUM = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER
)


def as_strings(column: pa.Array) -> pa.StringArray:
    """The column as a null-free Arrow string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def offsets_of(texts: pa.StringArray) -> np.ndarray:
    """Byte offsets of the texts, the first one 0 for ``data_of``."""
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return raw.astype(np.int64) - int(raw[0]) if len(raw) else np.zeros(1, np.int64)


def data_of(texts: pa.StringArray) -> np.ndarray:
    """The UTF-8 bytes of all texts, one after the other."""
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[int(raw[0]) : int(raw[-1])]


def strings_from(data: bytes, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(data)
    )


def mapped(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """Each byte replaced by ``table``; only ASCII bytes may change."""
    return strings_from(data_of(texts).tobytes().translate(table), offsets_of(texts))


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Runs of other characters than ASCII white space: all words, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if full.all():
        return flat, np.diff(bounds)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), np.diff(before[bounds])


def owners(counts: np.ndarray) -> np.ndarray:
    """0 for each item of the first row, 1 for those of the second, and so on."""
    return np.repeat(np.arange(len(counts)), counts)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by sorting, which beats hashing here."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; rows have ``counts`` values, also none."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each slice has at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    length = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)
    ends = np.cumsum(length.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended until no column is called so."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def annotate(
    docs: DataFrame,
    function: Callable[[pa.StringArray], dict[str, pa.Array | np.ndarray]],
    fields: T.StructType,
    text_column: str = "text",
) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and one struct column with what ``function`` says of each text.

    Returns the frame and the name of that column, which no input column has.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    name = free_name("result", docs.columns)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                found = function(as_strings(part.column(part.schema.get_field_index(text_column))))
                values = [pa.array(found[n], type=k) if not isinstance(found[n], pa.Array) else found[n].cast(k) for n, k in kinds]
                struct = pa.StructArray.from_arrays(values, fields=[pa.field(n, k) for n, k in kinds])
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, fields)])
    return docs.mapInArrow(run, schema), name

"""Fill-in-the-middle transformation by an Aho-Corasick scan for events.

A text's tokens are its runs of ASCII letters and its other code points, one
each. Of each code point only the class matters, and which character it is
where it can belong to a sentinel; so a text is reduced to one ASCII symbol a
code point. One automaton scans the symbols for changes of class (a pair of
symbols, one a letter and one not) and for the sentinels. Between changes a
run of letters is one token and a run of others as many tokens as code points,
so the token count up to each event, and the code point of any token, follow
from the events by arithmetic: a cut after k tokens is looked up among the
events' counts.

Where a document is cut, and its form, follow from a hash of its id, so the
result doesn't depend on partitions or on retries.

Defined results: a null text is empty, and empty texts, or those with a
sentinel inside, are plain; a null ``doc_id`` is hashed as the empty word;
repeated rows and rows with one id are cut alike, each for itself; other
columns are ignored; an empty table gives no rows. A very long text is held in
one task with sixteen bytes for each change of class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from payspark.llm.arrowtext import as_strings, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of documents that are cut, and of these that have the suffix first.
CUT_RATE, SPM_RATE = 90, 20
#: Text handled at once.
SLICE = 4 << 20

#: Symbols of code points: letters, other ones, and those of sentinels as they are.
LETTERS, OTHERS = "aPSM", ".<>"
SYMBOLS = bytes(
    b if chr(b) in "PSM<>" else ord("a") if b < 0x80 and chr(b).isalpha() else ord(".") for b in range(256)
)
#: Bytes that continue a code point.
CONTINUED = bytes(range(0x80, 0xC0))
SENTINEL = 0


class Form(NamedTuple):
    """A transformed text: tokens, form, code points of prefix and middle (None if plain), output."""

    units: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


@lru_cache(maxsize=1)
def automaton():
    """Changes of class, told by 1 for the first letter of a run and 2 for what follows one, and sentinels."""
    import ahocorasick

    own = ahocorasick.Automaton()
    for letter, other in product(LETTERS, OTHERS):
        own.add_word(other + letter, 1)
        own.add_word(letter + other, 2)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        own.add_word(sentinel, SENTINEL)
    own.make_automaton()
    return own


class Scan:
    """Where a text's runs begin, in code points and in tokens, and whether it has a sentinel."""

    def __init__(self, text: str):
        symbols = text.encode().translate(SYMBOLS, CONTINUED).decode("ascii")
        found = np.fromiter((at << 2 | kind for at, kind in automaton().iter(symbols)), np.int64)
        events = found[(found & 3) != SENTINEL] >> 2
        self.has_sentinel = len(events) < len(found)
        self.starts = np.concatenate([[0], events, [len(symbols)]]) if symbols else np.zeros(1, np.int64)
        sizes = np.diff(self.starts)
        sizes[0 if symbols[:1] in (*LETTERS,) else 1 :: 2] = 1  # runs alternate, and one of letters is one token
        self.counts = np.concatenate([[0], np.cumsum(sizes)])
        self.units = int(self.counts[-1])

    def place(self, unit: int) -> int:
        """The code points of the first ``unit`` tokens."""
        run = int(np.searchsorted(self.counts, unit, side="right")) - 1
        return int(self.starts[run] + unit - self.counts[run])


def drawn(doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 from an id."""
    found = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(doc_id: int | None, text: str) -> Form:
    """One text, cut where its id says."""
    scan = Scan(text)
    first, second, cut, order = drawn(doc_id)
    if not text or scan.has_sentinel or cut % 100 >= CUT_RATE:
        return Form(scan.units, PLAIN, None, None, text)
    ends = sorted(scan.place(h % (scan.units + 1)) for h in (first, second))
    prefix, middle, suffix = text[: ends[0]], text[ends[0] : ends[1]], text[ends[1] :]
    parts = (SUFFIX, suffix, PREFIX, prefix) if order % 100 < SPM_RATE else (PREFIX, prefix, SUFFIX, suffix)
    return Form(scan.units, SPM if parts[0] == SUFFIX else PSM, len(prefix), len(middle), "".join((*parts, MIDDLE, middle)))


def restore(output: str, form: str) -> str:
    """The text that ``transform`` was given, from what it returned; no part holds a sentinel, so each is found where it was put."""
    if form == PLAIN:
        return output
    heads = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    first, _, rest = output.removeprefix(heads[0]).partition(heads[1])
    second, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (second, first) if form == SPM else (first, second)
    return prefix + middle + suffix


FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def fill_in_middle(docs: DataFrame, with_output: bool = True) -> DataFrame:
    """Documents (doc_id, text) transformed: a row for each, see ``FORMS``, with the ``output`` itself if ``with_output``.

    ``restored_sha256`` is of the text rebuilt from output and form.
    """
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    schema = pa.schema([*kinds, ("output", pa.string())] if with_output else kinds)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids = part.column("doc_id").cast(pa.int64())
                texts = as_strings(part.column("text"))
                found = [transform(i, t) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
                units, forms, prefixes, middles, outputs = zip(*found)
                columns = [ids, units, forms, prefixes, middles, map(sha, outputs), map(sha, map(restore, outputs, forms)), outputs]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, FORMS + (", output string" if with_output else ""))


def middle_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13: all documents in one of three forms."""
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_output=False)

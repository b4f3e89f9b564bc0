"""Best-fit packing by exact-complement hashing.

A document's token ids, with an end id after them, are one piece; only longer
ones than a sequence are cut, into full pieces after a shorter first one.
Which pieces share a sequence depends on their lengths alone, so it is planned
on the histogram of lengths, which has at most as many rows as a sequence has
tokens, whatever the corpus. The plan is a list of patterns, each a few
lengths with how often they come in one sequence, and how many sequences are
made so:

* for each length from the longest on, the gap that it leaves is looked up in
  an index of the sums of single lengths, pairs and triples; as many sequences
  as the available counts allow are filled exactly;
* what remains is placed by best fit: the longest remaining length, then the
  longest that fits, and so on, with the same lookup at every gap. This is
  done after all exact fillings; where that takes more sequences than the
  tokens need, also length by length, so that long pieces get their partners
  before short ones meet each other, and the plan with fewer sequences counts.

A pattern is used until one of its lengths has fewer pieces left than it
takes, and each time at most half of them remain, so the number of patterns is
bounded by capacity times the logarithm of a count.

Pieces of one length are numbered through all tasks (their number within the
task that made them, plus a running sum over tasks), and the number tells
sequence and offset by the plan. The plan is broadcast, the numbers never
gathered.

Defined results: a null or empty text is a piece with the end id alone;
repeated rows are packed once each; pieces of one length are taken in the
order of the tasks that read them; a null ``doc_id`` stays null; other columns
are ignored; an empty table gives no rows. A very long text is held in one
task with its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payspark.llm.arrowtext import as_strings, slices
from payspark.llm.checkpoints import Scratch, saved
from payspark.llm.segments import TextCoder

LENGTH = 2048
END_ID = 0
#: Text handled at once.
SLICE = 8 << 20
#: Bits of a piece's number among those of its length.
RANK_BITS = 44

#: Lengths with how often each comes in a sequence, and how many sequences are so.
Pattern = tuple[int, dict[int, int]]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Sums:
    """Which available lengths add up to a gap: one, two or three of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # by length; shared, and only ever lowered
        self.build()

    def build(self) -> None:
        """Of each sum the longest part of a pair; 0 where there is none."""
        some = np.flatnonzero(self.counts)
        self.pair = np.zeros(len(self.counts), np.int64)
        for short in some[some <= (len(self.counts) - 1) // 2][::-1].tolist():
            long = some[(some >= short) & (some < len(self.counts) - short)]
            if self.counts[short] < 2:
                long = long[long != short]
            self.pair[long + short] = long
        self.gone = False

    def two(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        first = int(self.pair[gap])
        if first and left[first] and left[gap - first] > (first * 2 == gap):
            return first, gap - first
        long = np.arange((gap + 1) // 2, gap)
        fits = (left[long] > 0) & (left[gap - long] > (long * 2 == gap))
        found = np.flatnonzero(fits)
        return (int(long[found[-1]]), gap - int(long[found[-1]])) if len(found) else ()

    def three(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        while True:
            first = np.flatnonzero(left[:gap])[::-1]
            rest = gap - first
            second = self.pair[rest]
            third = rest - second
            fits = (second > 0) & (left[first] >= 1 + (first == second) + (first == third))
            fits &= (left[second] >= 1 + (second == first) + (second == third)) & (left[third] >= 1 + (third == first) + (third == second))
            found = np.flatnonzero(fits)
            if len(found):
                return tuple(int(x[found[0]]) for x in (first, second, third))
            if not self.gone:
                return ()
            self.build()  # pairs with a part that is used up may hide others

    def filling(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        """Up to three lengths that fill the gap exactly."""
        if gap < len(left) and left[gap]:
            return (gap,)
        return self.two(gap, left) or self.three(gap, left)


def planned(counts: np.ndarray) -> list[Pattern]:
    """Patterns for so many pieces of each length; the last index is a full sequence."""
    size = lambda plan: sum(times for times, _ in plan)
    full = len(counts) - 1
    plan = ordered(counts, exact_first=True)
    return plan if size(plan) == -(-int(counts @ np.arange(full + 1)) // full) else min(plan, ordered(counts, exact_first=False), key=size)


def ordered(counts: np.ndarray, exact_first: bool) -> list[Pattern]:
    """A plan with all exact fillings before best fit, or with both length by length."""
    counts = counts.copy()
    full, sums, out = len(counts) - 1, Sums(counts), []

    def take(lengths: list[int]) -> None:
        own = {n: lengths.count(n) for n in lengths}
        times = min(int(counts[n]) // m for n, m in own.items())
        for n, m in own.items():
            counts[n] -= times * m
            sums.gone |= not counts[n]
        out.append((times, own))

    def begun(length: int) -> np.ndarray:
        left = counts.copy()
        left[length] -= 1
        return left

    def exact(length: int) -> None:
        while counts[length]:
            rest = sums.filling(full - length, begun(length)) if length < full else ()
            if length < full and not rest:
                break
            take([length, *rest])

    def best_fit(length: int) -> None:
        while counts[length]:
            lengths, gap, left = [length], full - length, begun(length)
            while gap:
                rest = sums.filling(gap, left)
                if not rest:
                    fitting = np.flatnonzero(left[: gap + 1])
                    if not len(fitting):
                        break
                    rest = (int(fitting[-1]),)
                for n in rest:
                    lengths.append(n)
                    left[n] -= 1
                    gap -= n
            take(lengths)

    for length in range(full, 0, -1):
        exact(length)
        if not exact_first:
            best_fit(length)
    for length in range(full, 0, -1):
        best_fit(length)
    return out


class Plan:
    """Where each piece goes, by its length and its number among pieces of that length."""

    def __init__(self, patterns: list[Pattern], full: int):
        used, base, rows = np.zeros(full + 1, np.int64), 0, []
        for times, own in patterns:
            offset = 0
            for length, many in own.items():
                rows.append((length << RANK_BITS | int(used[length]), base, offset, many))
                used[length] += times * many
                offset += length * many
            base += times
        rows.sort()
        self.key, self.base, self.offset, self.many = np.array(rows, np.int64).reshape(-1, 4).T.copy()
        self.sequences = base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        key = length << RANK_BITS | rank
        at = np.searchsorted(self.key, key, side="right") - 1
        turn = key - self.key[at]
        return self.base[at] + turn // self.many[at], self.offset[at] + turn % self.many[at] * length


def cut(lengths: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of so many tokens: each piece's row, number in it, start and length, in order."""
    many = -(-lengths // full)
    row = np.repeat(np.arange(len(lengths)), many)
    piece = np.arange(len(row)) - (np.cumsum(many) - many)[row]
    head = lengths - (many - 1) * full
    size = np.where(piece == 0, head[row], full)
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * full)
    return row, piece, start, size


MADE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), see ``MADE``: ``nth`` numbers those of one length that a task makes. ``with_ids`` adds their ids."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema([*kinds, ("ids", pa.list_(pa.int32()))] if with_ids else kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, made = TextCoder(tokenizer or default_tokenizer()), np.zeros(length + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, counts = coder.encode(as_strings(part.column("text")))
                stream = np.full(len(ids) + len(counts), end_id, "<u4")
                stream[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                row, piece, start, size = cut(counts + 1, length)
                ends = np.cumsum(size)
                raw = memoryview(stream.tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist())), np.int64, len(row))
                order = np.argsort(size, kind="stable")
                first = np.searchsorted(size[order], size[order])
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - first
                nth += made[size]
                made += np.bincount(size, minlength=length + 1)
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, size, crc)), pa.array(np.full(len(row), task, np.int32)), pa.array(nth)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(stream.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, MADE + (", ids array<int>" if with_ids else ""))


def placed(made: DataFrame, length: int = LENGTH) -> DataFrame:
    """``made`` (a saved table of ``pieces``) with ``sequence_id`` and ``offset`` in place of ``task`` and ``nth``."""
    scratch = Scratch(made.sparkSession)
    tallies = scratch.save(made.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(length + 1, np.int64)
    for row in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most as many rows as a sequence has tokens
        counts[row["length"]] = row["n"]
    plan = made.sparkSession.sparkContext.broadcast(Plan(planned(counts), length))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = saved(tallies.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    scratch.drop()
    kept = [f for f in made.schema.fields if f.name not in ("task", "nth")]
    ranked = made.join(before, ["length", "task"]).select(*(f.name for f in kept), (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, own.place(length, rank))], names=[*(f.name for f in kept), "sequence_id", "offset"])

    from pyspark.sql import types as T

    return ranked.mapInArrow(run, T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Documents (doc_id, text) in as few sequences of at most ``length`` tokens as the method finds: a row for each piece."""
    return placed(saved(pieces(docs, tokenizer, length, end_id, with_ids)), length)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: all documents in sequences of at most 2048 tokens."""
    return pack_best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)

"""Exact substring dedup with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts elsewhere. Of
the suffixes of all texts only those at anchors are indexed: each window has
as anchor the first of its ``HEAD``-byte strings that are least by hash, so
equal windows have equal anchors at equal places, and one suffix in about 120
is enough. (Anchors of longer windows are among those of shorter ones, so the
anchors of ``PASSAGE``-byte windows serve both lengths.)

An array lists the anchored suffixes of a batch of documents, sorted by their
first PREFIX bytes and then by a hash of the first HEAD bytes, with how often
each occurs. The arrays are tables in a folder, so a family outlives its
session and batches can be added later. A new batch's array is merge-scanned
(a sort-merge join) against every array of the family; what it shares, within
itself or with an array, is a possible long match. Then arrays of equal size
merge, so each suffix is rewritten a logarithmic number of times.

Possible matches are verified on the texts. The windows of an anchor, in
chunks, have a core, which all of them contain, and a full extent. A chunk
whose full extent occurs twice is covered; one whose core is unique is not;
the others, at the edges of matches, are cut into smaller chunks, at last into
single windows (``CHUNKS``). Extents are told apart by 128-bit hashes.

Skew. Of texts that occur more than once one row is indexed and verified; the
others are known to repeat as a whole. Groups with over 1/``HEAVY`` of all
rows, at most HEAVY of them, are marked by a broadcast join, so no task gets
a group. In a run of a short period (``PERIOD``) each window equals the one a
period before it: such a run repeats as a whole, and only its first windows
are indexed. Anchors are found a piece of a text at a time.

Defined results: a null or empty text has no bytes; repeated rows are copies
of each other, so they are removed whole from LENGTH bytes on; texts under
LENGTH bytes stay; a null ``doc_id`` stays null; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payspark.llm.arrowtext import as_strings, data_of, offsets_of, slices
from payspark.llm.checkpoints import Scratch, files_of, saved, write_table

LENGTH, HEAD, PREFIX = 400, 64, 16
#: Shorter repeats are reported, not removed: passages of some fifty words.
PASSAGE = 300
#: Windows are compared in chunks of these sizes, the last by themselves.
CHUNKS = (64, 8, 1)
#: Runs of at most this period are handled as a whole.
PERIOD = 64
#: Batches that enter the family one after the other.
BATCHES = 4
#: A group of copies with over one in so many of all rows is broadcast.
HEAVY = 1000
#: Windows of a text whose anchors are found at once.
PIECE = 1 << 20

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats long"
#: Written in place of a head by texts with periodic runs.
CYCLIC = -1


def head_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the HEAD bytes from each position on, by doubling."""
    h, reach, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while reach < HEAD:
        h = h[:-reach] * np.uint64(factor) + h[reach:]
        h ^= h >> np.uint64(29)
        factor = (factor * 0xBF58476D1CE4E5B9 + 2) % (1 << 64)
        reach *= 2
    return h


def first_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` numbers the place of the first least one, by minima from both ends of blocks."""
    windows = len(h) - width + 1
    block = np.concatenate([h, np.full(-len(h) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    place = np.arange(block.size).reshape(block.shape)
    least = np.minimum.accumulate(block, axis=1)
    fresh = np.concatenate([np.ones((len(block), 1), bool), least[:, 1:] != least[:, :-1]], axis=1)
    left = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).ravel()
    turned = block[:, ::-1]
    lowest = np.minimum.accumulate(turned, axis=1)
    step = np.maximum.accumulate(np.where(turned == lowest, np.arange(width), 0), axis=1)
    right = (place[:, :1] + width - 1 - step)[:, ::-1].ravel()
    tail, front = lowest[:, ::-1].ravel()[:windows], least.ravel()[width - 1 : width - 1 + windows]
    return np.where(tail <= front, right[:windows], left[width - 1 : width - 1 + windows])


def all_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text's windows, the first and last window that has each, and their heads' hashes."""
    windows = len(data) - length + 1
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(windows, 0), PIECE):
        h = head_hashes(data[begin : begin + PIECE - 1 + length])
        at = first_least(h, length - HEAD + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        known = found[-1][0][-1] if found else -1
        own = (at[first] + begin, first + begin, h[at[first]])
        found.append(tuple(x[1:] for x in own) if own[0][0] == known else own)
        if not len(found[-1][0]):
            found.pop()
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at, first, heads = (np.concatenate(x) for x in zip(*found))
    return at, first, np.append(first[1:], windows) - 1, heads


def cycles(data: np.ndarray, length: int, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of windows in runs of these periods: all that repeat there, and of these the ones after the first period."""
    whole, later = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for q in periods.tolist():
        same = np.concatenate([[False], data[q:] == data[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= length
        ends = stop[long] - length + q
        whole.append(np.stack([start[long], ends], axis=1))
        later.append(np.stack([start[long] + q, ends], axis=1))
    return np.concatenate(whole), np.concatenate(later)


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text's windows, and the first and last window that has each, without windows that equal one a
    period before them; last the ranges of windows that repeat in periodic runs."""
    at, first, last, heads = all_anchors(data, length)
    gap = np.diff(at)
    periods = np.unique(gap[(gap <= PERIOD) & (heads[1:] == heads[:-1])]) if len(at) else gap
    if not len(periods):
        return at, first, last, np.zeros((0, 2), np.int64)
    whole, later = cycles(data, length, periods)
    kept = np.ones(len(data) - length + 1, bool)
    for a, z in later.tolist():
        kept[a : z + 1] = False
    fresh = np.zeros(len(kept), bool)
    fresh[first] = True
    fresh[1:] |= kept[1:] != kept[:-1]
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], len(kept)) - 1
    start, stop = start[kept[start]], stop[kept[start]]
    return at[np.searchsorted(first, start, side="right") - 1], start, stop, whole


def texts_in(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batch, and the bytes of each text."""
    for part in slices(batch):
        texts = as_strings(part.column("text"))
        data, bounds = data_of(texts), offsets_of(texts)
        yield part, [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def places(data: np.ndarray) -> np.ndarray:
    """Where a text's suffixes are indexed; CYCLIC last if it has periodic runs."""
    at, _, _, cyclic = anchors(data, PASSAGE)
    if not len(cyclic):
        return np.unique(at)
    return np.append(np.union1d(at, anchors(data, LENGTH)[0]), CYCLIC)


def anchored(docs: DataFrame) -> DataFrame:
    """(head, row, at): the anchored suffixes of ``docs`` (row, text); a text with periodic runs has a null head at CYCLIC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_digest
        for batch in batches:
            for part, texts in texts_in(batch):
                found = [places(t) for t in texts]
                row = pa.array(np.repeat(np.arange(len(texts)), [len(f) for f in found]))
                heads = [(raw := t[a : a + HEAD].tobytes())[:PREFIX] + digest(raw) if a >= 0 else None for t, f in zip(texts, found) for a in f.tolist()]
                at = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), part.column("row").take(row), at], names=["head", "row", "at"])

    return docs.select("row", "text").mapInArrow(run, "head binary, row long, at long")


def suffix_array(suffixes: DataFrame) -> DataFrame:
    """(head, n): a batch's suffixes, sorted by their heads in each partition."""
    return suffixes.groupBy("head").agg(F.count("*").alias("n")).sortWithinPartitions("head")


class IndexFamily:
    """Suffix arrays of 1, 2, 4, ... batches in a folder, at most one of each size.

    An array's name says which batches it covers, and Spark's marker that it
    is complete, so a merge that was cut off is made again by the next batch.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def arrays(self) -> list[tuple[int, int]]:
        """First and last batch of each array, in order; those that a merged array covers are left out."""
        path, files = files_of(self.spark, self.folder)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        done = [n for n in names if n.startswith("array_") and files.exists(files_of(self.spark, f"{self.folder}/{n}/_SUCCESS")[0])]
        found = sorted(tuple(map(int, n.split("_")[1:])) for n in done)
        return [(a, z) for a, z in found if not any((b, y) != (a, z) and b <= a and z <= y for b, y in found)]

    def path(self, array: tuple[int, int]) -> str:
        return f"{self.folder}/array_{array[0]}_{array[1]}"

    def read(self, array: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema("head binary, n long").parquet(self.path(array))

    def write(self, rows: DataFrame, array: tuple[int, int]) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(array))
        return self.read(array)

    def settle(self) -> None:
        """Merge neighbours of equal size until there are none; the merged ones are deleted."""
        own = self.arrays()
        while len(own) > 1 and own[-1][1] - own[-1][0] == own[-2][1] - own[-2][0]:
            left, right = own[-2:]
            both = self.read(left).unionByName(self.read(right)).groupBy("head").agg(F.sum("n").alias("n"))
            self.write(both.sortWithinPartitions("head"), (left[0], right[1]))
            for old in (left, right):
                path, files = files_of(self.spark, self.path(old))
                files.delete(path, True)
            own = self.arrays()

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Enter a batch (head, ...); the heads that it has twice or shares with an earlier one."""
        self.settle()
        earlier = self.arrays()
        number = earlier[-1][1] + 1 if earlier else 0
        new = self.write(suffix_array(suffixes), (number, number))
        shared = new.where("n > 1").select("head")
        for array in earlier:
            shared = shared.unionByName(new.select("head").join(self.read(array).select("head"), "head"))
        shared = write_table(shared.distinct(), f"{self.folder}/shared_{number}")
        self.settle()
        return shared


def shared_heads(suffixes: DataFrame, folder: str, batches: int = BATCHES) -> DataFrame:
    """(head): heads that occur at least twice among all suffixes, batch by batch."""
    family, found = IndexFamily(suffixes.sparkSession, folder), None
    for k in range(batches):
        own = family.add(suffixes.where(F.pmod("row", F.lit(batches)) == k))
        found = own if found is None else found.unionByName(own)
    return found.distinct()


CHUNK = pa.schema([("row", pa.int64()), ("top", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("core", pa.int64()), ("extent", pa.int64())])


def chunk_keys(texts: DataFrame, size: int, length: int) -> DataFrame:
    """CHUNK columns for chunks of ``size`` windows of ``texts`` (row, text, ranges).

    A range (top, first, last) is of window starts; it is cut downwards from
    ``top``, which stands at one place of the match in every copy. The hashes
    of core and extent tell extents apart together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, middle = xxhash.xxh3_64_intdigest, 1 << 63
        for batch in batches:
            for part, datas in texts_in(batch):
                out: list[list[int]] = [[] for _ in CHUNK]
                for row, data, ranges in zip(part.column("row").to_pylist(), datas, part.column("ranges").to_pylist()):
                    raw = memoryview(data)
                    for r in ranges:
                        for k in range((r["top"] - r["last"]) // size, (r["top"] - r["first"]) // size + 1):
                            top = r["top"] - k * size
                            first, last = max(r["first"], top - size + 1), min(r["last"], top)
                            core = digest(raw[top : top - size + 1 + length]) - middle
                            extent = digest(raw[first : last + length], (top - first) * 4096 + top - last) - middle
                            for column, value in zip(out, (row, top, first, last, core, extent)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CHUNK)], schema=CHUNK)

    return texts.select("row", "text", "ranges").mapInArrow(run, "row long, top int, first int, last int, core long, extent long")


RANGES = "array<struct<top int, first int, last int>>"


def ranges_of_anchors(texts: DataFrame, length: int) -> DataFrame:
    """(row, text, ranges): for each anchor in ``ats`` of ``texts`` (row, text, ats) its windows."""
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("top", "first", "last")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, datas in texts_in(batch):
                found = []
                for data, wanted in zip(datas, part.column("ats")):
                    at, first, last, _ = anchors(data, length)
                    keep = np.isin(at, np.asarray(wanted.values))
                    found.append([{"top": a, "first": f, "last": z} for a, f, z in zip(at[keep].tolist(), first[keep].tolist(), last[keep].tolist())])
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(found, kind)], names=["row", "text", "ranges"])

    return texts.select("row", "text", "ats").mapInArrow(run, f"row long, text string, ranges {RANGES}")


def repeated_windows(texts: DataFrame, length: int, steps: Scratch) -> DataFrame:
    """(row, first, last): ranges of window starts of ``texts`` (row, text, ats) whose windows also start elsewhere."""
    found, todo, window = None, ranges_of_anchors(texts, length), F.struct("top", "first", "last")
    for size in CHUNKS:
        own = Scratch(texts.sparkSession)
        chunks = own.save(chunk_keys(todo, size, length))
        groups = own.save(chunks.groupBy("core", "extent").agg(F.count("*").alias("n"), F.min(F.struct("row", window.alias("window"))).alias("one")))
        covered = steps.save(chunks.join(groups.where("n > 1").select("core", "extent"), ["core", "extent"], "left_semi").select("row", "first", "last"))
        found = covered if found is None else found.unionByName(covered)
        if size > 1:
            unclear = groups.groupBy("core").agg(F.count("*").alias("extents"), F.min("n").alias("least")).where("extents > 1 and least = 1").select("core")
            kept = groups.join(unclear, "core", "left_semi").select("one.*")
            ranges = steps.save(kept.groupBy("row").agg(F.collect_list("window").alias("ranges")))
            todo = texts.select("row", "text").join(ranges, "row")
        own.drop()
    return found


def covered_bytes(size: int, length: int, ranges: list[dict[str, int]], cyclic: np.ndarray) -> np.ndarray:
    """The bytes of a text that lie in these windows, as a mask."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, np.concatenate([[r["first"] for r in ranges], cyclic[:, 0]]).astype(np.int64), 1)
    np.add.at(edge, np.concatenate([[r["last"] for r in ranges], cyclic[:, 1]]).astype(np.int64) + length, -1)
    return np.cumsum(edge[:-1]) > 0


REMOVED = "row long, n_removed long, n_spans long, kept_sha256 string"


def removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of REMOVED from (row, text, cyclic, ranges)."""
    none = np.zeros((0, 2), np.int64)
    for batch in batches:
        for part, texts in texts_in(batch):
            out: list[list] = [[] for _ in range(3)]
            for data, cyclic, ranges in zip(texts, part.column("cyclic").to_pylist(), part.column("ranges").to_pylist()):
                gone = covered_bytes(len(data), LENGTH, ranges or [], anchors(data, LENGTH)[3] if cyclic else none)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for column, value in zip(out, (int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, out)], names=["row", "n_removed", "n_spans", "kept_sha256"])


def short_repeats(rows: DataFrame, possible: DataFrame, removed: DataFrame, steps: Scratch) -> DataFrame:
    """(row): texts without a removed byte that share PASSAGE bytes with another place.

    Only anchors whose heads such texts share are compared, those of all texts.
    """
    open_ = possible.join(removed.where("n_removed > 0").select("row"), "row", "left_anti")
    heads = steps.save(open_.where("at >= 0").select("head").distinct())
    ats = possible.join(heads, "head", "left_semi").groupBy("row").agg(F.collect_set("at").alias("ats"))
    texts = steps.save(rows.select("row", "text").join(ats, "row"))
    cyclic = open_.where("at < 0").select("row")
    return repeated_windows(texts, PASSAGE, steps).select("row").unionByName(cyclic).distinct()


def copies_of(rows: DataFrame, steps: Scratch) -> DataFrame:
    """(row, first): rows whose text occurs more than once, and the first row that has it."""
    key = ["key_a", "key_b"]
    groups = steps.save(rows.groupBy(key).agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1"))
    share = F.col("n") * HEAVY >= rows.count()
    marked = rows.select("row", *key).join(F.broadcast(groups.where(share).select(*key, "first")), key, "left")
    light = marked.where("first is null").select("row", *key).join(groups.where(~share).select(*key, "first"), key)
    return steps.save(marked.where("first is not null").select("row", "first").unionByName(light.select("row", "first")))


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """What stays of each document's bytes, as RESULT says; ``repeats`` is 1 if PASSAGE bytes of it also start elsewhere, else 0."""
    steps = Scratch(docs.sparkSession)
    facts = [
        F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"),
        F.xxhash64("text").alias("key_a"), F.xxhash64("text", F.lit(1)).alias("key_b"),
    ]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = steps.save(given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *facts))
    copies = copies_of(rows, steps)
    suffixes = steps.save(anchored(rows.where(F.col("n_bytes") >= PASSAGE)).join(copies.where("row <> first").select("row"), "row", "left_anti"))
    # Saved before they are joined: a skewed join is only split between plain shuffles.
    shared = steps.save(shared_heads(suffixes.where("at >= 0"), f"{steps.folder}/family", batches))
    possible = steps.save(suffixes.join(shared, "head", "left_semi").unionByName(suffixes.where("at < 0").select("head", "row", "at")))
    ats = possible.groupBy("row").agg(F.collect_set("at").alias("ats"))
    matched = steps.save(rows.select("row", "text").join(ats, "row").withColumn("cyclic", F.array_contains("ats", CYCLIC)))
    ranges = repeated_windows(matched, LENGTH, steps).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    touched = matched.select("row", "text", "cyclic").join(ranges, "row", "left").where("cyclic or ranges is not null")
    removed = steps.save(touched.mapInArrow(removal, REMOVED))
    short = short_repeats(rows, possible, removed, steps).withColumn("short", F.lit(1))
    known = rows.drop("text", "key_a", "key_b")
    for more in (removed, short, copies.withColumnRenamed("first", "copy")):
        known = known.join(more, "row", "left")
    copied = F.col("copy").isNotNull()
    gone = F.when(copied, F.when(F.col("n_bytes") >= LENGTH, F.col("n_bytes")).otherwise(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    result = known.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.when(copied, (gone > 0).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(~copied, F.coalesce("kept_sha256", "sha256")).when(gone > 0, hashlib.sha256(b"").hexdigest()).otherwise(F.col("sha256")).alias("kept_sha256"),
        F.when(copied, F.col("n_bytes") >= PASSAGE).otherwise((gone > 0) | F.col("short").isNotNull()).cast("long").alias("repeats"),
    )
    final = saved(result)
    steps.drop()
    return final


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: how much of each document's bytes repeats elsewhere, and what stays."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

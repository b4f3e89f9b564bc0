"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's words are lower-cased as in ``simhash``; fewer than five words are
one shingle. Candidates come from the SimHash fingerprints of these shingles,
by the tiles of ``simhash``, and from min-hashes, as fingerprints don't reach
down to 0.8: some ten of 64 bits differ there, and blocks that two such
fingerprints surely share are three or four bits wide, so tiles of blocks
would compare all with all. Of min-hashes there are ``BANDS`` times ``ROWS``
least values of a text's shingles under different orders; texts that share all
least values of a band are candidates. A pair at 0.8 shares none with a
probability of (1 - 0.8^5)^40, about 1 in 8 million; a more similar pair with
less. Texts of equal words are one from the start.

Rows of one band are joined by links between neighbours in the order of bands
and rows; a band of any size is cut by ranges, whose ends are joined after.
Bands also join texts far below 0.8, one of 0.5 with about 72 %, so components
of candidates can chain. One with more than ``TILE_TEXTS`` texts or
``TILE_SHINGLES`` shingles is therefore formed anew: its texts meet in their
bands with one byte of each min-hash (``MARKS`` bytes), and only those that
agree in ``AGREE`` of them, an estimated similarity of 0.6, stay linked. A pair
at 0.8 agrees in fewer with a probability of about 1 in 10^11.

Each component is then compared in full with exact counts of common shingles.
One that is still too large for a task is dealt to parts by hash, and each two
parts meet in a task of their own. A task reports a spanning forest of the
pairs that pass; components of these links are the groups of near copies. Not
all pairs but whole components are compared, as a text may be linked to its
group through any one of its members: pairs with a band's first row alone would
lose such links.

Defined results: null and empty texts are copies of each other; rows are told
apart by a number of their own, so that repeated ids and rows without an id
are handled as any other; other columns pass through; an empty table gives no
rows. A similarity of just 0.8 counts. A very long text is held in one task
with its shingles' hashes, and so are those of two parts that meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payspark.llm.arrowtext import as_strings, free_name, slices
from payspark.llm.checkpoints import saved
from payspark.llm.components import components
from payspark.llm.simhash import links_of, majority, shingle_hashes

WIDTH, BANDS, ROWS = 5, 40, 5
#: Texts, and shingles, of a candidate component's part.
TILE_TEXTS, TILE_SHINGLES = 1024, 2_000_000
#: Min-hashes of which a byte is kept, and how many agree where texts may be near copies.
MARKS, AGREE = BANDS * ROWS, 120
#: Rows of a band that one task compares by their marks.
HOT = 8192
#: Odd factors, each of which orders the shingles' hashes anew.
FACTORS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text that has shingles, a number for each band, and the lowest byte of each min-hash."""
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    out, marks = np.zeros((len(starts), BANDS), np.uint64), np.zeros((len(starts), MARKS), np.uint8)
    if len(starts):
        for k, factor in enumerate(FACTORS):
            band = k // ROWS
            own = np.minimum.reduceat(hashes * factor, starts)
            marks[:, k] = own.astype(np.uint8)
            out[:, band] = ((out[:, band] ^ own) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, band] ^= out[:, band] >> np.uint64(29)
    return out, marks


def sketches(rows: DataFrame) -> DataFrame:
    """(row, key, size, fp, bands, marks) of rows (row, text): a hash of all words, how many shingles, the fingerprint, bands and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, counts = shingle_hashes(as_strings(part.column("text")), WIDTH)
                raw, ends = hashes.tobytes(), 8 * np.cumsum(counts)
                keys = [xxhash.xxh3_128_digest(raw[e - n : e]) for e, n in zip(ends.tolist(), (8 * counts).tolist())]
                bands, marks = bands_of(hashes, counts)
                bounds = np.concatenate([[0], np.cumsum(counts > 0)]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(bounds * np.int32(BANDS)), pa.array(bands.view(np.int64).ravel()))
                bytes_of = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds * np.int32(MARKS)), pa.py_buffer(marks)])
                prints = pa.array(majority(hashes, counts).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(keys, pa.binary()), pa.array(counts.astype(np.int64)), prints, found, bytes_of], names=["row", "key", "size", "fp", "bands", "marks"])

    return rows.select("row", "text").mapInArrow(run, "row long, key binary, size long, fp long, bands array<long>, marks binary")


def chains(bands: DataFrame) -> DataFrame:
    """Links (a, b) that join the rows of each band, of (row, band).

    Ranges of bands and rows are sorted, so a band with very many rows takes
    many tasks. Each task also gives its first and its last row, by which the
    ranges that hold parts of one band are joined.
    """
    names = ["edge", "band", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, row, first = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            band = np.concatenate([band[-1:], batch.column("band").to_numpy()])
            row = np.concatenate([row[-1:], batch.column("row").to_numpy()])
            if first is None and len(band):
                first = band[0], row[0]
            same = band[1:] == band[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(same.sum(), bool)), *map(pa.array, (band[1:][same], row[:-1][same], row[1:][same]))], names=names)
        if first is not None:
            rows = pa.array([first[1], row[-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([True, True]), pa.array([first[0], band[-1]], pa.int64()), rows, rows], names=names)

    ranges = bands.select("band", "row").repartitionByRange("band", "row").sortWithinPartitions("band", "row")
    found = saved(ranges.mapInArrow(run, "edge boolean, band long, a long, b long"))
    edges = found.where("edge")
    joined = edges.join(edges.groupBy("band").agg(F.min("a").alias("least")), "band").select(F.col("least").alias("a"), "b")
    return found.where("not edge").select("a", "b").unionByName(joined)


def agreeing(marks: np.ndarray) -> np.ndarray:
    """For each row of marks, the index of its component's first row; links agree in ``AGREE`` marks."""
    root, left = np.arange(len(marks)), np.arange(len(marks))
    front: list[int] = []
    own = 0
    while len(left):
        if not front:
            own = int(left[0])
            front, reached = [own], left == own
        else:
            x = front.pop()
            reached = (marks[left] == marks[x]).sum(axis=1) >= AGREE
            front += left[reached].tolist()
        if reached.any():
            root[left[reached]] = own
            left = left[~reached]
    return root


def meetings(parts: str) -> Column:
    """Pairs (low, high) of parts in which ``row`` meets the others, one with itself where there is one part alone."""
    own = F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col(parts) - 1), lambda x: (x != own) | (F.col(parts) == 1))
    return F.explode(F.transform(others, lambda x: F.struct(F.least(x, own).alias("low"), F.greatest(x, own).alias("high"))))


def agreeing_links(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that join texts (row, bands, marks) with a common band and ``AGREE`` common marks."""
    tiles = texts.select("row", "marks", F.explode("bands").alias("band"))
    sizes = texts.select(F.explode("bands").alias("band")).groupBy("band").count().where("count > 1")
    parts = F.ceil(F.col("count") / hot).cast("int")
    dealt = tiles.join(sizes.select("band", parts.alias("parts")), "band").select("row", "marks", "band", meetings("parts").alias("meet"))
    return forest_of(dealt.select("band", "meet.low", "meet.high", "row", "marks"), "marks", lambda held: agreeing(np.stack([np.frombuffer(m, np.uint8) for m in held])))


def print_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the rows of ``texts`` (row, fp) whose fingerprints are equal or linked."""
    prints = saved(texts.groupBy("fp").agg(F.min("row").alias("own")))
    equal = texts.join(prints, "fp").where("row <> own").select(F.col("row").alias("a"), F.col("own").alias("b"))
    linked = saved(links_of(prints.select("fp")))  # tables in between keep the driver's plans small
    for end in "ab":
        linked = linked.join(prints.select(F.col("fp").alias(end), F.col("own").alias(f"row_{end}")), end)
    return saved(equal.unionByName(linked.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(row, shingles) of rows (row, text): the sorted distinct hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, counts = shingle_hashes(as_strings(part.column("text")), WIDTH)
                ends = np.cumsum(counts)
                sets = [np.unique(hashes[e - n : e]).tobytes() for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.binary())], names=["row", "shingles"])

    return rows.select("row", "text").mapInArrow(run, "row long, shingles binary")


def roots_of_sets(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the index of its component's first set; links are a similarity of 0.8 or more."""
    size = np.array([len(s) for s in sets], np.int64)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    root, left, mark = np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(names), bool)
    of_left = codes
    front: list[int] = []
    own = 0
    while len(left):
        if not front:
            own = int(left[0])
            front, reached = [own], left == own
        else:
            x = front.pop()
            mine = codes[ends[x] - size[x] : ends[x]]
            mark[mine] = True
            common = np.add.reduceat(mark[of_left].astype(np.int64), np.cumsum(size[left]) - size[left])
            mark[mine] = False
            reached = 9 * common >= 4 * (size[x] + size[left])
            front += left[reached].tolist()
        if reached.any():
            root[left[reached]] = own
            of_left = of_left[~np.repeat(reached, size[left])]
            left = left[~reached]
    return root


def forest_of(dealt: DataFrame, data: str, roots: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Links (a, b) from a row to the one that ``roots`` names, among rows with the same first three columns of ``dealt``."""
    where = dealt.columns[:3]

    def joined(rows: list[int], held: list[bytes]) -> pa.RecordBatch:
        root = roots(held)
        moved = np.flatnonzero(root != np.arange(len(root)))
        own = np.array(rows, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, held = None, [], []
        for batch in batches:
            for at, row, own in zip(zip(*(batch.column(c).to_pylist() for c in where)), batch.column("row").to_pylist(), batch.column(data)):
                if at != tile and rows:
                    yield joined(rows, held)
                if at != tile:
                    tile, rows, held = at, [], []
                rows.append(row)
                held.append(own.as_py())
        if rows:
            yield joined(rows, held)

    return dealt.select(*where, "row", data).repartition(*where).sortWithinPartitions(*where).mapInArrow(run, "a long, b long")


def verified_links(dealt: DataFrame) -> DataFrame:
    """Links (a, b) between rows of the same (root, low, high) that join all its near copies."""
    return forest_of(dealt.select("root", "low", "high", "row", "shingles"), "shingles", lambda held: roots_of_sets([np.frombuffer(s, np.uint64) for s in held]))


def candidates(texts: DataFrame, tile_texts: int, tile_shingles: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(row, root, size) of texts that may have near copies, and (root, parts): over how many parts a component goes."""
    parts = F.greatest(F.ceil(F.count("*") / tile_texts), F.ceil(F.sum("size") / tile_shingles)).cast("int").alias("parts")

    def known(near: DataFrame) -> DataFrame:
        return near.join(texts.select(F.col("row").alias("node"), "size"), "node").select(F.col("node").alias("row"), "root", "size")

    links = chains(texts.select("row", F.explode("bands").alias("band"))).unionByName(print_links(texts.select("row", "fp")))
    members = saved(known(components(links)))
    sizes = saved(members.groupBy("root").agg(parts))
    large = sizes.where("parts > 1").select("root")
    if not large.isEmpty():
        anew = texts.join(members.join(large, "root", "left_semi").select("row"), "row", "left_semi")
        members = saved(members.join(large, "root", "left_anti").unionByName(known(components(agreeing_links(anew, hot)))))
        sizes = saved(members.groupBy("root").agg(parts))
    return members, sizes


def groups(rows: DataFrame, tile_texts: int = TILE_TEXTS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(row, group) of rows (row, text) with distinct numbers; near copies, and they alone, have the same group."""
    found = saved(sketches(rows))
    firsts = saved(found.groupBy("key").agg(F.min("row").alias("first")))
    distinct = saved(found.join(firsts.select(F.col("first").alias("row")), "row", "left_semi"))
    members, sizes = candidates(distinct, tile_texts, tile_shingles)
    dealt = members.join(sizes, "root").select("row", "root", meetings("parts").alias("meet"))
    sets = shingle_sets(rows.join(members.select("row"), "row", "left_semi"))
    met = dealt.join(sets, "row").select("row", "root", "shingles", "meet")
    links = components(verified_links(met.select("row", "root", "shingles", "meet.low", "meet.high")))
    named = firsts.join(links.withColumnRenamed("node", "first"), "first", "left").select("key", F.coalesce("root", "first").alias("group"))
    return found.select("row", "key").join(named, "key").select("row", "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with the columns that ``docs`` had.

    It is the row with the least id, of rows with this id the first, and one
    without an id only where the group has none.
    """
    own = free_name("row", docs.columns)
    numbered = saved(docs.withColumn(own, F.monotonically_increasing_id()))
    rows = numbered.select(F.col(own).alias("row"), "doc_id", "text")
    known = rows.select("row", "doc_id").join(groups(rows), "row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = known.groupBy("group").agg(least.alias("least")).select(F.col("least.row").alias(own))
    return numbered.join(kept, own, "left_semi").select(*docs.columns)

"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit for each of 64 positions, set where over half
of its 3-word shingles' hashes have it set. Two fingerprints link if they
differ in at most ``RADIUS`` bits. To find all links without comparing all
with all, distinct fingerprints meet in tiles: of two that link, one of the
four 16-bit blocks is equal, and of the other 48 bits one of four 12-bit
blocks, so each fingerprint goes to 16 tiles, named by 28 of its bits. Within
a tile rows are ordered by population count and compared with numpy exclusive-
or and bit counts, a sub-tile at a time; sub-tiles whose counts differ beyond
the radius are skipped, and in small tiles, which are compared together, rows
whose counts do. A tile of more than ``HOT`` rows is split by population count
and hash into parts that meet pairwise in different tasks, so each of its rows
is copied about three times the number of parts of its counts' neighbourhood.

A tile reports a spanning forest, not all pairs. Components come from
distributed contraction of these links, so copies are never expanded.

Defined results: a null or empty text has the fingerprint zero, linked like
any other; fewer than three words are one shingle; repeated rows share their
component; a row without a ``doc_id`` links its neighbours, but a component
is named after ids alone (null if it has none); fingerprints at equal distance
all link; other columns are ignored; an empty table gives no rows. A very long
text is held in one task with the hashes of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payspark.llm.arrowtext import LOWER, as_strings, data_of, mapped, owners, slices, words_of
from payspark.llm.checkpoints import checkpointed
from payspark.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Rows of a tile that one task compares; a larger tile is split.
HOT = 8192
#: Rows of a sub-tile.
TILE = 256
#: Of each byte, its bits as eight 8-bit lanes of a number.
LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def shingle_hashes(texts: pa.StringArray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of ``width`` words, text by text, and how many each text has."""
    flat, counts = words_of(mapped(texts, LOWER))
    size = pc.binary_length(flat).to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat), " ")
    row = owners(counts)
    ends = np.cumsum(size + 1) - np.cumsum(counts > 0)[row] if len(row) else size
    begins = ends - size
    per_text = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.repeat(bounds[:-1], per_text) + np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    last = np.minimum(first + width - 1, np.repeat(bounds[1:], per_text) - 1)
    data, digest = data_of(joined).tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(begins[first].tolist(), ends[last].tolist())), np.uint64, len(first)), per_text


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row of hashes, the bits that over half of them have; 0 for none."""
    step = 255
    parts = -(-counts // step)
    owner = owners(parts)
    begin = np.repeat(np.cumsum(counts) - counts, parts) + step * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    total = np.zeros((len(counts), 64), np.int64)
    if len(owner):
        lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], begin, axis=0)
        each = lanes.view(np.uint8).reshape(len(owner), 64)
        full = np.flatnonzero(parts > 0)
        total[full] = np.add.reduceat(each, (np.cumsum(parts) - parts)[full], axis=0, dtype=np.int64)
    return np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(texts: pa.StringArray) -> np.ndarray:
    return majority(*shingle_hashes(texts))


def roots_in_tile(prints: np.ndarray) -> np.ndarray:
    """For each row of a tile, the index of its component's first row; links are within RADIUS bits.

    Starting from each row not reached yet, sub-tiles of reached rows are
    compared with the sub-tiles of unreached ones whose population counts are
    near enough.
    """
    order = np.argsort(np.bitwise_count(prints), kind="stable")
    values = prints[order]
    weight = np.bitwise_count(values).astype(np.int64)
    root, left = np.empty(len(values), np.int64), np.arange(len(values))
    while len(left):
        front, left = left[:1], left[1:]
        own = front[0]
        root[front] = own
        while len(front):
            some, front = front[:TILE], front[TILE:]
            low = np.searchsorted(weight[left], weight[some].min() - RADIUS)
            high = np.searchsorted(weight[left], weight[some].max() + RADIUS, side="right")
            reached = np.zeros(len(left), bool)
            for at in range(low, high, 8 * TILE):
                near = left[at : min(at + 8 * TILE, high)]
                reached[at : at + len(near)] = (np.bitwise_count(values[some][:, None] ^ values[near][None, :]) <= RADIUS).any(axis=0)
            found, left = left[reached], left[~reached]
            root[found] = own
            front = np.concatenate([front, found])
    out = np.empty(len(values), np.int64)
    out[order] = order[root]
    return out


def forest(keys: np.ndarray, prints: np.ndarray, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what tiles join; rows of a tile are next to each other."""
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        tile = prints[start : start + size]
        root = roots_in_tile(tile)
        moved = np.flatnonzero(root != np.arange(size))
        a.append(tile[moved])
        b.append(tile[root[moved]])
    tile = np.repeat(np.where(sizes > small, -1, np.arange(len(sizes))), sizes)
    # Small tiles are compared together, each in the order of population counts.
    weight = np.bitwise_count(prints).astype(np.int64)
    order = np.lexsort((weight, tile))
    tile, prints, weight = tile[order], prints[order], weight[order]
    rows = np.flatnonzero((tile >= 0) & (np.repeat(sizes, sizes)[order] > 1))
    label, pairs = np.arange(len(keys)), []
    for lag in range(1, small):
        rows = rows[rows + lag < len(keys)]
        rows = rows[(tile[rows] == tile[rows + lag]) & (weight[rows + lag] - weight[rows] <= RADIUS)]
        if not len(rows):
            break
        near = rows[np.bitwise_count(prints[rows] ^ prints[rows + lag]) <= RADIUS]
        pairs.append(np.stack([near, near + lag]))
    if pairs:
        x, y = np.concatenate(pairs, axis=1)
        while True:
            before = label.copy()
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(len(label)))
        a.append(prints[moved])
        b.append(prints[label[moved]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def tile_keys() -> Column:
    """The 16 tiles of the fingerprint ``fp``."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
        high = F.shiftrightunsigned("fp", 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * i).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << 16 * i) - 1)))
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * i + j) << 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.explode(F.array(*keys))


def links_of(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join what RADIUS joins."""
    tiles = prints.select("fp", tile_keys().alias("tile"))
    crowded = tiles.groupBy("tile").count().where(F.col("count") > hot).select("tile", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    dealt = tiles.join(crowded, "tile", "left")
    band = F.shiftright(F.bit_count("fp"), 2)
    own = band * F.col("parts") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.sequence((band - 1) * F.col("parts"), (band + 2) * F.col("parts") - 1)
    meets = F.transform(F.filter(others, lambda x: x != own), lambda x: F.struct(F.least(x, own).alias("low"), F.greatest(x, own).alias("high")))
    alone = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
    dealt = dealt.select("fp", "tile", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(meets)).alias("meet")).select("fp", "tile", "meet.low", "meet.high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.concatenate([keys, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tile", "low", "high")], axis=1)])
                values = np.concatenate([values, batch.column("fp").to_numpy().view(np.uint64)])
                if len(keys) < 50_000:
                    continue
            last = 0 if not len(keys) else int(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))[-1])
            stop = len(keys) if batch is None else last
            a, b = forest(keys[:stop], values[:stop])
            keys, values = keys[stop:], values[stop:]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    where = ["tile", "low", "high"]
    return dealt.repartition(*where).sortWithinPartitions(*where).mapInArrow(run, "a long, b long")


def _with_end(items: Iterator) -> Iterator:
    yield from items
    yield None


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; ``fp`` is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = fingerprints(as_strings(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of every document; see the module text."""
    rows = checkpointed(fingerprint_rows(docs))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links_of(distinct.select("fp"), hot)).withColumnRenamed("node", "fp")
    known = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: every document's fingerprint and the smallest id of its component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

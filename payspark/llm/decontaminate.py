"""Benchmark decontamination with suffix arrays over the training documents.

A shard is a run of documents of some MB. For each shard a task builds the
array of its word suffixes, sorted by prefix doubling, and looks up every
suffix of the benchmark items by binary search: the neighbours of its place
give its longest verbatim match, the suffixes that share its window all
locations. A window is ``WINDOW`` consecutive words of an item, or all words of
a shorter item. Documents with a word inside an occurrence are contaminated.

Documents are not shuffled. The items go to the tasks in broadcast blocks of
about ``BLOCK_BYTES`` each, of which the driver holds one at a time. A worker
holds the blocks of one round, ``MOST_BYTES`` at most. Up to that size there is
one round, a map in which a shard is sorted once and every block looked up in
it; a larger benchmark takes more rounds, each of which sorts the shards again
and adds to what the round before has found, saved in between.

Defined results: a null or empty text, document or item, has no words, so it
neither hits nor is hit; items without an id are left out; an id that comes
more than once has the windows of all its rows and is listed once; repeated
documents get the same result each; an empty benchmark hits nothing; other
columns pass through; an empty table gives no rows. Of equally long matches
in a shard ``longest_matches`` reports one, and windows hit at all their
locations. A very long text is a shard of its own, held in one task with some
forty bytes for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payspark.llm.arrowtext import LOWER_ALNUM, as_strings, distinct, free_name, mapped, owners, slices, sums_by_row, words_of
from payspark.llm.checkpoints import Scratch, saved

WINDOW = 10
#: Bytes of documents in a shard, of item texts in a block, and of those in all blocks of a round.
SHARD_BYTES, BLOCK_BYTES, MOST_BYTES = 8 << 20, 16 << 20, 64 << 20

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
])
MATCHES = "item_id string, item_word long, length long, doc_id long, doc_word long"


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` codes at least.

    Only suffixes that still tie are sorted again, by the ranks of what
    follows, twice as far in each round.
    """
    n = len(codes)
    order = np.argsort(codes)
    by = codes[order]
    fresh = np.concatenate([[True], by[1:] != by[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if n else 0
    tied = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]]))) if n else np.zeros(0, np.int64)
    reach = 1
    while reach < depth and len(tied):
        own = order[tied]
        ahead = own + reach
        key = rank[own] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        tied = tied[~(fresh & np.concatenate([fresh[1:], [True]]))]
        reach *= 2
    return order


@dataclass
class Items:
    """Benchmark items: their distinct words, and all items' words as numbers of these, one after the other."""

    ids: list[str]
    words: list[str]
    codes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, ids: list[str], texts: pa.StringArray) -> Items:
        flat, counts = words_of(mapped(texts, LOWER_ALNUM))
        coded = flat.dictionary_encode()
        return cls(ids, coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), counts)


@dataclass
class Shard:
    """Words of documents as codes from 1, with a 0 after each document, and their suffix array."""

    codes: np.ndarray
    array: np.ndarray
    dictionary: pa.StringArray
    doc: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: pa.StringArray, depth: int) -> Shard:
        flat, counts = words_of(mapped(texts, LOWER_ALNUM))
        coded = flat.dictionary_encode()
        doc = owners(counts + 1)
        codes = np.zeros(len(doc), np.int64)
        codes[np.arange(len(flat)) + owners(counts)] = coded.indices.to_numpy().astype(np.int64) + 1
        return cls(codes, suffix_array(codes, depth), coded.dictionary, doc, counts)

    def common(self, place: np.ndarray, test: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words, up to ``limit``, the suffixes at these places share with those of ``test``."""
        length, alive = np.zeros(len(place), np.int64), np.flatnonzero((place >= 0) & (limit > 0))
        while len(alive):
            at = self.array[place[alive]] + length[alive]
            alive = alive[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == test[start[alive] + length[alive]])]
            length[alive] += 1
            alive = alive[length[alive] < limit[alive]]
        return length

    def search(self, test: np.ndarray, start: np.ndarray, limit: np.ndarray, past: bool) -> np.ndarray:
        """Binary search: of the suffixes of ``test``, cut after ``limit`` words, the first place not before
        them, or with ``past`` the first place after all that begin with them."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.array), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            same = self.common(middle, test, start[open_], limit[open_])
            done = same == limit[open_]
            at = self.array[middle] + same
            ours = np.where(at < len(self.codes), self.codes[np.minimum(at, len(self.codes) - 1)], -2)
            theirs = test[np.minimum(start[open_] + same, len(test) - 1)]
            before = np.where(done, past, ours < theirs)
            low[open_[before]], high[open_[~before]] = middle[before] + 1, middle[~before]
        return low

    def lookup(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each item word: the longest match of the suffix there, within its item, and the array place of one; last the item words as this shard's codes."""
        code = pc.index_in(pa.array(items.words, pa.string()), value_set=self.dictionary).fill_null(-2).to_numpy() + 1
        test = code[items.codes] if len(items.words) else np.zeros(0, np.int64)
        start = np.arange(len(test))
        rest = np.repeat(np.cumsum(items.counts), items.counts) - start
        known = np.flatnonzero(test > 0)
        length, place = np.zeros(len(test), np.int64), np.full(len(test), -1)
        if len(known) and len(self.array):
            at = self.search(test, known, rest[known], False)
            for near in (at - 1, np.where(at < len(self.array), at, -1)):
                same = self.common(near, test, known, rest[known])
                better = same > length[known]
                length[known[better]], place[known[better]] = same[better], near[better]
        return length, place, test

    def hits(self, items: Items, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Covered words of the shard as a mask, and pairs of document and item numbers, sorted; last the longest matches."""
        length, _, test = self.lookup(items)
        need = np.repeat(np.minimum(items.counts, window), items.counts)
        start = np.flatnonzero((length >= need) & (need > 0))
        edge = np.zeros(len(self.codes) + 1, np.int32)
        if not len(start):
            return edge[:-1] > 0, np.zeros(0, np.int64), np.zeros(0, np.int64), length
        low, high = self.search(test, start, need[start], False), self.search(test, start, need[start], True)
        owner = owners(items.counts)[start]
        _, first, which = np.unique(np.stack([low, need[start]], axis=1), axis=0, return_index=True, return_inverse=True)
        sizes = (high - low)[first]
        span = np.repeat(np.arange(len(first)), sizes)
        found = self.array[np.repeat(low[first] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(span))]
        np.add.at(edge, found, 1)
        np.add.at(edge, found + need[start][first][span], -1)
        docs = distinct(span * len(self.counts) + self.doc[found])
        span, doc = docs // len(self.counts), docs % len(self.counts)
        pairs = distinct(which.ravel() * len(items.ids) + owner)
        which, item = pairs // len(items.ids), pairs % len(items.ids)
        begin, size = np.searchsorted(which, span), np.bincount(which, minlength=len(first))[span]
        item = item[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        both = distinct(np.repeat(doc, size) * len(items.ids) + item)
        return np.cumsum(edge[:-1]) > 0, both // len(items.ids), both % len(items.ids), length


def runs(mask: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Of each row of the mask, the starts and ends of its runs, flat."""
    out: list[list[int]] = [[] for _ in counts]
    ends = np.cumsum(counts)
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
        row = int(np.searchsorted(ends, a, side="right"))
        out[row] += [a - int(ends[row] - counts[row]), b - int(ends[row] - counts[row])]
    return out


def rounds_of(items: DataFrame, limit: int = BLOCK_BYTES, most: int = MOST_BYTES) -> Iterator[tuple[list[Broadcast], int, bool]]:
    """The items that have an id, in rounds of broadcast blocks: of about ``limit`` bytes each and ``most`` together, the words of the longest item, whether it is the last round.

    A round's blocks are taken back when the next one is asked for, so what
    reads them has to be saved by then.
    """
    context = items.sparkSession.sparkContext
    known = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, many = int(total // limit) + 1, max(1, most // limit)
    for first in range(0, count, many):
        out, longest = [], 1
        for k in range(first, min(first + many, count)):
            own = known if count == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
            found = own.toArrow()
            block = Items.of(found.column("item_id").to_pylist(), as_strings(found.column("text")))
            longest = max(longest, int(max(block.counts, default=1)))
            out.append(context.broadcast(block))
        last = first + many >= count
        yield out, longest, last
        if not last:
            for block in out:
                block.destroy()


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of ``FIELDS``, and that column's name."""
    from pyspark.sql.pandas.types import to_arrow_type

    name, given = free_name("result", docs.columns), list(docs.columns)
    kind = to_arrow_type(FIELDS)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FIELDS)])

    def run(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast], longest: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SHARD_BYTES):
                shard = Shard.of(as_strings(part.column("text")), longest)
                covered, counts = np.zeros(len(shard.codes), bool), shard.counts
                listed: list[set[str]] = [set() for _ in counts]
                if len(part.columns) > len(given):  # what earlier rounds have found
                    begins = (np.cumsum(counts + 1) - counts - 1).tolist()
                    for d, before in enumerate(part.column(len(given)).to_pylist()):
                        listed[d].update(before["items"])
                        for a, z in zip(before["spans"][::2], before["spans"][1::2]):
                            covered[begins[d] + a : begins[d] + z] = True
                for block in blocks:
                    own: Items = block.value
                    mask, doc, item, _ = shard.hits(own, window)
                    covered |= mask
                    for d, i in zip(doc.tolist(), item.tolist()):
                        listed[d].add(own.ids[i])
                mask = covered[shard.codes > 0]
                ids = [sorted(x) for x in listed]
                hit = sums_by_row(mask.astype(np.int64), counts)
                rows = [counts, hit, [len(x) for x in ids], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], hit > 0, runs(mask, counts), ids]
                struct = pa.StructArray.from_arrays([pa.array(v, type=f.type) for v, f in zip(rows, kind)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(given)], struct], names=[*given, name])

    found, before = docs, None
    for blocks, longest, last in rounds_of(items, block_bytes, most_bytes):
        found = found.mapInArrow(lambda batches, blocks=blocks, longest=longest: run(batches, blocks, longest), schema)
        if not last:
            scratch = Scratch(docs.sparkSession)
            found = scratch.save(found)
            if before:
                before.drop()
            before = scratch
    return found, name


def longest_matches(docs: DataFrame, items: DataFrame, least: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The longest verbatim match of each item suffix in each shard with at least ``least`` words, and where it is (``MATCHES``)."""

    def run(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast], longest: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SHARD_BYTES):
                shard = Shard.of(as_strings(part.column("text")), longest)
                for block in blocks:
                    own: Items = block.value
                    length, place, _ = shard.lookup(own)
                    at = np.flatnonzero(length >= least)
                    where = shard.array[place[at]]
                    begin = (np.cumsum(shard.counts + 1) - shard.counts - 1)[shard.doc[where]]
                    item, first = owners(own.counts)[at], (np.cumsum(own.counts) - own.counts)[owners(own.counts)[at]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([own.ids[i] for i in item.tolist()], pa.string()), pa.array(at - first), pa.array(length[at]),
                        part.column("doc_id").cast(pa.int64()).take(pa.array(shard.doc[where])), pa.array(where - begin),
                    ], names=["item_id", "item_word", "length", "doc_id", "doc_word"])

    out = None
    for blocks, longest, last in rounds_of(items, block_bytes, most_bytes):
        found = docs.select("doc_id", "text").mapInArrow(lambda batches, blocks=blocks, longest=longest: run(batches, blocks, longest), MATCHES)
        found = found if last else saved(found)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item touches, with the columns they had."""
    found, name = find_items(docs, items)
    return found.where(~F.col(f"{name}.contaminated")).select(*docs.columns)


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: what each document has of the benchmark."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found, name = find_items(docs.select("doc_id", "text"), items)
    return found.select("doc_id", *(F.col(f"{name}.{c}") for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))

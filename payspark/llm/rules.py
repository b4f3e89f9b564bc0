"""Quality rules: an isolation forest over rule statistics.

Every text gets the usual rule statistics (words, symbols, repeated lines and
word windows, shares of upper case, digits, distinct words and so on). Trees
split these at random; a document that few splits isolate is an anomaly. All
labelled documents grow the trees: each is dealt to one of them, and to more
where there are few, so that a tree has ``SUBSAMPLE`` rows at least. They grow
level by level: tasks give the extent of each node's rows, the driver draws
the nodes' splits, and no row goes there. A leaf's length counts its rows as a
share, so a tree of many rows has the lengths of one of ``SUBSAMPLE`` rows. The
score's threshold comes from the labels of all of them: of the thresholds that
keep at least ``KEEP_GOOD`` of the good rows, the one that best tells good from
bad, among multiples of 1 / ``LEVELS``, over which tasks count the scores.

Scoring is a map over the documents; the forest has a fixed size.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows get the same result each; without labelled rows of both kinds
nothing is rejected but by the base rules; labels of unknown documents don't
count; other columns are ignored, and an empty table gives no rows. A score at
the threshold is kept. A very long text is held in one
task with its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payspark.llm.arrowtext import annotate, as_strings, data_of, distinct, offsets_of, owners, slices, sums_by_row, words_of
from payspark.llm.checkpoints import Scratch
from payspark.llm.labelled import known_labels

WINDOW = 5
TREES, SUBSAMPLE = 100, 256
#: Thresholds that are told apart.
LEVELS = 1 << 20
KEEP_GOOD = 0.985

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
DIGIT = np.isin(np.arange(256), np.arange(48, 58))
MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = T.StructType([*(T.StructField(n, T.LongType()) for n in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def per_text(flags: np.ndarray, texts: pa.StringArray) -> np.ndarray:
    """How many bytes of each text have their flag set."""
    return sums_by_row(flags[data_of(texts)].astype(np.int32), np.diff(offsets_of(texts)))


def duplicate_lines(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line of their text."""
    lines = pc.split_pattern(texts, "\n")
    counts = np.diff(lines.offsets.to_numpy().astype(np.int64))
    coded = lines.flatten().dictionary_encode()
    wordy = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy().astype(np.int64)
    row = owners(counts)[wordy[code]]
    kinds = distinct(row * max(len(wordy), 1) + code[wordy[code]]) // max(len(wordy), 1)
    full = np.bincount(row, minlength=len(texts))
    return full, full - np.bincount(kinds, minlength=len(texts))


def repeated_words(codes: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window of words found at least twice in the row.

    Windows are told apart by 64 bits of their words and row.
    """
    row, n = owners(counts), len(codes)
    if n < window:
        return np.zeros(len(counts), np.int64)
    odd = np.random.default_rng(5).integers(1 << 62, size=window + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = row[: n - window + 1].astype(np.uint64) * odd[-1]
    for k in range(window):
        part = (codes[k : n - window + 1 + k].astype(np.uint64) + np.uint64(k + 1)) * odd[k]
        key += part ^ (part >> np.uint64(31))
    inside = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    inside = inside[np.argsort(key[inside])]
    same = key[inside[1:]] == key[inside[:-1]]
    start = inside[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(inside) else inside
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return sums_by_row((np.cumsum(edge[:-1]) > 0).astype(np.int64), counts)


def statistics(texts: pa.StringArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts, and a matrix of rule statistics with a row for each text."""
    flat, counts = words_of(texts)
    coded = flat.dictionary_encode()
    codes, size = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    chars = sums_by_row(pc.utf8_length(flat).to_numpy().astype(np.int64), counts)
    lines, duplicates = duplicate_lines(texts)
    row = owners(counts)
    kinds = np.bincount(distinct(row * size + codes) // size, minlength=len(texts))
    again = sums_by_row(np.concatenate([[False], (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])])[: len(codes)].astype(np.int64), counts)
    base = {"n_words": counts, "word_chars": chars, "n_symbols": per_text(SYMBOLS, texts), "n_dup_lines": duplicates, "n_repeat_words": repeated_words(codes, counts)}
    matrix = np.stack([
        rate(chars, counts), rate(base["n_symbols"], chars), rate(duplicates, lines), rate(base["n_repeat_words"], counts), rate(per_text(UPPER, texts), chars),
        rate(per_text(DIGIT, texts), chars), rate(per_text(MARK, texts), chars), rate(again, counts), rate(kinds, np.sqrt(counts)) / np.log1p(np.log1p(counts) + 1),
        np.minimum(rate(counts, lines), 200),
    ], axis=1)
    return base, matrix


@dataclass
class IsolationForest:
    """Trees as arrays: a node splits ``feature`` at ``cut``; its children are ``2i + 1`` and ``2i + 2``."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = np.inf

    @staticmethod
    def usual_length(n: np.ndarray | float) -> np.ndarray:
        """Mean path length of an unsuccessful search in a binary tree of n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n, 3) - 1) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> IsolationForest:
        rng = np.random.default_rng(seed)
        m = min(subsample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(m, 2)))))
        nodes = 2 ** (depth + 1) - 1
        feature, cut, length = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, rng.choice(len(rows), m, replace=False))]
            while todo:
                node, level, own = todo.pop()
                low, high = rows[own].min(axis=0), rows[own].max(axis=0)
                usable = np.flatnonzero(high > low)
                if level == depth or len(own) < 2 or not len(usable):
                    length[t, node] = level + cls.usual_length(len(own))
                    continue
                f = rng.choice(usable)
                feature[t, node], cut[t, node] = f, rng.uniform(low[f], high[f])
                left = rows[own, f] < cut[t, node]
                todo += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
        return cls(feature, cut, length, float(cls.usual_length(m)) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher for anomalies."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                at = np.where(inner, 2 * at + 2 - (rows[every, feature[at]] < cut[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)

    def calibrate(self, scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> None:
        """Set the threshold above which rows are rejected."""
        levels, at = np.unique(level_of(scores), return_inverse=True)
        self.calibrate_counts(levels, *(np.bincount(at[own], minlength=len(levels)) for own in (good, ~good)), keep_good)

    def calibrate_counts(self, levels: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> None:
        """The same from how many good and bad rows each of the ascending ``levels`` has."""
        if not good.sum() or not bad.sum():
            return
        kept, missed = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
        usable = np.flatnonzero(kept >= keep_good)
        self.threshold = float(levels[usable[np.argmax(kept[usable] - missed[usable])]]) / LEVELS


def level_of(scores: np.ndarray) -> np.ndarray:
    """The least level, a multiple of 1 / ``LEVELS``, that scores don't exceed."""
    return np.ceil(scores * LEVELS).astype(np.int64)


WIDTH = 10
FEATURES = tuple(f"f{i}" for i in range(WIDTH))
EXTENT = ", ".join(["tree int", "node int", "n long", *(f"{side}{f} double" for side in ("low_", "high_") for f in FEATURES)])


def features(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(f).to_numpy() for f in FEATURES], axis=1)


def trees_of(spread: np.ndarray, shares: int, trees: int) -> np.ndarray:
    """The ``shares`` trees of each row, by its hash: different ones, evenly far apart."""
    return (spread[:, None] % trees + np.arange(shares)[None, :] * trees // shares) % trees


def extents(rows: DataFrame, forest: IsolationForest, shares: int) -> pa.Table:
    """Rows, least and largest features of each tree's lowest nodes, by the splits that the trees have so far."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        own = shared.value
        trees, nodes = own.feature.shape
        n, low, high = np.zeros(trees * nodes, np.int64), np.full((trees * nodes, WIDTH), np.inf), np.full((trees * nodes, WIDTH), -np.inf)
        for batch in batches:
            values = features(batch)
            for tree in trees_of(batch.column("spread").to_numpy(), shares, trees).T:
                at, every = np.zeros(len(values), np.int64), np.arange(len(values))
                while (inner := own.feature[tree, at] >= 0).any():
                    at = np.where(inner, 2 * at + 2 - (values[every, own.feature[tree, at]] < own.cut[tree, at]), at)
                key = tree * nodes + at
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                held = key[order][first]
                n[held] += np.diff(first, append=len(order))
                low[held] = np.minimum(low[held], np.minimum.reduceat(values[order], first))
                high[held] = np.maximum(high[held], np.maximum.reduceat(values[order], first))
        held = np.flatnonzero(n)
        columns = [(held // nodes).astype(np.int32), (held % nodes).astype(np.int32), n[held], *low[held].T, *high[held].T]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["tree", "node", "n", *(f"{side}{f}" for side in ("low_", "high_") for f in FEATURES)])

    parts = rows.mapInArrow(run, EXTENT).groupBy("tree", "node")
    least = (F.min(f"low_{f}").alias(f"low_{f}") for f in FEATURES)
    largest = (F.max(f"high_{f}").alias(f"high_{f}") for f in FEATURES)
    found = parts.agg(F.sum("n").alias("n"), *least, *largest).orderBy("tree", "node").toArrow()  # at most as many as the forest has nodes
    shared.unpersist()
    return found


def grown(rows: DataFrame, count: int, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> IsolationForest:
    """A forest of all ``rows`` (spread, features), a level in each pass over them."""
    rng = np.random.default_rng(seed)
    shares = min(trees, -(-trees * subsample // count))
    m = min(subsample, count)
    depth = max(1, int(np.ceil(np.log2(max(m, 2)))))
    nodes = 2 ** (depth + 1) - 1
    forest = IsolationForest(np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes)), float(IsolationForest.usual_length(m)) or 1.0)
    whole = np.zeros(trees)
    for level in range(depth + 1):
        found = extents(rows, forest, shares)
        tree, node, n = (found.column(c).to_numpy() for c in ("tree", "node", "n"))
        low, high = (np.stack([found.column(f"{side}{f}").to_numpy() for f in FEATURES], axis=1) for side in ("low_", "high_"))
        if level == 0:
            whole[tree] = n
        for k in np.flatnonzero(node >= 2**level - 1):
            usable = np.flatnonzero(high[k] > low[k])
            own = n[k] * min(1.0, subsample / whole[tree[k]])
            if level == depth or own < 2 or not len(usable):
                forest.length[tree[k], node[k]] = level + IsolationForest.usual_length(max(own, 1.0))
                continue
            f = rng.choice(usable)
            forest.feature[tree[k], node[k]] = f
            forest.cut[tree[k], node[k]] = min(rng.uniform(low[k, f], high[k, f]), high[k, f])
    return forest


def calibrated(rows: DataFrame, forest: IsolationForest) -> IsolationForest:
    """The forest with its threshold, by the scores of all ``rows`` (label, features), counted by level."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(level_of(shared.value.score(features(batch)))), batch.column("label")], names=["level", "label"])

    good = F.col("label") == 1
    found = rows.mapInArrow(run, "level long, label int").groupBy("level").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")).orderBy("level").toArrow()  # at most LEVELS rows
    forest.calibrate_counts(*(found.column(c).to_numpy() for c in ("level", "good", "bad")))
    return forest


def fit(docs: DataFrame, labels: DataFrame) -> IsolationForest | None:
    """A forest grown and calibrated on all labelled documents; None without any.

    Of documents that share an id one counts, the one with the least statistics.
    Statistics come before the join, so that no text is shuffled.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                matrix = statistics(as_strings(part.column("text")))[1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, matrix.T)], names=["doc_id", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    every = docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{f} double" for f in FEATURES)]))
    found = every.join(known_labels(labels, "quality"), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct("label", *FEATURES)).alias("one"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(one.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("spread"), "one.*"))
    count = rows.count()
    forest = calibrated(rows.select("label", *FEATURES), grown(rows.select("spread", *FEATURES), count)) if count else None
    scratch.drop()
    return forest


def judge(docs: DataFrame, forest: IsolationForest | None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of ``FIELDS``, and that column's name."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def verdicts(texts: pa.StringArray) -> dict[str, np.ndarray]:
        base, matrix = statistics(texts)
        failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
        anomaly = np.zeros(len(texts)) if shared.value is None else shared.value.score(matrix)
        return base | {"base_failed": failed, "anomaly": anomaly, "kept": ~failed & (anomaly <= (np.inf if shared.value is None else shared.value.threshold))}

    return annotate(docs, verdicts, FIELDS)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: rule statistics and verdict of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    judged, name = judge(docs.select("doc_id", "text"), fit(docs, labels))
    return judged.select("doc_id", F.col(f"{name}.*"))

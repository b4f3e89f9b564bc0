"""Language-model scores by Brown class-based bigrams.

Tokens are the lower-cased words of a text and one end after them. Training
counts every token of every training document. Each of the ``LOOKUP`` most
frequent words has a class of its own choosing, and so has each of ``TAIL``
groups that all rarer and all unknown words fall into by their spelling.

Exchange clustering: bigrams of the ``HEAD`` most frequent words and the groups
are counted over the whole training corpus, a sparse table that stays
distributed. The ``CORE`` most frequent are clustered one after the other.
Then come rounds over all of them: Spark sums up how often each unit stands
beside each class, every unit of a round's part moves to the class that raises
the likelihood most, and the next round starts from the moves. The words
between HEAD and LOOKUP take the class that their neighbours' classes make
most likely, summed up over all their occurrences by Spark. Class bigrams and
the classes' sizes are counted over the corpus at last.

P(w | v) = P(class of w | class of v) P(w | class of w). Transitions are
smoothed with the classes' frequencies; within a class every known word counts
0.1 more, and all unknown words share one place of 0.1. The perplexity is that
of the score, a token.

Words' counts never meet in one place but for the LOOKUP most frequent, which
are broadcast. A rarer word's count joins its occurrences by its hash: such
words are no hot keys, as the frequent ones are gone. The driver holds a row
for each unit; the class matrices have a fixed size.

Defined results: a null or empty text is its end alone; repeated rows are
counted and scored once each; a row without an id is in no fold, hence in
training; without training documents all counts are 0; other columns are
ignored; an empty table gives no rows. Words of one count are ranked by their
bytes, so ties have one order. A very long text is held in one task with its
words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payspark.llm.arrowtext import LOWER, as_strings, data_of, mapped, offsets_of, owners, slices, sums_by_row, words_of
from payspark.llm.checkpoints import Scratch, saved
from payspark.llm.labelled import fold

CORE, HEAD, TAIL, CLASSES, SWEEPS = 511, 2048, 512, 64, 12
UNITS = 1 + HEAD + TAIL
#: Rounds over all units; one in PARTS of them moves in a round.
ROUNDS, PARTS = 9, 3
#: Words whose counts and classes are broadcast.
LOOKUP = 1 << 17
ADD = 0.1
#: Hash of words, as Spark's xxhash64.
SEED = 42


def lower_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct lower-case words, all words as numbers of these, and how many each text has."""
    flat, counts = words_of(mapped(texts, LOWER))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts


def spelling(words: pa.StringArray) -> np.ndarray:
    """The group of each word as a rare one, by its last three bytes."""
    data, ends = data_of(words), offsets_of(words)[1:]
    size = np.diff(offsets_of(words))
    last = np.zeros(len(words), np.uint64)
    for k in range(3):
        last |= np.where(size > k, data[np.maximum(ends - 1 - k, 0)] if len(data) else 0, 0).astype(np.uint64) << np.uint64(8 * k)
    return ((last * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TAIL.bit_length() + 1)).astype(np.int64)


def places_of(words: pa.StringArray, known: pa.StringArray) -> np.ndarray:
    """The place of each word among the known ones, or -1."""
    return pc.index_in(words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)


def units_of(words: pa.StringArray, head: pa.StringArray) -> np.ndarray:
    """The unit of each word: 0 is the end, which is the empty word here; then ``head``, then the groups."""
    place = places_of(words, head)
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    return np.where(empty, 0, np.where(place >= 0, 1 + place, 1 + HEAD + spelling(words)))


def with_ends(values: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The texts' values, each text's followed by ``end``."""
    out = np.full(len(values) + len(counts), end, values.dtype)
    out[np.arange(len(values)) + owners(counts)] = values
    return out


def before(values: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """What stands before each value of ``with_ends``; an end before a text's first."""
    out = np.roll(values, 1)
    out[np.cumsum(counts + 1) - counts - 1] = end
    return out


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def move_scores(table: np.ndarray, out: np.ndarray, into: np.ndarray, same: np.ndarray) -> np.ndarray:
    """How much the likelihood grows if a unit joins each class: for k units at once.

    ``table`` (k, classes, classes) are class bigrams without the unit, ``out``
    and ``into`` (k, classes) what follows and precedes it, ``same`` its pairs
    with itself.
    """
    rows, columns = table.sum(axis=2) + into, table.sum(axis=1) + out
    here = plogp(table)
    gain = plogp(table + out[:, None, :]) - here
    gain_in = plogp(table + into[:, :, None]) - here
    pick = lambda x: np.diagonal(x, axis1=1, axis2=2)
    total = gain.sum(axis=2) - pick(gain) + gain_in.sum(axis=1) - pick(gain_in)
    total += plogp(pick(table) + out + into + same[:, None]) - pick(here)
    leaving, coming = (out.sum(axis=1) + same)[:, None], (into.sum(axis=1) + same)[:, None]
    return total - (plogp(rows + leaving) - plogp(rows) + plogp(columns + coming) - plogp(columns))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of units by the exchange algorithm on their bigram counts; unit 0 stays alone in class 0.

    Units start in classes by frequency in turn. Each then moves, in order of
    frequency, to the class where the class bigrams' likelihood is highest.
    """
    n = bigrams.astype(np.float64)
    order = [u for u in np.argsort(-(n.sum(axis=0) + n.sum(axis=1)), kind="stable") if u]
    own = np.zeros(len(n), np.int64)
    own[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.eye(classes)[own]
    follow, precede = n @ member, n.T @ member
    table = member.T @ follow
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, same = own[u], n[u, u]
            out, into = follow[u].copy(), precede[u].copy()
            out[a] -= same
            into[a] -= same
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= same
            total = move_scores(table[None], out[None], into[None], np.array([same]))[0]
            b = 1 + int(np.argmax(total[1:]))
            if total[b] <= total[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += same
            if b != a:
                moved += 1
                own[u] = b
                follow[:, a] -= n[:, u]
                follow[:, b] += n[:, u]
                precede[:, a] -= n[u]
                precede[:, b] += n[u]
        if not moved:
            break
    return own


def likelihood(table: np.ndarray) -> float:
    return float(plogp(table).sum() - plogp(table.sum(axis=0)).sum() - plogp(table.sum(axis=1)).sum())


def best_moves(follow: np.ndarray, precede: np.ndarray, same: np.ndarray, own: np.ndarray, which: np.ndarray, step: int = 64) -> np.ndarray:
    """Classes after each of the units ``which`` has moved to its best class, all seen from the same start; -1 is no class yet."""
    classes = follow.shape[1]
    member = np.where(own[:, None] == np.arange(classes), 1.0, 0.0)
    table, after = member.T @ follow, own.copy()
    for at in range(0, len(which), step):
        u = which[at : at + step]
        mine = member[u]
        out, into = follow[u] - mine * same[u][:, None], precede[u] - mine * same[u][:, None]
        without = table - mine[:, :, None] * out[:, None, :] - into[:, :, None] * mine[:, None, :] - mine[:, :, None] * mine[:, None, :] * same[u][:, None, None]
        total = move_scores(np.maximum(without, 0), out, into, same[u])
        best = 1 + np.argmax(total[:, 1:], axis=1)
        row = np.arange(len(u))
        stays = (own[u] >= 0) & (total[row, best] <= total[row, np.maximum(own[u], 0)] + 1e-9)
        after[u] = np.where(stays, own[u], best)
    return after


def beside_classes(pairs: DataFrame, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit how often classes follow and precede it, and how often itself does; ``pairs`` (unit, other, side, n)
    has a unit's rows in one partition."""
    shared = pairs.sparkSession.sparkContext.broadcast(own)
    width = 2 * CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * width)
        for batch in batches:
            unit, other, side, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("unit", "other", "side", "n"))
            label = shared.value[other]
            seen = label >= 0
            np.add.at(total, unit[seen] * width + side[seen] * CLASSES + label[seen], n[seen])
            alone = (unit == other) & (side == 0)
            np.add.at(total, unit[alone] * width + width - 1, n[alone])
        rows = total.reshape(UNITS, width)
        full = np.flatnonzero(rows.any(axis=1))
        cells = pa.ListArray.from_arrays(pa.array((np.arange(len(full) + 1) * width).astype(np.int32)), pa.array(rows[full].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cells], names=["unit", "cells"])

    found = pairs.mapInArrow(run, "unit int, cells array<double>").toArrow()  # a row for each unit, of fixed size
    out = np.zeros((UNITS, width))
    for unit, cells in zip(found.column("unit").to_pylist(), found.column("cells")):
        out[unit] += np.asarray(cells.values)
    return out[:, :CLASSES], out[:, CLASSES:-1], out[:, -1]


def cluster(pairs: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units from ``pairs`` (unit, other, side, n), and how often classes follow each other."""
    core = pairs.where(f"side = 0 and unit <= {CORE} and other <= {CORE}").toArrow()
    dense = np.zeros((CORE + 1, CORE + 1), np.int64)
    dense[core.column("unit").to_numpy(), core.column("other").to_numpy()] = core.column("n").to_numpy()
    own = np.full(UNITS, -1)
    own[: CORE + 1] = exchange(dense)
    best, most, moved = (own, np.zeros((CLASSES, CLASSES))), -np.inf, []
    for k in range(rounds + 1):
        follow, precede, same = beside_classes(pairs, own)
        if (own >= 0).all():
            table = np.eye(CLASSES)[own].T @ follow
            if (now := likelihood(table)) > most:
                best, most = (own, table), now
            if len(moved) >= PARTS and sum(moved[-PARTS:]) * 200 < UNITS:
                break
        which = np.flatnonzero(own < 0) if k == 0 else np.arange(1 + (k - 1) % PARTS, UNITS, PARTS)
        after = best_moves(follow, precede, same, own, which)
        moved.append(int((after != own).sum()))
        own = after
    return best


@dataclass
class ClassModel:
    """Frequent words, their counts and classes, classes of groups, and log10 P(class | class before) less each class's size."""

    words: pa.StringArray
    counts: np.ndarray
    labels: np.ndarray
    groups: np.ndarray
    steps: np.ndarray | None = None
    train_tokens: int = 0
    base: float = 0.0

    def classes_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of words, and their places among the frequent ones, or -1; the empty word is the end."""
        place = places_of(words, self.words)
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        labels = np.append(self.labels, 0)  # for an empty list of words
        return np.where(empty, 0, np.where(place >= 0, labels[place], self.groups[spelling(words)])), place

    def settle(self, table: np.ndarray, kinds: np.ndarray) -> None:
        """Take class bigrams and the classes' numbers of words."""
        size = table.sum(axis=0)
        share = (size + ADD) / (size + ADD).sum()
        rows, different = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True) + 1
        self.steps = np.log10((table + different * share) / (rows + different)) - np.log10(size + ADD * (kinds + 1))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the tokens of ``docs``; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=16 << 20):
                words, codes, counts = lower_words(as_strings(part.column("text")))
                found = [pa.concat_arrays([words, pa.array([""])]), pa.array(np.append(np.bincount(codes, minlength=len(words)), len(counts)))]
                yield pa.RecordBatch.from_arrays(found, names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def unit_pairs(docs: DataFrame, head: pa.StringArray, steps: Scratch) -> DataFrame:
    """(unit, other, side, n): how often units stand beside each other in ``docs``, from both sides, a unit's rows in one partition."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=8 << 20):
                words, codes, counts = lower_words(as_strings(part.column("text")))
                unit = with_ends(units_of(words, shared.value)[codes], counts, 0)
                pair, n = runs_of(before(unit, counts, 0) * UNITS + unit)
                yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(n)], names=["pair", "n"])

    counted = steps.save(docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    ends = [F.floor(F.col("pair") / UNITS).cast("int"), F.pmod("pair", F.lit(UNITS)).cast("int")]
    sides = [counted.select(ends[k].alias("unit"), ends[1 - k].alias("other"), F.lit(k).alias("side"), "n") for k in (0, 1)]
    return steps.save(sides[0].unionByName(sides[1]).repartition("unit"))


def label_by_neighbours(docs: DataFrame, model: ClassModel, table: np.ndarray) -> np.ndarray:
    """Labels of the model's words, those from HEAD on newly chosen: the class under which all that stands beside a
    word is most likely, given class bigrams."""
    labels, width = model.labels.copy(), len(model.words) - HEAD
    if width <= 0:
        return labels
    size = table.sum(axis=0)
    share = (size + ADD) / (size + ADD).sum()
    step = np.log((table + share) / (table.sum(axis=1, keepdims=True) + 1))
    choice = ((step - np.log(size + ADD))[:, None, :] + step.T[None, :, :]).reshape(CLASSES * CLASSES, CLASSES)
    context = docs.sparkSession.sparkContext
    shared, weights = context.broadcast(model), context.broadcast(choice)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ClassModel = shared.value
        for batch in batches:
            for part in slices(batch, limit=8 << 20):
                words, codes, counts = lower_words(as_strings(part.column("text")))
                label, place = own.classes_of(words)
                label, place = with_ends(label[codes], counts, 0), with_ends(place[codes], counts, -1)
                beside = before(label, counts, 0) * CLASSES + np.append(label[1:], 0)
                key, n = runs_of((place * CLASSES * CLASSES + beside)[place >= HEAD])
                found = [(key // CLASSES**2 - HEAD).astype(np.int32), (key % CLASSES**2).astype(np.int32), n]
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["word", "beside", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, CLASSES)), np.zeros(width, bool)
        for batch in batches:
            word, beside, n = (batch.column(c).to_numpy() for c in ("word", "beside", "n"))
            order = np.argsort(word, kind="stable")
            own, first = np.unique(word[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(weights.value[beside[order]] * n[order][:, None], first, axis=0)
                seen[own] = True
        mine = np.flatnonzero(seen)
        label = 1 + np.argmax(total[mine][:, 1:], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), pa.array(label.astype(np.int32))], names=["word", "label"])

    beside = docs.select("text").mapInArrow(occurrences, "word int, beside int, n long").repartition("word")
    found = beside.mapInArrow(choose, "word int, label int").toArrow()
    labels[HEAD + found.column("word").to_numpy()] = found.column("label").to_numpy()
    return labels


def class_bigrams(docs: DataFrame, model: ClassModel) -> np.ndarray:
    """How often each class follows each in ``docs``, a matrix of fixed size, summed up by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for part in slices(batch):
                words, codes, counts = lower_words(as_strings(part.column("text")))
                label = with_ends(shared.value.classes_of(words)[0][codes], counts, 0)
                total += np.bincount(before(label, counts, 0) * CLASSES + label, minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["cell", "n"])

    return summed(docs.select("text").mapInArrow(run, "cell int, n long"), CLASSES * CLASSES).reshape(CLASSES, CLASSES)


def summed(cells: DataFrame, size: int) -> np.ndarray:
    """(cell, n) added up into an array of fixed size."""
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def words_by_class(counts: DataFrame, model: ClassModel) -> np.ndarray:
    """How many distinct words each class has."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            total += np.bincount(shared.value.classes_of(as_strings(batch.column("word")))[0], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(total)], names=["cell", "n"])

    return summed(counts.select("word").mapInArrow(run, "cell int, n long"), CLASSES)


def common_from(counts: DataFrame, limit: int = LOOKUP) -> int:
    """The least count from which on there are at most ``limit`` words, by a histogram of some hundred steps."""
    step = F.floor(16 * F.log2("n"))
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for row in found:
        total += row["words"]
        if total > limit:
            break
        least = row["least"]
    return least


def train(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model, and the (word, n) table of all training tokens."""
    steps = Scratch(docs.sparkSession)
    counts = saved(count_words(docs))
    total = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.where((F.col("word") != "") & (F.col("n") >= common_from(counts))).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, often = as_strings(top.column("word")), top.column("n").to_numpy()
    own, table = cluster(unit_pairs(docs, words.slice(0, HEAD), steps))
    groups = own[1 + HEAD :]
    labels = np.concatenate([own[1 : 1 + min(HEAD, len(words))], groups[spelling(words.slice(HEAD))]])
    model = ClassModel(words, often, labels, groups, train_tokens=int(total[0] or 0))
    if len(words) > HEAD:
        model = ClassModel(words, often, label_by_neighbours(docs, model, table), groups, train_tokens=model.train_tokens)
    model.base = float(np.log10(model.train_tokens + ADD * (int(total[1]) + 1)))
    model.settle(class_bigrams(docs, model), words_by_class(counts, model))
    steps.drop()
    return model, counts


def score(docs: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """(doc_id, flag, n_tokens, n_known, train_tokens, base_score, score, perplexity); ``docs`` has doc_id, text and a boolean flag."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ends = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = shared.value, TaskContext.get().partitionId() << 36
        known = np.log10(own.counts + ADD)
        for batch in batches:
            for part in slices(batch):
                words, codes, sizes = lower_words(as_strings(part.column("text")))
                label, place = own.classes_of(words)
                label = with_ends(label[codes], sizes, 0)
                steps = sums_by_row(own.steps[before(label, sizes, 0), label], sizes + 1)
                here = place[codes]
                logs = sums_by_row(np.where(here >= 0, known[here] if len(known) else 0.0, 0.0), sizes) + np.log10(ends + ADD)
                seen = sums_by_row((here >= 0).astype(np.int64), sizes) + (ends > 0)
                row = number + np.arange(part.num_rows)
                number += part.num_rows
                rare = np.sort((owners(sizes) * max(len(words), 1) + codes)[here < 0])
                first = np.flatnonzero(np.concatenate([[True], rare[1:] != rare[:-1]])) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rare)))
                code = rare[first] % max(len(words), 1)
                wanted = np.flatnonzero(place < 0)
                keys = np.zeros(len(words), np.int64)
                digest = xxhash.xxh64_intdigest
                keys[wanted] = np.fromiter((digest(w, SEED) for w in words.take(pa.array(wanted)).to_pylist()), np.uint64, len(wanted)).view(np.int64)
                kinds = {"doc_id": part.column("doc_id").cast(pa.int64()), "flag": part.column("flag")}
                kinds |= {n: pa.array(v) for n, v in (("n_tokens", sizes + 1), ("known", seen), ("logs", logs), ("steps", steps))}
                whole = pa.StructArray.from_arrays(list(kinds.values()), names=list(kinds))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(row), pa.array(np.zeros(len(row), np.int64)), whole], names=["key", "row", "times", "doc"])
                owner = row[rare[first] // max(len(words), 1)]
                rest = [pa.array(keys[code]), pa.array(owner), pa.array(times), pa.nulls(len(first), whole.type)]
                yield pa.RecordBatch.from_arrays(rest, names=["key", "row", "times", "doc"])

    schema = "key long, row long, times long, doc struct<doc_id long, flag boolean, n_tokens long, known long, logs double, steps double>"
    found = docs.select("doc_id", "text", "flag").mapInArrow(run, schema)
    joined = found.join(counts.select(F.xxhash64("word").alias("key"), "n"), "key", "left")
    logs = F.coalesce(F.sum("doc.logs"), F.lit(0.0)) + F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD))
    summed = joined.groupBy("row").agg(
        F.max("doc.doc_id").alias("doc_id"), F.max("doc.flag").alias("flag"), F.max("doc.n_tokens").alias("n_tokens"),
        (F.max("doc.known") + F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"), logs.alias("logs"), F.max("doc.steps").alias("steps"),
    )
    score = F.col("logs") + F.col("steps")
    return summed.select(
        "doc_id", "flag", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(model.base)).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: class-model scores of all documents, learnt from those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (fold("doc_id", 10) == 0).alias("flag"))
    model, counts = train(docs.where(~F.col("flag")))
    return score(docs, model, counts).withColumnRenamed("flag", "held_out")

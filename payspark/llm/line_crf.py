"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's potential depends on its own
features and those of its neighbours; a 2 x 2 matrix ties the states of
consecutive lines. The forward-backward algorithm gives each line's
probability of being good; their mean, weighted by line length, is the
document's share of good text, which a logistic curve turns into a score.

Training uses at most ``SAMPLE`` labelled documents, of each at most
``CHAINS`` runs of ``CHAIN`` lines, evenly spread. The driver holds 13 numbers
of four bytes for each of these lines, at most some 350 MB, and makes features
of them for ``PART`` lines at a time. Their label is given to all
their lines at first; then lines of bad documents that the field takes for
good are relabelled, and it is fitted again. The curve is fitted so that 0.7
is the best cut between the labels.

Scoring is a map over whole texts. Lines are cut into segments of ``SEGMENT``;
what a segment passes on from one end to the other is a 2 x 2 matrix, so the
messages between segments come first, and then all segments go through the
recursions side by side, ``BLOCK`` lines at a time. So neither time nor memory
grows with the longest text but in proportion, at some 40 bytes a line.

Defined results: a null or empty text is one empty line; repeated rows get the
same score each; without labelled rows every score is 0.5, and with one kind
of label alone every score is 0.95 or 0.05; the columns ``labels``, ``lang``,
``source`` and ``doc_id`` are never inputs; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payspark.llm.arrowtext import annotate, as_strings, distinct, owners, slices, strings_from, sums_by_row, words_of
from payspark.llm.labelled import fold, labelled_sample
from payspark.llm.rules import DIGIT, MARK, SYMBOLS, UPPER, per_text, rate

#: Labelled documents that the field is fitted on.
SAMPLE = 6_000
#: Of a training document at most so many runs of so many lines are used; scoring uses whole texts.
CHAINS, CHAIN = 4, 256
#: Lines of training documents whose features are held at once.
PART = 1 << 18
#: A line's own features, and all of them: those of its neighbours, both ends of a text and a constant.
OWN, ALL = 13, 42
#: Lines of a segment, and lines whose features are held at once.
SEGMENT, BLOCK = 512, 1 << 16
#: ``predicted`` is 1 from this score on.
CUT = 0.7
STOP = np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8))
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def lines_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    lists = pc.split_pattern(texts, "\n")
    return lists.flatten(), np.diff(lists.offsets.to_numpy().astype(np.int64))


def repeated_lines(lines: pa.StringArray, counts: np.ndarray) -> np.ndarray:
    """Whether each line's text had the same line before."""
    coded = lines.dictionary_encode()
    code, kinds = coded.indices.to_numpy(), max(len(coded.dictionary), 1)
    first = np.zeros(len(lines), bool)
    long = counts > BLOCK
    for end, size in zip(np.cumsum(counts)[long].tolist(), counts[long].tolist()):
        place = np.full(kinds, -1)
        place[code[end - size : end][::-1]] = np.arange(end - 1, end - size - 1, -1)  # the last one written is the first
        first[place[place >= 0]] = True
    rest = np.flatnonzero(~np.repeat(long, counts))
    first[rest[np.unique(owners(counts)[rest] * kinds + code[rest], return_index=True)[1]]] = True
    return ~first


def own_features(lines: pa.StringArray, repeated: np.ndarray) -> np.ndarray:
    """Features of each line by itself, and whether its text had it before."""
    size = pc.binary_length(lines).to_numpy().astype(np.int64)
    flat, words = words_of(lines)
    codes = flat.dictionary_encode()
    code, row, kinds = codes.indices.to_numpy().astype(np.int64), owners(words), max(len(codes.dictionary), 1)
    different = np.bincount(distinct(row * kinds + code) // kinds, minlength=len(lines))
    again = sums_by_row(np.concatenate([[False], (code[1:] == code[:-1]) & (row[1:] == row[:-1])])[: len(code)].astype(np.int64), words)
    bars = sums_by_row(pc.equal(flat, "|").to_numpy(zero_copy_only=False).astype(np.int64), words)
    symbols = per_text(SYMBOLS, lines)
    return np.stack([
        np.sqrt(rate(symbols, size)), np.sqrt(rate(per_text(MARK, lines), size)), np.sqrt(rate(per_text(UPPER, lines), size)), np.sqrt(rate(per_text(DIGIT, lines), size)),
        np.sqrt(rate(per_text(STOP, lines), size)), rate(again, words), rate(different, words), rate(bars, words), repeated & (words > 0),
        np.minimum(rate(size, words), 30) / 10, np.log1p(words) / 5, words == 0, symbols > 0,
    ], axis=1).astype(np.float64)


def ends_of_texts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are the first, and the last, of their text."""
    ends = np.cumsum(counts)
    head, tail = np.zeros(counts.sum(), bool), np.zeros(counts.sum(), bool)
    head[(ends - counts)[counts > 0]] = tail[ends[counts > 0] - 1] = True
    return head, tail


def feature_blocks(lines: pa.StringArray, counts: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """Features of the lines, ``block`` of them at a time, and where they begin: own features, those of the line
    before and after (0 beyond the text), place and a constant."""
    repeated = repeated_lines(lines, counts)
    head, tail = ends_of_texts(counts)
    for at in range(0, len(lines), block):
        stop = min(at + block, len(lines))
        low, high = max(at - 1, 0), min(stop + 1, len(lines))
        own = own_features(lines.slice(low, high - low), repeated[low:high])
        own = np.concatenate([own[:0] if low < at else np.zeros((1, own.shape[1])), own, own[:0] if high > stop else np.zeros((1, own.shape[1]))])
        yield at, with_neighbours(own, head[at:stop], tail[at:stop])


def with_neighbours(own: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """All features of lines from their own ones, which begin with a line before these and end with one after."""
    before, after = own[:-2].copy(), own[2:].copy()
    before[head], after[tail] = 0, 0
    return np.concatenate([own[1:-1], before, after, head[:, None], tail[:, None], np.ones((len(head), 1))], axis=1)


def line_features(lines: pa.StringArray, counts: np.ndarray) -> np.ndarray:
    """All features at once, for few lines."""
    return np.concatenate([x for _, x in feature_blocks(lines, counts)]) if len(lines) else np.zeros((0, ALL))


def potentials(odds: np.ndarray) -> np.ndarray:
    """Potentials (bad, good) of lines by their log odds of being good, the larger one 1."""
    odds = np.clip(odds, -30, 30)
    return np.stack([np.exp(-np.maximum(odds, 0)), np.exp(np.minimum(odds, 0))], axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row, or matrix, with the sum 1."""
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


@dataclass
class LineField:
    """``weights`` of a line's log odds of being good, ``links`` between states, ``start`` potentials, and the curve."""

    weights: np.ndarray
    links: np.ndarray
    start: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By forward-backward: each line's probabilities (bad, good), expected transitions and starts."""
        odds = np.clip(features @ self.weights, -30, 30)
        local = np.stack([np.exp(-np.maximum(odds, 0)), np.exp(np.minimum(odds, 0))], axis=1)
        link, begin = np.exp(self.links), np.exp(self.start)
        order = np.argsort(-counts, kind="stable")
        first, sizes = (np.cumsum(counts) - counts)[order], counts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        forward, backward = np.empty_like(local), np.ones_like(local)
        for t in range(longest):
            at = first[: active[t]] + t
            step = local[at] * (begin if t == 0 else forward[at - 1] @ link)
            forward[at] = step / step.sum(axis=1, keepdims=True)
        moves = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t
            ahead = local[at + 1] * backward[at + 1]
            joint = forward[at][:, :, None] * link * ahead[:, None, :]
            moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = ahead @ link.T
            backward[at] = back / back.sum(axis=1, keepdims=True)
        good = forward * backward
        good /= good.sum(axis=1, keepdims=True)
        return good, moves, good[first[sizes > 0]].sum(axis=0)

    @classmethod
    def fit(cls, features: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> LineField:
        """Maximise the conditional likelihood of the lines' states by Adam steps on the exact gradient."""
        return cls.fit_parts(lambda: [(features, counts)], features.shape[1], good, rounds, decay)

    @classmethod
    def fit_parts(cls, parts: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]], width: int, good: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> LineField:
        """The same with features and counts part by part, each of whole chains, read once a round."""
        field = cls(np.zeros(width), np.zeros((2, 2)), np.zeros(2))
        state, n = good.astype(int), max(len(good), 1)
        theta, mean, square = np.zeros(width + 6), 0.0, 0.0
        for k in range(1, rounds + 1):
            slope, done = np.zeros(width + 6), 0
            for features, counts in parts():
                slope += field.slope_of(features, counts, state[done : done + len(features)])
                done += len(features)
            slope = slope / n - decay * theta
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            theta = theta + 0.15 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
            field.weights, field.links, field.start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        return field

    def slope_of(self, features: np.ndarray, counts: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The gradient of these chains' log likelihood by weights, links and starts."""
        begins = (np.cumsum(counts) - counts)[counts > 0]
        inner = np.ones(len(state), bool)
        inner[begins] = False
        at = np.flatnonzero(inner)
        seen = np.bincount(2 * state[at - 1] + state[at], minlength=4)
        p, moves, starts = self.marginals(features, counts)
        return np.concatenate([features.T @ (state - p[:, 1]), seen - moves.ravel(), np.bincount(state[begins], minlength=2) - starts])

    def messages(self, odds: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What comes into each segment from the lines before, and from those after it.

        A segment's lines make one matrix, from the state before it to the
        state of its last line; ``opens`` marks the first segment of a text.
        """
        link, begin = np.exp(self.links), np.exp(self.start)
        closes = np.append(opens[1:], True)[: len(opens)]
        into, back = np.ones((len(starts), 2)), np.ones((len(starts), 2))
        passed = np.flatnonzero(~(opens & closes))
        matrix = np.broadcast_to(np.eye(2), (len(passed), 2, 2)).copy()
        for at in range(0, len(passed), 4096):
            own = passed[at : at + 4096]
            for t in range(int(sizes[own].max())):
                some = np.flatnonzero(sizes[own] > t)
                local = potentials(odds[starts[own[some]] + t])
                first = (opens[own[some]] & (t == 0))[:, None, None]
                matrix[at + some] = scaled(np.where(first, matrix[at + some] * begin, matrix[at + some] @ link) * local[:, None, :])
        texts = np.cumsum(opens)[passed] if len(passed) else passed
        number = np.arange(len(passed)) - np.searchsorted(texts, texts)
        count = np.bincount(texts)[texts] if len(passed) else passed
        for k in range(1, int(count.max(initial=0))):
            own = np.flatnonzero(number == k)
            before = own - 1
            state = np.where(opens[passed[before]][:, None], matrix[before].sum(axis=1), np.einsum("ni,nij->nj", into[passed[before]], matrix[before]))
            into[passed[own]] = scaled(state)
            last = np.flatnonzero(number == count - 1 - k)
            back[passed[last]] = scaled(np.einsum("nij,nj->ni", matrix[last + 1], back[passed[last + 1]]))
        return into, back

    def segment_marginals(self, odds: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opens: np.ndarray, into: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Each line's probability of being good, for segments whose lines follow each other from the first start on."""
        link, begin = np.exp(self.links), np.exp(self.start)
        low, longest = int(starts[0]), int(sizes.max())
        local = potentials(odds[low : int(starts[-1] + sizes[-1])])
        forward, backward = np.ones_like(local), np.ones_like(local)
        for t in range(longest):
            some = np.flatnonzero(sizes > t)
            at = starts[some] - low + t
            came = np.where(opens[some][:, None], begin, into[some] @ link) if t == 0 else forward[at - 1] @ link
            forward[at] = scaled(local[at] * came)
        for t in range(longest - 1, -1, -1):
            some = np.flatnonzero(sizes > t)
            at = starts[some] - low + t
            ends = sizes[some] - 1 == t
            ahead = np.minimum(at + 1, len(local) - 1)
            backward[at] = np.where(ends[:, None], back[some], scaled((local[ahead] * backward[ahead]) @ link.T))
        return scaled(forward * backward)[:, 1]

    def share(self, texts: pa.StringArray) -> np.ndarray:
        """The length-weighted mean of the lines' probabilities of being good."""
        lines, counts = lines_of(texts)
        odds = np.empty(len(lines))
        for at, x in feature_blocks(lines, counts):
            odds[at : at + len(x)] = x @ self.weights
        parts = -(-counts // SEGMENT)
        text = owners(parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = (np.cumsum(counts) - counts)[text] + number * SEGMENT
        sizes, opens = np.minimum(counts[text] - number * SEGMENT, SEGMENT), number == 0
        into, back = self.messages(odds, starts, sizes, opens)
        good, whole = np.zeros(len(texts)), np.zeros(len(texts))
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(starts + sizes, starts[at] + 4 * BLOCK, side="right")))
            cut = slice(at, stop)
            p = self.segment_marginals(odds, starts[cut], sizes[cut], opens[cut], into[cut], back[cut])
            weight = pc.utf8_length(lines.slice(int(starts[at]), len(p))).to_numpy().astype(np.float64) + 1
            np.add.at(good, text[cut], sums_by_row(p * weight, sizes[cut]))
            np.add.at(whole, text[cut], sums_by_row(weight, sizes[cut]))
            at = stop
        return good / whole

    def score(self, share: np.ndarray) -> np.ndarray:
        p = np.clip(share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(p / (1 - p)) + self.shift, -30, 30)))

    def calibrate(self, share: np.ndarray, good: np.ndarray) -> None:
        """Fit the curve, then move it so that the best cut between the labels has the score CUT."""
        p = np.clip(share, 1e-6, 1 - 1e-6)
        x = np.log(p / (1 - p))
        design, beta = np.stack([x, np.ones(len(x))], axis=1), np.array([0.5, 0.0])
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            beta += np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (good - q) - 1e-3 * beta)
        order = np.argsort(x, kind="stable")
        right = np.concatenate([[0], np.cumsum(~good[order])]) + np.concatenate([np.cumsum(good[order][::-1])[::-1], [0]])
        cuts = np.concatenate([[x[order[0]] - 1], (x[order][1:] + x[order][:-1]) / 2, [x[order[-1]] + 1]])
        best = float(np.mean(cuts[right == right.max()]))
        self.slope = max(float(beta[0]), 0.05)
        self.shift = float(np.log(CUT / (1 - CUT)) - self.slope * best)


def chains_of(counts: np.ndarray) -> np.ndarray:
    """Counts of lines cut into chains of at most CHAIN."""
    chains = -(-counts // CHAIN)
    number = np.arange(chains.sum()) - np.repeat(np.cumsum(chains) - chains, chains)
    return np.minimum(np.repeat(counts, chains) - number * CHAIN, CHAIN)


class Sample:
    """Lines of training documents: their own features, which of them count, and how many each document has.

    Beside the lines that count there are those next to them, so that what lies
    before and after a line is known. Documents are read in the order of
    ``order``.
    """

    def __init__(self, own: np.ndarray, used: np.ndarray, stored: np.ndarray, order: np.ndarray):
        self.own, self.used, self.stored, self.order = own, used, stored, order
        self.begins = np.cumsum(stored) - stored
        self.counts = sums_by_row(used.astype(np.int64), stored)[order]
        self.held: list[np.ndarray] | None = None

    def lines(self, docs: np.ndarray) -> np.ndarray:
        """Where the lines of some documents are."""
        size = self.stored[docs]
        return np.repeat(self.begins[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def cuts(self, part: int) -> list[np.ndarray]:
        """The documents in order, at most ``part`` lines at a time or one document."""
        size = np.cumsum(self.stored[self.order])
        return np.split(self.order, np.flatnonzero(np.diff((size - 1) // part)) + 1) if len(self.order) else []

    def features(self, part: int) -> Iterator[np.ndarray]:
        """Features of the lines that count, part by part; kept where there is one part alone."""
        cuts = self.cuts(part)
        if self.held is None or len(cuts) > 1:
            made = (self.features_of(docs) for docs in cuts)
            if len(cuts) > 1:
                yield from made
                return
            self.held = list(made)
        yield from self.held

    def features_of(self, docs: np.ndarray) -> np.ndarray:
        at, edge = self.lines(docs), np.zeros((1, OWN))
        head, tail = ends_of_texts(self.stored[docs])
        return with_neighbours(np.concatenate([edge, self.own[at], edge]), head, tail)[self.used[at]]

    def parts(self, chained: bool, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Features, and counts by chain or by document."""
        done = 0
        for docs, x in zip(self.cuts(part), self.features(part)):
            counts = self.counts[done : done + len(docs)]
            done += len(docs)
            yield x, chains_of(counts) if chained else counts


def train(sample: Sample, sizes: np.ndarray, good: np.ndarray, part: int = PART) -> LineField:
    """A field from the documents' lines, line lengths and labels, all in the sample's order."""
    if good.all() or not good.any():
        fixed = LineField(np.zeros(ALL), np.zeros((2, 2)), np.zeros(2), 0.0)
        fixed.shift = float(np.log(19) if good.all() else -np.log(19))
        return fixed

    def probable(chained: bool) -> np.ndarray:
        return np.concatenate([field.marginals(x, counts)[0][:, 1] for x, counts in sample.parts(chained, part)])

    state, bad = np.repeat(good, sample.counts), np.repeat(~good, sample.counts)
    field = LineField.fit_parts(lambda: sample.parts(True, part), ALL, state)
    state = state | (bad & (probable(True) > 0.5))
    field = LineField.fit_parts(lambda: sample.parts(True, part), ALL, state)
    p, weight = probable(False), sizes.astype(np.float64) + 1
    field.calibrate(sums_by_row(p * weight, sample.counts) / sums_by_row(weight, sample.counts), good)
    return field


def chosen_lines(counts: np.ndarray) -> np.ndarray:
    """The lines of each text that training uses: all, or CHAINS runs of CHAIN lines, evenly spread."""
    out = np.ones(counts.sum(), bool)
    ends = np.cumsum(counts)
    for k in np.flatnonzero(counts > CHAINS * CHAIN).tolist():
        begins = np.linspace(0, counts[k] - CHAIN, CHAINS).astype(int)
        out[ends[k] - counts[k] : ends[k]] = False
        for a in (ends[k] - counts[k] + begins).tolist():
            out[a : a + CHAIN] = True
    return out


def training_lines(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Own features of the chosen lines and those next to them, which are chosen, their lengths, and how many each text has."""
    lines, counts = lines_of(texts)
    chosen, (head, tail) = chosen_lines(counts), ends_of_texts(counts)
    near = chosen.copy()
    near[1:] |= chosen[:-1] & ~head[1:]
    near[:-1] |= chosen[1:] & ~tail[:-1]
    own = [f[near[at : at + len(f)], :OWN].astype(np.float32) for at, f in feature_blocks(lines, counts)]
    return np.concatenate(own), chosen[near], pc.utf8_length(lines.filter(pa.array(near))), sums_by_row(near.astype(np.int64), counts)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, held_out: int = 2) -> LineField | None:
    """Learn from at most ``limit`` labelled documents outside the held-out fold; None without any."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                own, used, size, stored = training_lines(as_strings(part.column("text")))
                ends = np.concatenate([[0], np.cumsum(stored)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("label"), pa.ListArray.from_arrays(pa.array(ends * np.int32(OWN)), pa.array(own.ravel())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(used)), pa.ListArray.from_arrays(pa.array(ends), size),
                ], names=["label", "own", "used", "size"])

    sample = labelled_sample(docs, labels, "quality", limit, fold("doc_id", 4) != held_out)
    found = sample.mapInArrow(run, "label int, own array<float>, used array<boolean>, size array<int>").toArrow().combine_chunks()
    if not found.num_rows:
        return None
    own, used, size = (pc.list_flatten(found.column(c)).to_numpy() for c in ("own", "used", "size"))
    own, stored, good = own.reshape(-1, OWN), pc.list_value_length(found.column("size")).to_numpy(), found.column("label").to_numpy() == 1
    ends = np.cumsum(stored)
    counts = sums_by_row(used.astype(np.int64), stored)
    keys = [(count, xxhash.xxh3_128_digest(np.ascontiguousarray(own[e - n : e])), label) for count, e, n, label in zip(counts.tolist(), ends.tolist(), stored.tolist(), good.tolist())]
    learnt = Sample(own, used, stored.astype(np.int64), np.array(sorted(range(len(keys)), key=keys.__getitem__)))
    at = learnt.lines(learnt.order)
    return train(learnt, size[at][used[at]], good[learnt.order])


def score_documents(docs: DataFrame, field: LineField | None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of ``FIELDS``, and that column's name."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def scores(texts: pa.StringArray) -> dict[str, np.ndarray]:
        own = shared.value
        score = np.full(len(texts), 0.5) if own is None else own.score(own.share(texts))
        return {"score": score, "predicted": (score >= CUT).astype(np.int32)}

    return annotate(docs, scores, FIELDS)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes for good, with the columns they had."""
    field = fit(docs, labels)
    if field is None:
        return docs
    scored, name = score_documents(docs, field)
    return scored.where(F.col(f"{name}.predicted") == 1).select(*docs.columns)


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: the quality score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored, name = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col(f"{name}.*"))

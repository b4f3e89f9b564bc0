"""Class bigrams: base scores against brute force, exchange, probabilities that sum to one."""

import collections
import math
import re
import zlib

import numpy as np

from payspark.llm import brown_lm as B


def test_exchange_separates_classes():
    rng = np.random.default_rng(8)
    counts = np.zeros((41, 41), np.int64)
    for _ in range(8000):  # units 1-20 are followed by 21-40 and the other way round
        a = rng.integers(1, 41)
        counts[a, rng.integers(21, 41) if a <= 20 else rng.integers(1, 21)] += 1
    own = B.exchange(counts, classes=3)
    assert own[0] == 0 and len(set(own[1:21])) == 1 and len(set(own[21:])) == 1 and own[1] != own[21]


def test_moves_at_once_are_those_of_single_moves():
    rng = np.random.default_rng(4)
    n = rng.poisson(9.0, (31, 31)).astype(float)
    own = np.concatenate([[0], rng.integers(1, 5, 29), [-1]])
    member = np.where(own[:, None] == np.arange(5), 1.0, 0.0)

    def value(labels):
        m = np.where(labels[:, None] == np.arange(5), 1.0, 0.0)
        return B.likelihood(m.T @ n @ m)

    after = B.best_moves(n @ member, n.T @ member, np.diagonal(n), own, np.arange(1, 31), step=7)
    for u in range(1, 31):
        worth = {c: value(np.where(np.arange(31) == u, c, own)) for c in range(1, 5)}
        assert math.isclose(worth[after[u]], max(worth.values()), rel_tol=1e-12)


def test_transitions_and_emissions_sum_to_one():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    table, kinds = rng.integers(0, 5, (B.CLASSES, B.CLASSES)), rng.integers(1, 4, B.CLASSES)
    model = B.ClassModel(pa.array(["a"]), np.array([3]), np.array([1]), np.ones(B.TAIL, np.int64))
    model.settle(table, kinds)
    mass = table.sum(axis=0) + B.ADD * (kinds + 1)  # of all words of a class: each count and 0.1, and 0.1 for unknown words
    assert np.allclose((10**model.steps * mass).sum(axis=1), 1)


def test_words_take_the_class_of_their_neighbours(spark):
    rng = np.random.default_rng(2)
    size = B.HEAD // 2 + 60
    weight = 1 / (50 + np.arange(size))
    drawn = rng.choice(size, (4000, 60), p=weight / weight.sum())
    texts = [" ".join(f"{'ab'[k % 2]}{w}" for k, w in enumerate(row)) for row in drawn.tolist()]
    model, _ = B.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    words = np.array(model.words.to_pylist())
    assert len(words) > B.HEAD + 50
    kinds = [np.array([w[0] == kind for w in words]) for kind in "ab"]
    often = np.arange(len(words)) < B.HEAD
    of_a = np.bincount(model.labels[kinds[0] & often], minlength=B.CLASSES) > np.bincount(model.labels[kinds[1] & often], minlength=B.CLASSES)
    assert (of_a[model.labels[often]] == kinds[0][often]).mean() > 0.97
    assert (of_a[model.labels[~often]] == kinds[0][~often]).mean() > 0.97


def test_scores(spark):
    rng = np.random.default_rng(10)
    texts = [" ".join(rng.choice(["The", "the", "of", "Ändern", "x1", "zwölf"], 30)) + f" rare{k % 7}" for k in range(80)]
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    rows += [(500, "", 1), (501, None, 1), (502, "unseen words only", 1), (None, "null id", 1), (503, "w " * 20_000, 1)]
    twice = next(k for k in range(504, 700) if zlib.crc32(str(k).encode()) % 10 == 0)  # held out, so it isn't counted
    rows += [(twice, "a row that comes the of twice", 1)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    from pyspark.sql import functions as F

    docs = table.select("doc_id", "text", (B.fold("doc_id", 10) == 0).alias("flag"))
    model, counts = B.train(docs.where(~F.col("flag")))
    scored = B.score(docs, model, counts).collect()
    found = {r.doc_id: r for r in scored}
    assert len(scored) == len(rows) == len(found) + 1 and len({tuple(r) for r in scored if r.doc_id == twice}) == 1
    token = {k: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for k, t, _ in rows}
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k in token}
    count = collections.Counter(w for k, ws in token.items() if not held[k] for w in ws)
    n, v = sum(count.values()), len(count)

    import pyarrow as pa

    kinds = sorted({w or "" for ws in token.values() for w in ws})
    label = dict(zip(kinds, model.classes_of(pa.array(kinds))[0].tolist()))
    moves = collections.Counter((label[a or ""], label[b or ""]) for k, ws in token.items() if not held[k] for a, b in zip([None, *ws], ws))
    size = collections.Counter(label[w or ""] for k, ws in token.items() if not held[k] for w in ws)
    words = collections.Counter(label[w or ""] for w in count)

    def plain_score(ws):
        """Class bigrams, counted one by one."""
        total = 0.0
        for a, b in zip([None, *ws], ws):
            ca, cb = label[a or ""], label[b or ""]
            after = {c: m for (x, c), m in moves.items() if x == ca}
            share = (size[cb] + 0.1) / (n + 0.1 * B.CLASSES)
            total += math.log10((after.get(cb, 0) + (len(after) + 1) * share) / (sum(after.values()) + len(after) + 1))
            total += math.log10((count[b] + 0.1) / (size[cb] + 0.1 * (words[cb] + 1)))
        return total

    for k, ws in token.items():
        r = found[k]
        assert (r.flag, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, plain_score(ws), abs_tol=1e-6)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
    assert B.score(docs.limit(0), model, counts).count() == 0
    empty, none = B.train(docs.limit(0))
    assert {r.n_known for r in B.score(docs, empty, none).collect()} == {0}


def test_common_from(spark):
    counts = spark.createDataFrame([(f"w{k}", 1 + k // 10) for k in range(1000)], "word string, n long")
    least = B.common_from(counts, 100)
    assert 0 < counts.where(f"n >= {least}").count() <= 100 and B.common_from(counts, 5000) == 1

"""Rule statistics against brute force, forest and threshold."""

import collections
import re

import numpy as np
import pyarrow as pa

from payspark.llm import rules as R

TEXTS = ["", None, "a b", "x x x x x x", "a b c d e a b c d e", "Eins\nzwei\nEins\n\n \nEins", "# * $ % & | < >", "é ü\x0bß\x0cz\rq", "no\xa0break one\x1ctwo", "w " * 3000]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, again = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)]


def test_statistics():
    base, matrix = R.statistics(pa.array([t or "" for t in TEXTS]))
    assert np.stack([base[c] for c in R.BASE], axis=1).tolist() == [brute(t) for t in TEXTS]
    assert np.isfinite(matrix).all()


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (10, 3))])
    forest = R.IsolationForest.grow(rows)
    score = forest.score(rows)
    assert score[500:].min() > np.median(score[:500])
    good = np.arange(510) < 500
    forest.calibrate(score, good)
    kept = score <= forest.threshold
    assert kept[good].mean() >= R.KEEP_GOOD - 0.01 and kept[~good].mean() < 0.5


def plain_score(forest, row):
    """One row walked down every tree by itself."""
    total = 0.0
    for feature, cut, length in zip(forest.feature, forest.cut, forest.length):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + (1 if row[feature[node]] < cut[node] else 2)
        total += length[node]
    return 2 ** (-total / len(forest.feature) / forest.norm)


def test_judge(spark):
    good = [(k, " ".join(f"word{k}x{i}" for i in range(40)), "c") for k in range(60)]
    bad = [(100 + k, " ".join(f"w{i}#$%&***" for i in range(40 + k)), "c") for k in range(8)]
    odd = [(900 + k, t, "c") for k, t in enumerate(TEXTS)] + [(None, "null id", "c"), (1, good[1][1], "c")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, result string").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(8)] + [(5, None, 0), (None, 1, 0), (10**6, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    judged, name = R.judge(docs, R.fit(docs, labels))
    assert name == "result_" and judged.count() == docs.count()
    rows = {r.doc_id: r[name] for r in judged.collect()}
    assert np.mean([rows[k].kept for k in range(60)]) >= 0.95 and np.mean([rows[100 + k].kept for k in range(8)]) <= 0.3
    for k, t in enumerate(TEXTS):
        assert [rows[900 + k][c] for c in R.BASE] == brute(t)
    assert rows[900].base_failed and not rows[900].kept and rows[None].n_words == 2
    forest = R.fit(docs, labels)
    assert forest.threshold < np.inf
    for r in judged.collect():
        base, matrix = R.statistics(pa.array([r.text or ""]))
        score = plain_score(forest, matrix[0])
        failed = base["n_words"][0] < 10 or 100 * base["n_repeat_words"][0] > 20 * base["n_words"][0]
        assert np.isclose(r[name].anomaly, score) and r[name].kept == (not failed and score <= forest.threshold)
    nothing, name = R.judge(docs, R.fit(docs, labels.limit(0)))
    assert all(r[name].kept != r[name].base_failed for r in nothing.collect())
    assert R.judge(docs.limit(0), None)[0].count() == 0


def test_all_labelled_rows_count(spark, monkeypatch):
    """No row is left out: each is in a tree, and the last one's statistics and label show."""
    spread = np.arange(5000) * 7919
    for shares in (1, 3, 100):
        trees = R.trees_of(spread, shares, 100)
        assert trees.shape == (5000, shares) and all(len(set(t)) == shares for t in trees[:50].tolist())
    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, (900, R.WIDTH))
    rows = spark.createDataFrame([(int(k), *map(float, v)) for k, v in enumerate(values)], ", ".join(["spread long", *(f"{f} double" for f in R.FEATURES)])).repartition(3)
    forest = R.grown(rows, 900, trees=4, subsample=16)
    leaves = R.extents(rows, forest, 1)
    assert sum(leaves.column("n").to_pylist()) == 900
    inner = {(int(t), int(n)) for t, n in zip(*np.nonzero(forest.feature >= 0))}
    assert inner and not inner & {(t, n) for t, n in zip(leaves.column("tree").to_pylist(), leaves.column("node").to_pylist())}
    for tree in range(4):
        own = values[np.arange(900) % 4 == tree]
        f = forest.feature[tree, 0]
        assert own[:, f].min() <= forest.cut[tree, 0] <= own[:, f].max()
    score = forest.score(values)
    good = score < np.quantile(score, 0.9)
    labelled = spark.createDataFrame([(int(g), *map(float, v)) for g, v in zip(good, values)], ", ".join(["label int", *(f"{f} double" for f in R.FEATURES)]))
    assert R.calibrated(labelled, forest).threshold == np.ceil(score[good].max() * R.LEVELS) / R.LEVELS

"""The line field: marginals against enumeration, held-out accuracy, edge cases."""

import itertools
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

from payspark.llm import line_crf as L


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    features, counts = rng.normal(size=(7, 3)), np.array([4, 1, 2])
    field = L.LineField(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    good, moves, _ = field.marginals(features, counts)
    start, total = 0, np.zeros((2, 2))
    for n in counts:
        odds = features[start : start + n] @ field.weights
        weight, seen, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(field.start[states[0]] + sum(o for o, s in zip(odds, states) if s) + sum(field.links[a, b] for a, b in zip(states, states[1:])))
            weight += w
            seen += w * np.array(states)
            for a, b in zip(states, states[1:]):
                pairs[a, b] += w
        assert np.allclose(good[start : start + n, 1], seen / weight)
        total += pairs / weight
        start += n
    assert np.allclose(moves, total)


def test_segments_equal_whole_chains(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["\n".join(rng.choice(["", "a b", "a b", "$$ !", "Long line of words."], n)) for n in (1, 30, 7, 8, 9, 64, 65, 3)] + ["", "\n\n"]
    lines, counts = L.lines_of(pa.array(texts))
    features = L.line_features(lines, counts)
    field = L.LineField(rng.normal(size=42), rng.normal(size=(2, 2)), rng.normal(size=2))
    p, weight = field.marginals(features, counts)[0][:, 1], np.array([len(x) + 1 for t in texts for x in t.split("\n")])
    want = [np.average(x, weights=w) for x, w in zip(np.split(p, np.cumsum(counts)[:-1]), np.split(weight, np.cumsum(counts)[:-1]))]
    for segment, block in ((512, 1 << 16), (8, 5), (1, 1), (3, 100)):
        monkeypatch.setattr(L, "SEGMENT", segment)
        monkeypatch.setattr(L, "BLOCK", block)
        monkeypatch.setattr(L.feature_blocks, "__defaults__", (block,))
        assert np.allclose(field.share(pa.array(texts)), want)
        assert np.allclose(L.line_features(lines, counts), features)


def test_many_line_ends_in_bounded_memory():
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from payspark.llm import line_crf as L
rng = np.random.default_rng(1)
field = L.LineField(rng.normal(size=42), rng.normal(size=(2, 2)), rng.normal(size=2))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert 0 < field.share(pa.array([chr(10) * 20_000_000]))[0] < 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env={**os.environ, "PYTHONPATH": root}, check=True)
    assert int(found.stdout) < 1_000_000  # KB


def test_chosen_lines_are_bounded():
    chosen = L.chosen_lines(np.array([3, 5000, 1024, 1025]))
    parts = np.split(chosen, np.cumsum([3, 5000, 1024, 1025])[:-1])
    assert parts[0].all() and parts[1].sum() == 1024 and parts[1][0] and parts[1][-1] and parts[2].all() and parts[3].sum() <= 1024


def test_gradient_raises_likelihood():
    rng = np.random.default_rng(3)
    good = rng.random(400) < 0.5
    features = np.stack([good + rng.normal(0, 0.5, 400), np.ones(400)], axis=1)
    field = L.LineField.fit(features, np.full(40, 10), good)
    assert ((field.marginals(features, np.full(40, 10))[0][:, 1] > 0.5) == good).mean() > 0.8


def texts():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    good = ["\n".join(" ".join(word() for _ in range(9)) + "." for _ in range(6)) for _ in range(150)]
    bad = ["\n".join(" ".join(word() + "$$%%" for _ in range(9)) for _ in range(6)) for _ in range(60)]
    return good, bad


def test_training_lines_in_parts():
    """Features made from the few numbers that the driver holds are those of the whole texts, however they are cut."""
    good, bad = texts()
    own = [*good[:20], *bad[:20], "", "\n".join(f"line {k} of {k % 7}." for k in range(2000)), "a\n\nb"]
    array = pa.array(own)
    lines, counts = L.lines_of(array)
    whole = L.line_features(lines, counts)[L.chosen_lines(counts)]
    found = L.training_lines(array)
    sizes, label = found[2].to_numpy()[found[1]], np.array([k < 20 or k > 39 for k in range(len(own))])
    fields = []
    for part in (L.PART, 9, 700):
        sample = L.Sample(found[0], found[1], found[3], np.arange(len(own)))
        parts = list(sample.parts(True, part))
        assert np.allclose(np.concatenate([x for x, _ in parts]), whole, atol=1e-6)
        assert all(c.sum() == len(x) and c.max() <= L.CHAIN for x, c in parts) and (len(parts) > 1) == (part < L.PART)
        fields.append(L.train(sample, sizes, label, part))
    assert all(np.allclose(f.weights, fields[0].weights, atol=1e-6) and abs(f.shift - fields[0].shift) < 1e-6 for f in fields)
    order = np.arange(len(own))[::-1]
    turned = next(L.Sample(found[0], found[1], found[3], order).parts(False))
    straight = next(L.Sample(found[0], found[1], found[3], order[::-1]).parts(False))
    assert (turned[1] == straight[1][::-1]).all() and np.allclose(turned[0][: turned[1][0]], straight[0][-turned[1][0] :])


def test_held_out_accuracy(spark):
    good, bad = texts()
    rows = [(k, t) for k, t in enumerate(good + bad)]
    odd = [(1000, ""), (1001, None), (1002, "\n" * 3000), (None, "a b"), (0, good[0]), (1003, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(210)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    field = L.fit(docs, labels)
    scored, name = L.score_documents(docs, field)
    found = {r.doc_id: r[name] for r in scored.collect()}
    held = [k for k in range(210) if spark.sql(f"select crc32(cast({k} as string)) % 4 = 2").first()[0]]
    assert np.mean([found[k].predicted == (k < 150) for k in held]) > 0.95
    assert all(0 <= f.score <= 1 and f.predicted == (f.score >= L.CUT) for f in found.values())
    assert L.keep_good(docs, labels).columns == docs.columns
    assert L.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert L.score_documents(docs.limit(0), field)[0].count() == 0
    one_kind = L.fit(docs, labels.where("quality = 1"))
    assert round(float(one_kind.score(one_kind.share(pa.array(["x"])))[0]), 2) == 0.95

"""Substring dedup against brute force; the family's arrays."""

import collections
import hashlib
import random
import resource

import numpy as np
import pytest

from payspark.llm import substrings as S


@pytest.mark.parametrize("text", [bytes(random.Random(1).randrange(97, 123) for _ in range(1500)), b"the " * 300, b"a" * 700, b"x" * 400, b"y" * 399])
@pytest.mark.parametrize("length", [S.LENGTH, S.PASSAGE])
def test_anchors_are_first_least_heads(text, length, monkeypatch):
    data = np.frombuffer(text, np.uint8)
    width = length - S.HEAD + 1
    hashes = S.head_hashes(data)
    want = [w + int(np.argmin(hashes[w : w + width])) for w in range(len(hashes) - width + 1)]
    for piece in (1 << 20, 100):
        monkeypatch.setattr(S, "PIECE", piece)
        at, first, last, _ = S.all_anchors(data, length)
        assert [int(a) for a, f, z in zip(at, first, last) for _ in range(f, z + 1)] == want
    at, first, last, cyclic = S.anchors(data, length)
    kept = {w: int(a) for a, f, z in zip(at, first, last) for w in range(f, z + 1)}
    assert all(want[w] == a for w, a in kept.items())
    windows = [text[w : w + length] for w in range(len(text) - length + 1)]
    assert set(windows) == {windows[w] for w in kept}
    count = collections.Counter(windows)
    assert {w for a, z in cyclic.tolist() for w in range(a, z + 1)} == {w for w, x in enumerate(windows) if count[x] > 1}


def test_long_periodic_text_has_few_anchors_and_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for unit in (b"x", b"abcdefg ", b"0123456789" * 3):
        data = np.frombuffer(unit * (10_000_000 // len(unit)), np.uint8)
        assert len(S.places(data)) < 1000
        assert S.covered_bytes(len(data), S.LENGTH, [], S.anchors(data, S.LENGTH)[3]).all()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB


def windows_of(text, length):
    return (text[i : i + length] for i in range(len(text) - length + 1))


def brute(texts):
    count = collections.Counter(w for t in texts for n in (300, 400) for w in windows_of(t, n))
    out = []
    for t in texts:
        gone = {n: np.zeros(len(t), bool) for n in (300, 400)}
        for n in gone:
            for i, w in enumerate(windows_of(t, n)):
                if count[w] > 1:
                    gone[n][i : i + n] = True
        removed = gone[400]
        runs = int((np.diff(np.concatenate([[0], removed.astype(int)])) == 1).sum())
        out.append((len(t), int(removed.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~removed].tobytes()).hexdigest(), int(gone[300].any())))
    return out


def test_remove_repeats(spark):
    rnd = random.Random(3)
    prose = lambda n: "".join(rnd.choice(["the ", "of ", "ab", "é", "xyz. ", "Q"]) + str(rnd.randrange(10**6)) for _ in range(n))[:n]
    texts = [prose(rnd.randrange(0, 2500)) for _ in range(30)]
    shared = [prose(n) for n in (290, 300, 310, 380, 399, 400, 401, 450, 1200)]
    texts += [prose(rnd.randrange(0, 600)) + rnd.choice(shared) + prose(rnd.randrange(0, 600)) + (rnd.choice(shared) if k % 3 == 0 else "") for k in range(60)]
    texts += [texts[40]] * 3 + [texts[41][:300] + "#" + texts[41][300:], "the " * 200, "the " * 150 + "zz", "a" * 399, "a" * 400, "a" * 401, "a" * 900, "", None]
    texts += ["b" * 450, prose(100) + "b" * 400 + prose(50), "abc" * 135, "cab" * 134 + "x" + "abc" * 200, prose(350) + "q" * 700 + texts[3], (prose(80) + "\n") * 20, "copy", "copy", "c" * 350, "c" * 350]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[50], "x")], "doc_id long, text string, at string").repartition(4)
    found = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(docs).collect()}
    want = brute([(t or "").encode() for t in [*texts, texts[50]]])
    for k in range(len(texts)):
        assert found[k] == want[k], k
    assert found[None] == want[50]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_many_copies_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAVY", 3)
    texts = ["m" * 100 + "".join(map(str, range(200)))] * 40 + ["n" * 500] * 4 + ["short"] * 5 + [str(k) * 300 for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r)[1:] for r in sorted(S.remove_repeats(docs).collect())] == brute([t.encode() for t in texts])


def test_family_merges_equal_levels_and_outlives_its_object(spark, tmp_path):
    batches = [["a", "b"], ["b", "c"], ["d", "d"], ["a", "e"], ["e"]]
    heads = lambda rows: sorted(bytes(r.head).decode() for r in rows.collect())
    shared = []
    for b in batches:  # a new object for each batch, as a later session would have
        family = S.IndexFamily(spark, str(tmp_path / "family"))
        shared.append(heads(family.add(spark.createDataFrame([(bytearray(h.encode()),) for h in b], "head binary"))))
    assert shared == [[], ["b"], ["d"], ["a"], ["e"]]
    assert family.arrays() == [(0, 3), (4, 4)]
    assert {bytes(r.head).decode(): r.n for r in family.read((0, 3)).collect()} == {"a": 2, "b": 2, "c": 1, "d": 2, "e": 1}

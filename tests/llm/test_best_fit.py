"""Best-fit packing: plans, pieces equal to the tokenizer's ids, gapless sequences, number of sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from payspark.llm import best_fit as B

BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", "don't stop <|endoftext|> now", "éü " * 3000, "x " * 5000, "z" * 9000, " " * 9000 + "b", "line\nline\tline", "same", "same", "word " * 2046, "word " * 2047]


def best_fit_decreasing(counts):
    gaps, made = np.zeros(len(counts), int), 0
    for length in range(len(counts) - 1, 0, -1):
        for _ in range(int(counts[length])):
            fitting = np.flatnonzero(gaps[length:])
            gap = int(fitting[0]) + length if len(fitting) else len(counts) - 1
            made += not len(fitting)
            gaps[gap] -= len(fitting) > 0
            gaps[gap - length] += 1
    return made


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=65)
    patterns = B.planned(counts)
    used = np.zeros(65, int)
    for times, own in patterns:
        assert times > 0 and sum(n * m for n, m in own.items()) <= 64
        for n, m in own.items():
            used[n] += times * m
    assert (used == counts).all()
    made = sum(times for times, _ in patterns)
    assert -(-sum(lengths) // 64) <= made <= best_fit_decreasing(counts) + 1
    plan = B.Plan(patterns, 64)
    held = {}
    for n in np.flatnonzero(counts):
        sequence, offset = plan.place(np.full(counts[n], n), np.arange(counts[n]))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            held.setdefault(s, []).append((o, int(n)))
    assert len(held) == made
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()


def test_exact_sums():
    counts = np.bincount([10, 7, 3, 2, 2, 1], minlength=21)
    sums = B.Sums(counts)
    assert sums.filling(10, counts) == (10,) and sorted(sums.filling(9, counts)) == [2, 7] and sorted(sums.filling(12, counts)) == [2, 10]
    assert sorted(sums.filling(16, counts)) == [] or sum(sums.filling(16, counts)) == 16
    assert sum(sums.three(14, counts)) == 14 and sums.three(25 - 5, counts) in ((10, 7, 3), (7, 10, 3), (3, 10, 7))
    counts[:] = 0
    counts[2] = 2
    assert B.Sums(counts).filling(6, counts) == ()  # twice only


@pytest.mark.parametrize("size", [300_000, 30])
def test_large_counts_make_few_patterns(size):
    counts = np.random.default_rng(5).integers(0, size, 257)
    counts[0] = 0
    patterns = B.planned(counts)
    assert len(patterns) < 256 * 20
    if size == 30:
        assert sum(t for t, _ in patterns) <= best_fit_decreasing(counts)


@pytest.mark.parametrize("parts", [1, 4])
def test_pack(spark, parts):
    whole = Tokenizer.from_file(BYTES)
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string").repartition(parts)
    found = B.pack_best_fit(docs).collect()
    for k, text, _ in rows:
        want = whole.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in found if r.doc_id == k), key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == want
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.length == 2048 for r in own[1:]) and (len(want) > 2048) == (len(own) > 1)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in own)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
    counts = np.bincount([r.length for r in found], minlength=2049)
    assert len(sequences) <= best_fit_decreasing(counts)
    assert B.pack_best_fit(docs.limit(0)).count() == 0


def test_query_on_a_table(spark):
    found = B.best_fit_packing(spark, "/root/testdata/sf0.001").toPandas()
    whole = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    for doc_id, text in docs.itertuples(index=False):
        want = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = found[found.doc_id == doc_id].sort_values("piece")
        assert [zlib.crc32(want[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist() and own.length.sum() == len(want)
    by = found.assign(end=found.offset + found.length).groupby("sequence_id")
    assert (by.length.sum() == by.end.max()).all() and by.length.sum().max() <= 2048 and (by.offset.min() == 0).all()
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 2048) + 2

"""Suffix arrays and window hits against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from payspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_is_sorted(codes):
    order = D.suffix_array(np.array(codes, np.int64), 64)
    assert sorted(order.tolist()) == list(range(len(codes)))
    suffixes = [codes[i:] for i in order]
    assert suffixes == sorted(suffixes)


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        k = min(10, len(own))
        for a in range(len(own) - k + 1 if k else 0):
            windows.setdefault(tuple(own[a : a + k]), set()).add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for text in docs:
        own, covered, found = words(text), set(), set()
        for k in sizes:
            for a in range(len(own) - k + 1):
                if tuple(own[a : a + k]) in windows:
                    covered.update(range(a, a + k))
                    found |= windows[tuple(own[a : a + k])]
        out.append((len(own), len(covered), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(covered)))
    return out


def corpus():
    rnd = random.Random(5)
    prose = lambda n: " ".join(rnd.choice("the of and a é straße x1 Zwei".split()) + str(rnd.randrange(40)) for _ in range(n))
    items = [(k, prose(rnd.randrange(1, 40))) for k in range(30)] + [(30, ""), (31, None), (32, "the1"), (1, prose(20)), (2, "THE1, of2")]
    docs = [prose(rnd.randrange(0, 200)) for _ in range(60)]
    docs += [f"{prose(5)}; {(items[k][1] or '').upper()} ... {prose(9)}" for k in range(35)] + ["", None, "the1", prose(20_000), items[4][1], items[4][1]]
    return docs, items


def test_find_items(spark):
    docs, items = corpus()
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(items + [(None, docs[0])], "item_id long, text string")
    for limit, most in ((D.BLOCK_BYTES, D.MOST_BYTES), (2000, D.MOST_BYTES), (1000, 2500), (700, 1)):  # one block, several blocks, several rounds
        found, name = D.find_items(table, bench, block_bytes=limit, most_bytes=most)
        rows = {r.doc_id: r[name] for r in found.collect()}
        want = brute(docs, items)
        assert [tuple(rows[k])[:5] for k in range(len(docs))] == want
    clean = D.keep_clean(table, bench)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {k for k, w in enumerate(want) if not w[4]}
    none, name = D.find_items(table, bench.limit(0))
    assert none.where(f"{name}.contaminated").count() == 0
    assert D.find_items(table.limit(0), bench)[0].count() == 0


def test_a_worker_holds_the_blocks_of_one_round(spark):
    _, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    taken, sizes = [], []
    for blocks, _, last in D.rounds_of(bench, 700, 1500):
        sizes.append(len(blocks))
        taken += [i for b in blocks for i in b.value.ids]
    assert len(sizes) > 2 and max(sizes) == 2 and last
    assert sorted(taken) == sorted(str(k) for k, _ in items)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(7, "zero " + " ".join(f"w{i}" for i in range(30)) + " end")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " other")], "item_id long, text string")
    rows = D.longest_matches(docs, items).orderBy("item_word").collect()
    assert tuple(rows[0]) == ("1", 2, 20, 7, 6) and [r.length for r in rows] == list(range(20, 9, -1))
    assert D.longest_matches(docs, items, block_bytes=20, most_bytes=20).orderBy("item_word").collect() == rows

"""Fingerprints, tiles and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from payspark.llm import simhash as H
from payspark.llm.components import components

TEXTS = ["", "a", "A b", " x y  z", "x\ny z q", "é ü ß " * 300, "straße ÄÖ Z", "no\xa0break x y"]


def brute_print(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 3]).encode(), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    assert H.fingerprints(pa.array(TEXTS)).tolist() == [brute_print(t) for t in TEXTS]


def groups(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 90))
def test_roots_in_tile(seed, n):
    rnd = random.Random(seed)
    prints = [rnd.getrandbits(8) << rnd.choice([0, 20]) for _ in range(n)]
    root = H.roots_in_tile(np.array(prints, np.uint64)).tolist()
    want = groups(prints)
    assert len({*zip(root, want)}) == len(set(root)) == len(set(want))


def linked(spark, prints, hot):
    frame = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "fp long").repartition(3)
    roots = {r.node: r.root for r in components(H.links_of(frame, hot)).collect()}
    return [roots.get(int(np.array(p, np.uint64).view(np.int64)), p) for p in prints]


def test_links_reach_all_components(spark):
    rnd = random.Random(6)
    prints = set()
    for _ in range(30):
        center = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 25)):
            center ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5)))
            prints.add(center)
    prints = sorted(prints | {0, 1, 7, 15, 2**64 - 1, 2**63})
    want = groups(prints)
    for hot in (H.HOT, 3):
        found = linked(spark, prints, hot)
        assert len({*zip(found, want)}) == len(set(found)) == len(set(want))


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    long = " ".join(f"w{i * i % 7919}" for i in range(20_000))
    texts = [*TEXTS, None, base, base, base.replace("word150", "other"), base.upper(), long, long + " more"]
    rows = [(100 - k, t, 5) for k, t in enumerate(texts)] + [(7, base, 5), (7, base, 5), (None, base, 5), (None, "alone without id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)
    found = H.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    root = groups(prints)
    for doc_id, text, _ in rows:
        own = [r for r in found if r.doc_id == doc_id and r.fp == int(np.array(brute_print(text), np.uint64).view(np.int64))]
        ids = [rows[k][0] for k in range(len(rows)) if root[k] == root[prints.index(brute_print(text))] and rows[k][0] is not None]
        assert own and own[0].component_id == min(ids, default=None)
    assert H.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 30, 1 << 17])
def test_long_chain_of_links(spark, few):
    links = spark.range(400).selectExpr("id as a", "id + 1 as b")
    found = components(links, few)
    assert found.select("root").distinct().count() == 1 and found.count() == 401
    assert components(links.limit(0), few).count() == 0


@pytest.mark.parametrize("few", [0, 40, 1 << 17])
def test_components_of_random_links(spark, few):
    rng = np.random.default_rng(few)
    ends = rng.integers(-50, 150, (120, 2)).tolist()
    group = {n: {n} for pair in ends for n in pair}
    for a, b in ends:
        both = group[a] | group[b]
        for n in both:
            group[n] = both
    links = spark.createDataFrame([tuple(p) for p in ends + ends[:5]], "a long, b long").repartition(4)
    root = {r.node: r.root for r in components(links, few).collect()}
    alone = {n for n, own in group.items() if len(own) == 1}
    assert set(root) == set(group) - alone and all(root[r] == r for r in root.values())
    assert all((root[a] == root[b]) == (b in group[a]) for a in root for b in root)

"""Near copies at a five-word similarity of 0.8 against brute force."""

import random
import re

import corpus_pipeline
from payspark.llm import near_copies as N


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute_groups(texts):
    sets, left, out = [shingles(t) for t in texts], set(range(len(texts))), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            k = todo.pop()
            group.add(k)
            near = {j for j in left if 9 * len(sets[k] & sets[j]) >= 4 * (len(sets[k]) + len(sets[j]))}
            left -= near
            todo += near
        out.append(frozenset(group))
    return set(out)


def texts_with_copies(seed):
    rnd = random.Random(seed)
    texts = ["", None, "one two", "One  two", "a b c d e f"]
    for _ in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([60, 200, 600]))]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(f"x{rnd.randrange(5000)}" if rnd.random() < share else w for w in words))
    return texts


def test_groups(spark):
    texts = texts_with_copies(4)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    for tiles in ({}, {"tile_texts": 2, "tile_shingles": 700}):
        found = {}
        for r in N.groups(rows, **tiles).collect():
            found.setdefault(r.group, set()).add(r.row)
        assert {frozenset(g) for g in found.values()} == brute_groups(texts)
    assert N.groups(rows.limit(0)).count() == 0


def test_a_band_of_any_size_is_cut(spark):
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        rows = [(r, 7 if r < 500 else r // 2) for r in range(600)]
        links = N.chains(spark.createDataFrame(rows, "row long, band long").repartition(4))
        root = {r.node: r.root for r in N.components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({root[r] for r in range(500)}) == 1 and len(set(root.values())) == 51
    assert all(root[r] == root[r + 1] for r in range(500, 600, 2))
    assert N.components(N.chains(spark.createDataFrame([], "row long, band long"))).count() == 0


def test_large_components_are_formed_anew(spark):
    """Texts at 0.5 of the next make one component of bands; marks take it apart but for rare pairs, near copies stay together."""
    rnd = random.Random(3)
    texts, shared = [], [[f"s{k}w{rnd.randrange(9000)}" for _ in range(100)] for k in range(42)]
    for k in range(40):
        words = [*shared[k], *shared[k + 1], *shared[k + 2]]
        texts += [" ".join(words), " ".join("other" if i == 70 else w for i, w in enumerate(words))]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    found = N.saved(N.sketches(rows))
    whole = N.candidates(found, 1024, 2_000_000)[0]
    assert whole.groupBy("root").count().agg({"count": "max"}).first()[0] > 8
    for hot in (8192, 3):
        near, sizes = N.candidates(found, 4, 2_000_000, hot)
        assert near.groupBy("root").count().agg({"count": "max"}).first()[0] <= 4 and near.count() == 80
        assert [r.parts for r in sizes.select("parts").distinct().collect()] == [1]
    groups = {}
    for r in N.groups(rows, tile_texts=4).collect():
        groups.setdefault(r.group, set()).add(r.row)
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts)


def test_stage_removes_near_copies(spark):
    words = [f"word{i}" for i in range(300)]
    near = " ".join("other" if i in (50, 120, 200, 250) else w for i, w in enumerate(words))
    apart = " ".join("other" if i % 20 == 0 else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(3, " ".join(words), 5), (1, near, 6), (2, apart, 7)], "doc_id long, text string, n int")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, near, 6), (2, apart, 7)]


def test_stage_tells_rows_apart(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(1, one), (1, two), (None, two), (None, three), (None, three), (4, one), (4, one)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(map(tuple, kept), key=lambda r: r[1]) == [(1, one), (1, two), (None, three)]

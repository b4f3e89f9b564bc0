"""Chat trees: escapes, exact round trip, depth-first intervals."""

import collections
import hashlib
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from payspark.llm import chat_tree as C


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "\n", "é", "a", "<|endoftext|>", "n", "\U0001f600"]), max_size=14).map("".join))
def test_escapes_are_reversible(text):
    written = C.header(text) + C.escape(text) + C.END + "\n"
    assert "<|" not in C.escape(text) and C.parse_turn(written) == (text, text)
    ranked, whole = C.tokenizer(C.default_tokenizer()), C.tokenizer(C.default_tokenizer().replace(".tiktoken", ".json"))
    ids = ranked.encode([written])
    assert ids == whole.encode([written]) and ranked.decode(ids) == whole.decode(ids) == [written]


def brute(rows):
    by = collections.defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(rows):  # a row without an id is by itself
        by[conv if conv is not None else ("none", k)].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, own in by.items():
        own.sort()
        learnt = "".join(t for *_, r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in own)
        size = sum(len(C.header(r) + C.escape(t) + C.END) + 1 for *_, r, t in own)
        out.append((None if isinstance(conv, tuple) else conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), size))
    return sorted(out, key=repr)


def conversations():
    rnd = random.Random(2)
    rows = []
    for c in range(120):
        rows.append((c, 0, "user", "common" if c % 3 else f"first {c % 4}"))
        rows += [(c, t, rnd.choice(["assistant", "user", None]), rnd.choice(["ok", "no", "<|im_end|>", None, "é"])) for t in range(1, rnd.randint(1, 6))]
    rows += [(None, 1, "user", "n"), (None, 1, "user", "n"), (None, 0, "assistant", "common"), (7, None, "user", "null turn"), (5, 0, "user", "dup"), (5, 0, "user", "dup")]
    return rows + [(999, t, "user", f"turn {t % 7}") for t in range(1500)] + [(1000, 0, "assistant", "long " * 20_000)]


def check(spark, rows):
    table = spark.createDataFrame([(*r, b"x") for r in rows], "conv_id long, turn long, role string, text string, node binary").repartition(5)
    tree, turns = C.format_tree(table)
    assert sorted(map(tuple, C.read_back(tree, turns).collect()), key=repr) == brute(rows)
    nodes = sorted(tree.collect(), key=lambda r: r.start)
    by = {bytes(r.node): r for r in nodes}
    assert len(by) == len(nodes)  # each shared turn once
    at, end = 0, {}
    for r in nodes:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        above, parent = [], bytes(r.parent)
        while parent != C.ROOT:
            above.append(by[parent])
            parent = bytes(by[parent].parent)
        assert r.depth == len(above) and r.position == sum(a.n_tokens for a in above)
        assert sorted(x for a in above for x in range(a.start, a.start + a.n_tokens)) == [x for i in r.attends for x in range(i.start, i.end)]
    for r in reversed(nodes):  # depth first: a subtree is one run of tokens
        kids = [k for k in nodes if bytes(k.parent) == bytes(r.node)] if len(nodes) < 600 else []
        end[bytes(r.node)] = max([r.start + r.n_tokens, *(end[bytes(k.node)] for k in kids)])
        assert not kids or end[bytes(r.node)] - r.start == r.n_tokens + sum(end[bytes(k.node)] - k.start for k in kids)


def test_tree_and_round_trip(spark):
    check(spark, conversations())


def test_partitions_continue_each_other(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small test has one partition
    try:
        check(spark, conversations())
        check(spark, conversations()[:300])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_positions_and_intervals_are_used(spark):
    """Wrong intervals or positions must not read back well."""
    from pyspark.sql import functions as F

    rows = [(c, t, "user", f"{c // 2} {t}") for c in range(6) for t in range(4)]
    tree, turns = C.format_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for broken in (tree.withColumn("attends", F.slice("attends", 2, 9)), tree.withColumn("position", -F.col("position"))):
        assert sorted(map(tuple, C.read_back(broken, turns).collect()), key=repr) != brute(rows)


def test_deep_path_takes_linear_time():
    took = []
    for depth in (25_000, 100_000):
        path = b"".join(k.to_bytes(16, "big") + (3).to_bytes(4, "little") for k in range(depth))
        began = time.process_time()
        last = None
        for stack in C.walk(iter([path, path + b"z" * 16 + (1).to_bytes(4, "little")]), [], 0):
            last = stack[-1]
        took.append(time.process_time() - began)
        assert (last.position, last.attends) == (3 * depth, ((0, 3 * depth),))
    assert took[1] < 10 * took[0] + 0.5


def test_empty(spark):
    tree, turns = C.format_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert tree.count() == 0 and C.read_back(tree, turns).count() == 0

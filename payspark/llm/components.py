"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payspark.llm.checkpoints import checkpointed

#: Links that one task finishes by itself, two megabytes of them.
FEW = 1 << 17


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some links, and of each the least node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    found = np.array(root, np.int64)
    while (found != found[found]).any():
        found = found[found]
    return nodes, nodes[found]


def finished(links: DataFrame) -> DataFrame:
    """(node, root) of at most ``FEW`` links, by one task."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, roots_of(*map(np.concatenate, zip(*held))))), schema=schema)

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root): nodes of one component, and they alone, have the same root.

    ``links`` has two columns ``a`` and ``b`` of type long. In each round every
    node hooks to the neighbour (or itself) that comes first in a pseudo-random
    order drawn anew for the round, and the links are contracted. A constant
    share of the nodes goes in each round, so chains don't take as many rounds
    as they have links. Once at most ``few`` links are left, one task joins
    them, as further rounds would be many jobs for little work. Minima are
    partly aggregated before shuffles; a node with very many links only skews
    joins, which adaptive execution splits.
    """
    links = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    turn = 0
    while (left := links.count()) > few:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hooks = checkpointed(hooks.select(F.col("a").alias("node"), F.least("m", rank("a"))["v"].alias("to")))
        ends = [hooks.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
        links = checkpointed(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        label = _moved(label, hooks)
        turn += 1
    if left:
        label = _moved(label, checkpointed(finished(links)).withColumnRenamed("root", "to"))
    return label if label is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _moved(label: DataFrame | None, step: DataFrame) -> DataFrame:
    """Labels (node, root) after a step (node, to)."""
    if label is None:
        return step.select("node", F.col("to").alias("root"))
    moved = label.join(step.select(F.col("node").alias("root"), "to"), "root", "left")
    return checkpointed(moved.select("node", F.coalesce("to", "root").alias("root")))

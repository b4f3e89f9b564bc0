"""Chat formatting as a prefix tree.

A conversation becomes turns ``<|im_start|>role\\n text <|im_end|>\\n``; control
strings inside a text are escaped by a backslash after their ``<``, which can
be undone. Header, text and footer are encoded apart, by a byte-level
vocabulary that loses nothing. A turn together with all turns before it is a
node, named by a chained 128-bit hash, so conversations that share initial
turns share nodes. Each node's tokens are kept once.

Nodes are numbered depth first by sorting the conversations' paths: after the
path before it, a path adds the nodes beyond their common prefix. Paths are
range-partitioned, so a first turn that a third of all conversations share is
spread over tasks; a summary of each partition (its last path and token
count) tells the next where it continues. ``start`` is a node's place in the
depth-first token stream, ``position`` the position id of its first token,
and ``attends`` the intervals of the stream that its ancestors cover, merged
where they touch; within itself a node is causal.

Reading back takes a conversation's nodes in the order of their position ids,
and each counts if the intervals that its successor attends to hold it, so
positions and intervals are what the text comes back through.

A conversation is read in order by one task, in batches, as its digest has to
be; a few bytes a turn are held.

Defined results: turns go by turn, then role and text; a null role or text is
empty, a null turn comes first; a row without ``conv_id`` is a conversation of
its own, so that such rows are no hot group; repeated rows are turns of their
own; only the role ``assistant`` is under the loss mask; other columns are
ignored; an empty table gives no rows. A very long text is encoded in one call,
with its tokens in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payspark.llm.arrowtext import slices
from payspark.llm.checkpoints import checkpointed, saved

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
ROOT = bytes(16)
#: Bytes of text encoded in one call; encodings take far more memory than texts.
SLICE = 1 << 18
#: Bytes of a path's element: a node's name and its number of tokens.
ELEMENT = 20

TURNS = "talk long, conv_id long, row long, node binary, parent binary, ids array<int>, loss_start int, loss_end int, path binary"
TREE = "node binary, parent binary, depth long, start long, position long, n_tokens long, attends array<struct<start long, end long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


# Fixed value: how the vocabulary's own tokenizer splits text into parts.
PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class RankedTokenizer:
    """A byte-level vocabulary given as a list of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (row.split() for row in file if row.strip())}
        self.own = tiktoken.Encoding("vocabulary", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; nothing in it is a control token."""
        return [self.own.encode_ordinary(t) for t in texts]

    def decode(self, pieces: list[list[int]]) -> list[str]:
        return [self.own.decode_bytes(p).decode() for p in pieces]


class FileTokenizer:
    """A byte-level vocabulary with its rules in one file."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; nothing in it is a control token."""
        return [found.ids for found in self.own.encode_batch(texts, add_special_tokens=False)]

    def decode(self, pieces: list[list[int]]) -> list[str]:
        return self.own.decode_batch(pieces, skip_special_tokens=False)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> RankedTokenizer | FileTokenizer:
    return RankedTokenizer(path) if path.endswith(".tiktoken") else FileTokenizer(path)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def header(role: str) -> str:
    return START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def role_of(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(written))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head, _, rest = formatted.removeprefix(START).partition("\n")
    return role_of(head), unescape(rest.removesuffix(END + "\n"))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def lists_of(pieces: list[np.ndarray], sizes: list[int]) -> pa.ListArray:
    """Rows of ``sizes`` numbers each from the pieces in order."""
    values = np.concatenate([*pieces, np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), pa.array(values))


def encode_turns(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """TURNS: each turn's node and tokens, and a row with nothing but its path for each conversation.

    ``talk`` numbers the conversations. One streams through one task in order
    of its turns; only its path, of a few bytes a turn, is held.
    """
    schema = arrow_schema(conversations.sparkSession, TURNS)

    def path_row(path: bytearray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, f.type) if f.name != "path" else pa.array([bytes(path)], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary or default_tokenizer())
        encoded = lambda text: np.array(own.encode([text])[0], np.int32)
        foot, heads = encoded(f"{END}\n"), {}
        row, talk, last, node, path = TaskContext.get().partitionId() << 36, -1, None, ROOT, bytearray()
        for part in (p for b in batches for p in slices(b, limit=SLICE)):
            roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
            pieces: list[np.ndarray] = []
            out: list[list] = [[] for _ in range(7)]
            for conv, role, text, coded in zip(part.column("conv_id").to_pylist(), roles, texts, own.encode([escape(t) for t in texts])):
                if talk < 0 or conv is None or conv != last:
                    if path:
                        yield path_row(path)
                    talk, last, node, path = row, conv, ROOT, bytearray()
                if role not in heads:
                    heads = heads if len(heads) < 1000 else {}
                    heads[role] = encoded(header(role))
                head, body = heads[role], np.array(coded, np.int32)
                pieces += [head, body, foot]
                named = role.encode()
                parent, node = node, hashlib.blake2b(node + len(named).to_bytes(8, "little") + named + text.encode(), digest_size=16).digest()
                size, start = len(head) + len(body) + len(foot), len(head)
                path += node + size.to_bytes(4, "little")
                for column, value in zip(out, (talk, conv, node, parent, start, start + len(body) * (role == LEARNT), size)):
                    column.append(value)
                row += 1
            count = part.num_rows
            talks, convs, nodes, parents, starts, ends, sizes = out
            columns = {"talk": talks, "conv_id": convs, "row": range(row - count, row), "node": nodes, "parent": parents, "loss_start": starts, "loss_end": ends}
            made = {"ids": lists_of(pieces, sizes), "path": pa.nulls(count, pa.binary())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
        if path:
            yield path_row(path)

    clean = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    dealt = clean.withColumn("dealt", F.coalesce("conv_id", F.monotonically_increasing_id())).repartition("dealt")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, TURNS)


def elements(path: bytes) -> list[tuple[bytes, int]]:
    return [(path[k : k + 16], int.from_bytes(path[k + 16 : k + ELEMENT], "little")) for k in range(0, len(path), ELEMENT)]


class Place(NamedTuple):
    """A node on the way down: its tokens, where they start in the stream, its position id, and what its ancestors cover."""

    node: bytes
    size: int
    start: int
    position: int
    attends: tuple[tuple[int, int], ...]


def push(stack: list[Place], node: bytes, size: int, start: int) -> None:
    """A node below the last one; touching intervals are merged."""
    if not stack:
        stack.append(Place(node, size, start, 0, ()))
        return
    above = stack[-1]
    known, end = above.attends, above.start + above.size
    touches = bool(known) and known[-1][1] == above.start
    attends = (*known[:-1], (known[-1][0], end)) if touches else (*known, (above.start, end))
    stack.append(Place(node, size, start, above.position + above.size, attends))


def walk(paths: Iterator[bytes], stack: list[Place], at: int) -> Iterator[list[Place]]:
    """Depth first through sorted paths: for each new node the stack down to it.

    ``stack`` is what the paths before ended with and ``at`` the next free place; both are carried on.
    """
    for path in paths:
        own = elements(path)
        same = 0
        while same < min(len(own), len(stack)) and own[same][0] == stack[same].node:
            same += 1
        del stack[same:]
        for node, size in own[same:]:
            push(stack, node, size, at)
            at += size
            yield stack


def tree_of(turns: DataFrame) -> DataFrame:
    """TREE: each distinct node of ``turns`` once, with its place in the depth-first stream."""
    spark = turns.sparkSession
    paths = saved(turns.where(F.col("path").isNotNull()).select("path").distinct())
    ordered = checkpointed(paths.repartitionByRange("path").sortWithinPartitions("path"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Place] = []
        first, total = None, 0

        def seen() -> Iterator[bytes]:
            nonlocal first
            for (path,) in rows_of(batches):
                first = path if first is None else first
                yield path

        for own in walk(seen(), stack, 0):
            total = own[-1].start + own[-1].size
        if first is not None:
            last, starts = b"".join(p.node + p.size.to_bytes(4, "little") for p in stack), [p.start for p in stack]
            values = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([total], pa.int64()), pa.array([last], pa.binary()), pa.array([starts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(values, names=["part", "first", "total", "last", "starts"])

    # A row for each partition, as long as one path.
    parts = ordered.mapInArrow(summarise, "part int, first binary, total long, last binary, starts array<long>").orderBy("part").collect()
    begin: dict[int, tuple[list[Place], int]] = {}
    stack: list[Place] = []
    at = 0
    for p in parts:
        begin[p["part"]] = (list(stack), at)
        first, shared = elements(bytes(p["first"])), 0
        while shared < min(len(first), len(stack)) and first[shared][0] == stack[shared].node:
            shared += 1
        known = sum(size for _, size in first[:shared])
        # Alone, a partition would start with its whole first path; the part known before moves nothing.
        last = elements(bytes(p["last"]))
        kept = 0
        while kept < min(shared, len(last)) and last[kept][0] == first[kept][0]:
            kept += 1
        stack = stack[:kept]
        for (node, size), start in list(zip(last, p["starts"]))[kept:]:
            push(stack, node, size, at + start - known)
        at += p["total"] - known
    shared_begin = spark.sparkContext.broadcast(begin)
    schema = arrow_schema(spark, TREE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, start = shared_begin.value.get(TaskContext.get().partitionId(), ([], 0))

        def nodes() -> Iterator[tuple]:
            for own in walk((p for (p,) in rows_of(batches)), list(before), start):
                top = own[-1]
                attends = [{"start": a, "end": b} for a, b in top.attends]
                yield top.node, own[-2].node if len(own) > 1 else ROOT, len(own) - 1, top.start, top.position, top.size, attends

        yield from batched(nodes(), schema)

    return ordered.mapInArrow(place, TREE)


def format_tree(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tree (TREE and tokens ``ids``, ``loss_start``, ``loss_end``), and (talk, conv_id, node) of every turn."""
    coded = saved(encode_turns(conversations, vocabulary))
    turns = coded.where("path is null")
    kept = turns.groupBy("node").agg(F.min("row").alias("row")).select("row")
    tokens = turns.select("row", "node", "ids", "loss_start", "loss_end").join(kept, "row", "left_semi").drop("row")
    return saved(tree_of(coded).join(tokens, "node")), turns.select("talk", "conv_id", "node")


class Reading:
    """A conversation as it is read back, turn by turn."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.learnt, self.formatted = conv, 0, 0, 0
        self.whole, self.mask = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, learnt: str) -> None:
        role, text = parse_turn(formatted)
        self.turns += 1
        self.whole.update(f"{role}\n{text}\n".encode())
        self.learnt += len(learnt)
        self.mask.update(learnt.encode())
        self.formatted += len(formatted)

    def digest(self) -> tuple:
        return self.conv, self.turns, self.whole.hexdigest(), self.learnt, self.mask.hexdigest(), self.formatted


def decoded(batch: pa.RecordBatch, own) -> Iterator[tuple[str, str]]:
    """Of each row the formatted turn and, unescaped, what is under the loss mask; all tokens are decoded once."""
    ids = batch.column("ids")
    values, bounds = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
    pieces = []
    for low, high, a, b in zip(bounds[:-1], bounds[1:], batch.column("loss_start").to_pylist(), batch.column("loss_end").to_pylist()):
        cuts = (low, low + a, low + b, high) if b > a else (low, high, high, high)
        pieces += [values[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:])]
    texts = iter(own.decode(pieces))
    for head, body, foot in zip(texts, texts, texts):
        yield head + body + foot, unescape(body)


def read_back(tree: DataFrame, turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """DIGEST of every conversation, decoded from the tree's tokens by positions and intervals."""
    schema = arrow_schema(tree.sparkSession, DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary or default_tokenizer())

        def conversations() -> Iterator[tuple]:
            talk, reading, held = None, Reading(None), None
            for batch in batches:
                attends = batch.column("attends")
                bounds, spans = attends.offsets.to_pylist(), list(zip(*(attends.values.field(n).to_pylist() for n in ("start", "end"))))
                facts = zip(*(batch.column(c).to_pylist() for c in ("talk", "conv_id", "start", "n_tokens")), bounds[:-1], bounds[1:], decoded(batch, own))
                for number, conv, start, size, a, b, turn in facts:
                    if number == talk:
                        # What this turn attends to holds the one before it.
                        if any(x <= held[0] and held[0] + held[1] <= y for x, y in spans[a:b]):
                            reading.add(*held[2])
                    else:
                        if held is not None:
                            reading.add(*held[2])
                            yield reading.digest()
                        talk, reading = number, Reading(conv)
                    held = (start, size, turn)
            if held is not None:
                reading.add(*held[2])
                yield reading.digest()

        yield from batched(conversations(), schema)

    joined = turns.join(tree.select("node", "start", "n_tokens", "position", "attends", "ids", "loss_start", "loss_end"), "node").drop("node")
    ordered = joined.repartition("talk").sortWithinPartitions("talk", "position")
    return ordered.drop("position").mapInArrow(run, DIGEST)


def chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: all conversations and conversation -1, formatted and read back."""
    words = f"{END}{START}assistant ok"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(words).alias("text"))
    tree, turns = format_tree(given.unionByName(more))
    return read_back(tree, turns)

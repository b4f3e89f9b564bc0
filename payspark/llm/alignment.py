"""Alignment of two tokenizations of the same text by a dangling-suffix transducer.

The tokens of both vocabularies spell the same bytes. The transducer reads
tokens in turn and keeps which side leads and the bytes that it has ahead, its
residual: with nothing ahead the next token is the first vocabulary's, else
that of the side behind. A transition depends on the residual and the next
token alone, so it is worked out once and remembered. Residuals are ends of
tokens and a token fits a residual only if one begins the other, so there are
no more transitions than bytes in both vocabularies. Where the residual gets
empty both sides have a token end: a group closes, and its last tokens are
linked.

Texts are aligned by segments (see ``segments``), as both sides end a token at
each cut, and each distinct segment once while a worker remembers it.

How often a pair of ids is linked in the corpus is counted from the links of
all texts, kept in the shared folder, with a sum for each task before the
shuffle. Of two linked tokens one's bytes end the other's, so there are at
most as many pairs as bytes in both vocabularies, half a million for the
default ones, whatever the corpus; this table alone is broadcast.

Defined results: a null or empty text, and one whose tokens spell other bytes
than a space and the text (one with U+2581, say, which stands for a space),
has no tokens: zeros, no groups and an empty digest. Repeated rows are aligned
once each and all count; a null ``doc_id`` stays null; other columns are
ignored; an empty table gives no rows. A very long text is held with its
tokens in one task, at some ten bytes for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payspark.llm.arrowtext import as_strings, slices, sums_by_row
from payspark.llm.checkpoints import Scratch, saved
from payspark.llm.segments import Numbered, byte_tokenizer, encoded, gathered, piece_tokenizer, segments_of

#: Text handled at once, and bytes of the segments that a worker remembers.
SLICE, REMEMBERED = 2 << 20, 2 << 20
#: Links that a task holds before it sums them.
HELD = 1 << 20
#: Bits of a packed link that hold the second vocabulary's id.
SHIFT = 24
GROUPS = "array<struct<a array<int>, b array<int>>>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


class Transducer:
    """Closes groups of two token sequences; ``tokens_a`` and ``tokens_b`` have the bytes of each id."""

    EMPTY = 0

    def __init__(self, tokens_a: dict[int, bytes], tokens_b: dict[int, bytes]):
        self.tokens = (tokens_a, tokens_b)
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # which side leads, and its bytes ahead; with none the first side reads
        self.numbers = {self.states[0]: self.EMPTY}
        self.leads = [1]
        self.moves: dict[int, int] = {}  # by state and token, packed

    def state(self, side: int, ahead: bytes) -> int:
        if not ahead:
            return self.EMPTY
        key = (side, ahead)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.leads.append(side)
        return self.numbers[key]

    def move(self, at: int, token: int) -> int | None:
        """The state after the next token of the side behind; None where it doesn't fit."""
        leads, ahead = self.states[at]
        behind = 1 - leads
        new = self.tokens[behind].get(token)
        if new is None:
            return None
        if ahead.startswith(new):
            to = self.state(leads, ahead[len(new) :])
        elif new.startswith(ahead):
            to = self.state(behind, new[len(ahead) :])
        else:
            return None
        self.moves[at << SHIFT | token] = to
        return to

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of each side are read where a group closes; None if the sequences spell different bytes."""
        moves, leads, at, i, j = self.moves, self.leads, 0, 0, 0
        n, m, out = len(a), len(b), []
        while i < n or j < m:
            if leads[at]:
                if i == n:
                    return None
                token = a[i]
                i += 1
            else:
                if j == m:
                    return None
                token = b[j]
                j += 1
            to = moves.get(at << SHIFT | token)
            if to is None:
                to = self.move(at, token)
                if to is None:
                    return None
            at = to
            if not at:
                out.append((i, j))
        return None if at else out


class Aligner:
    """Aligns texts, each distinct segment once while it is remembered."""

    def __init__(self, tokenizer_a: str, model_b: str):
        self.a, self.b = byte_tokenizer(tokenizer_a), piece_tokenizer(model_b)
        self.cut = self.a.cuts and self.b.cuts
        self.transducer = Transducer(self.a.tokens, self.b.tokens)
        self.heads, self.tails = [f"{i}|" for i in range(max(self.a.tokens) + 1)], [str(i) for i in range(max(self.b.tokens) + 1)]
        self.numbers = Numbered(REMEMBERED)
        self.forget()

    def forget(self) -> None:
        """Of each segment: its counts (tokens of both sides, groups, whether it aligns), its links, its groups as written."""
        self.counts = np.zeros((0, 4), np.int64)
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.written: list[bytes] = []

    def learn(self, new: pa.StringArray) -> None:
        """Align segments and keep what was found."""
        sides = [encoded(new, own) for own in (self.a, self.b)]
        (a, sizes_a), (b, sizes_b) = sides
        a, b = a.tolist(), b.tolist()
        counts, links, sizes, run, heads, tails = [], [], [], self.transducer.groups, self.heads, self.tails
        i = j = 0
        for n, m in zip(sizes_a.tolist(), sizes_b.tolist()):
            own_a, own_b = a[i : i + n], b[j : j + m]
            i, j = i + n, j + m
            ends = run(own_a, own_b)
            if ends is None:
                counts.append((0, 0, 0, 0))
                sizes.append(0)
                self.written.append(b"")
                continue
            counts.append((n, m, len(ends), 1))
            sizes.append(len(ends))
            links += [(own_a[x - 1] << SHIFT) | own_b[y - 1] for x, y in ends]
            from_x, from_y, said = 0, 0, []
            for x, y in ends:
                if x - from_x == 1 == y - from_y:  # most groups
                    said.append(heads[own_a[from_x]] + tails[own_b[from_y]])
                else:
                    said.append(f"{','.join(map(str, own_a[from_x:x]))}|{','.join(map(str, own_b[from_y:y]))}")
                from_x, from_y = x, y
            self.written.append(";".join(said).encode())
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64).reshape(-1, 4)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.links = np.concatenate([self.links, np.array(links, np.int64)])

    def align(self, texts: pa.StringArray) -> tuple[np.ndarray, list[bytes], list[list[bytes]]]:
        """Of each text the counts (tokens of both sides, groups), its links as packed numbers, and its segments' groups as written."""
        full = pc.greater(pc.binary_length(texts), 0)
        spaced = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" "), texts, ""), "")
        flat, per_text = segments_of(spaced, self.cut)
        coded = flat.dictionary_encode()
        places, new, fresh = self.numbers.places(coded.dictionary)
        if fresh:
            self.forget()
        self.learn(new)
        place = places[coded.indices.to_numpy()]
        own = self.counts[place]
        fine = (sums_by_row(own[:, 3], per_text) == per_text) & (per_text > 0)
        totals = np.stack([sums_by_row(own[:, k], per_text) for k in range(3)], axis=1) * fine[:, None]
        links, sizes = gathered(place, self.starts, self.links)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per_text)])].tolist()
        stops = np.concatenate([[0], np.cumsum(per_text)]).tolist()
        place, written = place.tolist(), self.written
        raw = [links[ends[k] : ends[k + 1]].tobytes() if ok else b"" for k, ok in enumerate(fine.tolist())]
        parts = [[written[p] for p in place[stops[k] : stops[k + 1]]] if ok else [] for k, ok in enumerate(fine.tolist())]
        return totals, raw, parts


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def digest(parts: list[bytes]) -> str:
    """Of the groups as written, one after the other; of none the empty text."""
    if not parts:
        return ""
    own = hashlib.sha256(parts[0])
    for at in range(1, len(parts), 4096):
        own.update(b";" + b";".join(parts[at : at + 4096]))
    return own.hexdigest()


def aligned(docs: DataFrame, tokenizer_a: str | None = None, model_b: str | None = None, with_groups: bool = False) -> DataFrame:
    """A row for each document (doc_id, text), see ``ALIGNED``; ``links`` has each link's two ids packed in 8 bytes.

    With ``with_groups`` also ``groups``, the ids of each group.
    """
    schema_of = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary())]
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
    schema = pa.schema([*schema_of, ("groups", kind)] if with_groups else schema_of)

    def ids(written: bytes) -> dict[str, list[int]]:
        return dict(zip("ab", ([int(x) for x in side.split(b",")] for side in written.split(b"|"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = default_tokenizers()
        own = Aligner(tokenizer_a or known[0], model_b or known[1])
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                totals, raw, parts = own.align(as_strings(part.column("text")))
                columns = [part.column("doc_id").cast(pa.int64()), *(pa.array(totals[:, k]) for k in (0, 1, 2, 2)), pa.array(map(digest, parts), pa.string()), pa.array(raw, pa.binary())]
                if with_groups:
                    columns.append(pa.array([[ids(g) for g in b";".join(p).split(b";") if g] for p in parts], kind))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"{ALIGNED}, groups {GROUPS}" if with_groups else ALIGNED)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): how often each pair of ids is linked, and whether no other pair with its second id is linked more often."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for raw in batch.column(0):
                held.append(np.frombuffer(raw.as_buffer() or b"", np.int64))
                size += len(held[-1])
                if size > HELD:
                    new = np.concatenate([keys, *held])
                    keys, counts = summed(new, np.concatenate([counts, np.ones(size, np.int64)]))
                    held, size = [], 0
        keys, counts = summed(np.concatenate([keys, *held]), np.concatenate([counts, np.ones(size, np.int64)]))
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], schema=schema)

    total = links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = total.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return total.withColumn("second", second).join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def rated(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum`` in place of ``links``. ``counts`` has at most as many rows as the vocabularies have bytes."""
    table = counts.orderBy("pair").toArrow()
    known = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
    given = [f for f in rows.schema.fields if f.name != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            at = batch.schema.get_field_index("links")
            raw = batch.column(at)
            size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            place = np.searchsorted(pairs, np.frombuffer(b"".join(raw.to_pylist()), np.int64))
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            columns += [pa.array(sums_by_row(best[place].astype(np.int64), size)), pa.array(sums_by_row(n[place], size))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in given), "n_best", "count_sum"])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*given, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))


def align(docs: DataFrame, tokenizer_a: str | None = None, model_b: str | None = None, with_groups: bool = True) -> DataFrame:
    """Documents (doc_id, text) aligned between a byte-level vocabulary and a piece vocabulary.

    A row for each: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups
    (with ``with_groups``), n_best (links whose pair is the most frequent one
    of its second id), count_sum (corpus-wide counts of the pairs, summed over
    the links).
    """
    rows = saved(aligned(docs, tokenizer_a, model_b, with_groups))
    scratch = Scratch(docs.sparkSession)
    out = rated(rows, scratch.save(pair_counts(rows)))
    scratch.drop()
    return out


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: all documents, aligned between the two default vocabularies."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_groups=False)

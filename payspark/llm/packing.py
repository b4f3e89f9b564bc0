"""Packing by power-of-two decomposition.

A document's token ids, with an end id after them, are cut into pieces whose
lengths are powers of two: as many of the full length as fit, then the binary
digits of the rest from high to low. Every piece is a sequence of its own, so
no sequence crosses documents and none needs padding. Pieces of one length
form a bucket; a training batch draws from one bucket at a time.

There is no shuffle: pieces are made where the document is read. The upper
bits of ``sequence_id`` hold the bucket, so sorting or range partitioning by
it brings equal lengths together; ``write_buckets`` lays the buckets out as
folders.

Defined results: a null or empty text is one piece that holds the end id
alone; repeated rows are packed once each; a null ``doc_id`` stays null; other
columns are ignored; an empty table gives no rows. Documents of one length
don't compete for a place, as each piece is a sequence of its own. A very long
text is held in one task with its ids.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payspark.llm.arrowtext import as_strings, slices, words_of

LENGTH = 4096
END_ID = 2
#: Parts of words whose ids a worker keeps; beyond it the cache starts anew.
CACHED_PARTS = 300_000
#: Text handled at once: large, as a slice's words repeat.
SLICE = 12 << 20

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, bucket int, ids array<int>"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters take the short way: already composed, lower-cased one by one.
PLAIN = r"^[\x21-\x7e\x{a1}-\x{ff}]+$"
LETTER, NUMBER = r"a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{ff}", r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
#: The tokenizer's own split, for PLAIN lower-case words.
SPLIT = rf"('s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}]+)"
#: What a special token contains.
SPECIAL = "<|"


def gathered(place: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``place`` of a ragged array, one after the other, and their lengths."""
    begin, size = starts[place], starts[place + 1] - starts[place]
    ends = np.cumsum(size)
    return values[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


def bounds(sizes: np.ndarray | list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


#: What the short way stands for: composed, spaces joined, lower-cased; then cut at this pattern, without spaces.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def is_known(path: str) -> bool:
    """Whether a tokenizer's file normalizes and splits as the short way assumes."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    steps = (said.get("normalizer") or {}).get("normalizers")
    cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True}
    level = {k: cuts[-1].get(k) for k in ("type", "add_prefix_space", "use_regex")}
    return steps == NORMALIZER and len(cuts) == 2 and cuts[0] == split and level == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


class WholeTokenizer:
    """Ids of texts by any tokenizer, as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        ids = [np.array(found.ids, np.int32) for found in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.array([len(x) for x in ids], np.int64)


class WordTokenizer:
    """Ids of texts by a tokenizer that ``is_known``: it never joins characters across white space.

    Each distinct word of a slice is split once, each distinct part encoded
    once while the cache has it, and the texts' ids are gathered from these.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.parts = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def places(self, parts: list[str]) -> np.ndarray:
        """Of each part its number among the known ones; new ones are encoded, many in one call."""
        if len(self.known) + len(parts) > CACHED_PARTS:
            self.clear()
        new = [p for p in parts if p not in self.known]
        ids, sizes = [self.ids], [np.zeros(0, np.int64)]
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            found = self.parts.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
        self.ids = np.concatenate(ids)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds and ids of each word; words that are not plain go through the whole tokenizer."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, SPECIAL)))
        spaced = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), SPLIT, r"\1 ")
        flat, per_word = words_of(spaced)
        coded = flat.dictionary_encode()
        ids, size = gathered(self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()], self.starts, self.ids)
        odd = [self.whole.encode(w, add_special_tokens=False).ids for w in words.filter(pc.invert(plain)).to_pylist()]
        short = plain.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(words), np.int64)
        sizes[short], sizes[~short] = np.diff(bounds(size)[bounds(per_word)]), list(map(len, odd))
        if not odd:
            return bounds(sizes), ids
        out, mine = np.empty(sizes.sum(), np.int32), np.repeat(short, sizes)
        out[mine], out[~mine] = ids, [i for x in odd for i in x]
        return bounds(sizes), out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        flat, per_text = words_of(texts)
        coded = flat.dictionary_encode()
        starts, ids = self.of_words(coded.dictionary)
        out, size = gathered(coded.indices.to_numpy(), starts, ids)
        return out, np.diff(bounds(size)[bounds(per_text)])


@lru_cache(maxsize=2)
def text_tokenizer(path: str) -> WordTokenizer | WholeTokenizer:
    """The short way where the file allows it, else the tokenizer itself."""
    return WordTokenizer(path) if is_known(path) else WholeTokenizer(path)


def binary_pieces(lengths: np.ndarray, full: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of so many tokens: each piece's row, start and length, in order."""
    bits = 1 << np.arange(full.bit_length() - 2, -1, -1, dtype=np.int64)
    counts = np.concatenate([lengths[:, None] // full, (lengths[:, None] % full & bits) > 0], axis=1).astype(np.int64)
    size = np.repeat(np.tile(np.concatenate([[full], bits]), len(lengths)), counts.ravel())
    row = np.repeat(np.arange(len(lengths)), counts.sum(axis=1))
    before = np.concatenate([[0], np.cumsum(size)])[:-1]
    return row, before - (np.cumsum(lengths) - lengths)[row], size


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Sequences of ``docs`` (doc_id, text): one row per piece, see ``PIECES``.

    ``length`` must be a power of two. ``sequence_id`` is unique: bucket, task
    and the task's running number, from high to low bits. ``offset`` is 0, as
    each sequence holds one piece.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kinds = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("bucket", pa.int32()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(kinds if with_ids else kinds[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = text_tokenizer(tokenizer or default_tokenizer())
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, counts = words.encode(as_strings(part.column("text")))
                ends = np.cumsum(counts)
                stream = np.full(len(ids) + len(counts), end_id, np.uint32)
                stream[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                total = counts + 1
                row, start, size = binary_pieces(total, length)
                bucket = np.log2(size).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(size)])
                raw = memoryview(stream.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.int64, len(row))
                own = (bucket.astype(np.int64) << 58) | (np.int64(task) << 36) | (number + np.arange(len(row)))
                number += len(row)
                columns = [part.column("doc_id").cast(pa.int64()).take(pa.array(row)), *map(pa.array, (start, size, crc, total[row], own, np.zeros(len(row), np.int64), bucket))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(stream.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = PIECES if with_ids else PIECES.removesuffix(", ids array<int>")
    return docs.select("doc_id", "text").mapInArrow(run, out)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write ``pieces`` with a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: all documents in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)

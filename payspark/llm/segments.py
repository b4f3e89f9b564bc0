"""Texts cut where neither of two tokenizers joins characters, each distinct segment handled once.

A cut is before each space that follows another character than white space.
Byte-level vocabularies split texts there before they merge, and piece
vocabularies without a piece of a space inside can't merge across it, so the
tokens of a text are those of its segments, one after the other. Words repeat,
so a worker keeps what it found for a segment.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from payspark.llm.arrowtext import data_of, offsets_of, strings_from

# Fixed value: how the vocabulary's own tokenizer splits texts.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters encoded in one call, and the longest segment that joins others.
CHUNK, LONGEST = 1 << 16, 1 << 12


#: Of each byte whether it is white space or a control (0), another ASCII character (1), or part of a longer one (2).
KINDS = np.array([0 if b <= 0x20 or b == 0x7F else 1 if b < 0x7F else 2 for b in range(256)], np.uint8)


def solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte ``at`` is surely no white space."""
    kind = KINDS[data[at]]
    out = kind == 1
    wide = np.flatnonzero(kind == 2)
    if len(wide):
        last, one, two = (np.where(at[wide] >= n, data[np.maximum(at[wide] - n, 0)], 0) for n in range(3))
        blank = (one == 0xC2) & ((last == 0x85) | (last == 0xA0))
        blank |= (two == 0xE2) & (one == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
        blank |= (two == 0xE2) & (one == 0x81) & (last == 0x9F) | (two == 0xE3) & (one == 0x80) & (last == 0x80)
        blank |= (two == 0xE1) & ((one == 0x9A) & (last == 0x80) | (one == 0xA0) & (last == 0x8E))
        out[wide] = ~blank
    return out


def segments_of(texts: pa.StringArray, cut: bool = True) -> tuple[pa.StringArray, np.ndarray]:
    """All segments in order, and how many each text has; an empty text has none. Without ``cut`` a text is one segment."""
    data, bounds = data_of(texts), offsets_of(texts)
    first = np.zeros(len(data) + 1, bool)
    if cut and len(data):
        spaces = np.flatnonzero(data[1:] == 0x20)
        first[spaces[solid(data, spaces)] + 1] = True
    first[bounds] = True
    first[len(data)] = False
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
    return strings_from(np.ascontiguousarray(data), np.append(starts, len(data))), counts


def joinable(segments: pa.StringArray) -> np.ndarray:
    """Segments that start with a space, end in another character and are short: one after the other they are cut as they are apart."""
    data, bounds = data_of(segments), offsets_of(segments)
    if not len(data):
        return np.zeros(len(segments), bool)
    size = np.diff(bounds)
    last = np.maximum(bounds[1:] - 1, 0)
    return (size > 1) & (size <= LONGEST) & (data[np.minimum(bounds[:-1], len(data) - 1)] == 0x20) & solid(data, last)


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is visible, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer:
    """A byte-level vocabulary from a tokenizer's file. ``cuts`` tells whether texts may be encoded by segments.

    Where the file's merges are in the order of their ids and it splits texts
    as usual, short segments go through ranks, which is faster with the same
    ids; anything else goes through the tokenizer itself. With ``special`` the
    strings of special tokens in a text stand for these, else for themselves.
    """

    def __init__(self, path: str, special: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.reserved = [t["content"] for t in said.get("added_tokens") or [] if special or not t["special"]]
        letters = byte_letters()
        self.tokens = {i: bytes(map(letters.__getitem__, t)) for t, i in said["model"]["vocab"].items() if all(c in letters for c in t)}
        joined = [m if isinstance(m, str) else " ".join(m) for m in said["model"].get("merges", [])]
        level = said.get("pre_tokenizer") or {}
        self.cuts = not said.get("normalizer") and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and bool(level.get("use_regex", True))
        ranked = self.cuts and all(said["model"]["vocab"].get(m.replace(" ", "")) == 256 + k for k, m in enumerate(joined)) and len(self.tokens) == 256 + len(joined)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PARTS, mergeable_ranks={t: i for i, t in self.tokens.items()}, special_tokens={}) if ranked else None
        self.lengths = np.zeros(max(self.tokens, default=0) + 2, np.int64)
        self.lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]

    def one(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.int32) for found in self.whole.encode_batch(texts, add_special_tokens=False)]

    def together(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), np.int32)

    def measured(self, ids: np.ndarray, raw: bytes) -> np.ndarray | None:
        """Bytes of each token."""
        return self.lengths[ids]


class PieceTokenizer:
    """A piece vocabulary with byte fallback that puts a space before a text; texts are given with that space."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.tokens = {i: bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.fast = self.own
        self.lengths = np.array([len(self.tokens[i]) for i in range(len(pieces))], np.int64)
        self.alone = np.array([self.own.piece_to_id("▁")], np.int32)

    def one(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found, np.int32) if len(t) > 1 else self.alone for t, found in zip(texts, self.own.encode([t[1:] for t in texts], num_threads=1))]

    def together(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text[1:], num_threads=1), np.int32)

    def measured(self, ids: np.ndarray, raw: bytes) -> np.ndarray | None:
        """Bytes of each token; None where they don't spell the text, as with a character that stands for a space."""
        return self.lengths[ids] if b"".join(map(self.tokens.__getitem__, ids.tolist())) == raw else None


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, special: bool = False) -> ByteTokenizer:
    return ByteTokenizer(path, special)


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def encoded(segments: pa.StringArray, own: ByteTokenizer | PieceTokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and how many each has."""
    join = joinable(segments) if own.fast is not None and own.cuts else np.zeros(len(segments), bool)
    sizes = np.zeros(len(segments), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    alone = [np.flatnonzero(~join)]
    many = np.flatnonzero(join)
    bytes_of = pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(bytes_of[many]) // CHUNK
    for some in np.split(many, np.flatnonzero(np.diff(part)) + 1) if len(many) else ():
        raw = data_of(segments.take(pa.array(some))).tobytes()
        ids = own.together(raw.decode())
        lengths = own.measured(ids, raw)
        if lengths is None:
            alone.append(some)
            continue
        ends = np.searchsorted(np.cumsum(lengths), np.cumsum(bytes_of[some])) + 1
        sizes[some] = np.diff(ends, prepend=0)
        found.append((some, ids))
    rest = np.sort(np.concatenate(alone))
    for at in range(0, len(rest), 1000):
        some = rest[at : at + 1000]
        ids = own.one(segments.take(pa.array(some)).to_pylist())
        sizes[some] = [len(x) for x in ids]
        found.append((some, np.concatenate(ids)))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], np.int32)
    for some, ids in found:
        size = sizes[some]
        out[np.repeat(starts[some] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
    return out, sizes


def gathered(place: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``place`` of a ragged array, one after the other, and their lengths."""
    begin, size = starts[place], starts[place + 1] - starts[place]
    ends = np.cumsum(size)
    return values[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class Numbered:
    """Numbers of segments that a worker has met, from 0; beyond ``most`` bytes of them it starts anew."""

    def __init__(self, most: int):
        self.most, self.kept, self.known = most, 0, {}

    def places(self, segments: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, bool]:
        """Of each distinct segment its number; those that are new, in the order of their numbers; whether the others were forgotten."""
        names = segments.to_pylist()
        new = np.array([n not in self.known for n in names], bool)
        more = int(pc.sum(pc.binary_length(segments.filter(pa.array(new)))).as_py() or 0)
        fresh = self.kept > 0 and self.kept + more > self.most
        if fresh:
            self.known, self.kept = {}, 0
            new[:] = True
            more = int(pc.sum(pc.binary_length(segments)).as_py() or 0)
        self.kept += more
        first = len(self.known)
        added = [n for n, is_new in zip(names, new.tolist()) if is_new]
        self.known.update(zip(added, range(first, first + len(added))))
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names)), segments.filter(pa.array(new)), fresh


class TextCoder:
    """Ids of whole texts by a byte-level vocabulary, special tokens included."""

    def __init__(self, path: str):
        self.own = byte_tokenizer(path, special=True)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has.

        Texts with a long run without a cut, on which ranks fail, or with a
        special token go through the tokenizer itself.
        """
        flat, per_text = segments_of(texts)
        ends = np.concatenate([[0], np.cumsum(per_text)])
        longer = np.concatenate([[0], np.cumsum(np.diff(offsets_of(flat)) > LONGEST)])
        slow = longer[ends[1:]] > longer[ends[:-1]] if self.own.fast is not None else np.ones(len(texts), bool)
        for word in self.own.reserved:
            slow |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for k, text in zip(np.flatnonzero(~slow).tolist(), texts.filter(pa.array(~slow)).to_pylist()):
            ids[k] = self.own.together(text)
        for k in np.flatnonzero(slow).tolist():
            (ids[k],) = self.own.one([texts[k].as_py()])
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.fromiter(map(len, ids), np.int64, len(ids))

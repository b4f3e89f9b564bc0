"""Alignment of two vocabularies against a plain one, from the libraries' own ids of whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from payspark.llm import alignment as L
from payspark.llm import segments as S

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "a", " a", "a ", "the cat's hat,  and\nmore\n\n  lines\t.", "café naïve – “quoted”\xa0text", "日本語のテキスト", "a▁b", "▁", "<|endoftext|> <s> <0x41>", "x\x00y\x1cz\x85w",
    "tab\there 1234567 3.14", "word " * 3000, "z" * 9000 + " end", " " * 9000 + "end", "same text", "same text", "emoji \U0001f600 ok", "　 wide", "trailing\n",
]


@pytest.fixture(scope="module")
def plain():
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = S.byte_letters()
    byte = lambda i: bytes(letters[c] for c in whole.id_to_token(i))
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        """Groups of ids, by the ends of all tokens."""
        if not text:
            return []
        a, b = whole.encode(" " + text, add_special_tokens=False).ids, model.encode(text, num_threads=1)
        if b"".join(map(byte, a)) != (" " + text).encode() or b"".join(map(piece, b)) != (" " + text).encode():
            return []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((byte, a), (piece, b))]
        both = sorted(set(ends[0]) & set(ends[1]))
        out, i, j = [], 0, 0
        for end in both:
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out

    return groups


def expected(plain, rows):
    found = [plain(t) for _, t in rows]
    count = Counter((a[-1], b[-1]) for g in found for a, b in g)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for (doc_id, _), g in zip(rows, found):
        pairs = [(a[-1], b[-1]) for a, b in g]
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sha = hashlib.sha256(written.encode()).hexdigest() if g else ""
        out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), sha))
    return out


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("parts", [1, 4])
def test_align(spark, plain, parts):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "an id met again")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, links string").repartition(parts)
    found = L.align(docs).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[n] for n in names) for r in found), key=key) == sorted(expected(plain, rows), key=key)
    for r in found:
        assert hashlib.sha256(";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in r.groups).encode()).hexdigest() == r.groups_sha256 or not r.groups
    assert L.align(docs.limit(0), with_groups=False).count() == 0


def test_query_on_a_table(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = L.token_alignment(spark, "/root/testdata/sf0.001").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, found), key=key) == sorted(expected(plain, [(r.doc_id, r.text) for r in docs]), key=key)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab 1.'s\n\t\xa0　é好’\x85\x1c<|>\U0001f600", max_size=30), min_size=1, max_size=6))
def test_segments_have_the_tokens_of_whole_texts(texts):
    own, other = S.byte_tokenizer(BYTES), S.piece_tokenizer(PIECES)
    spaced = [" " + t for t in texts if t] or [" x"]
    flat, per_text = S.segments_of(pa.array(spaced))
    assert "".join(flat.to_pylist()) == "".join(spaced)
    for tokens, whole in ((own, lambda t: own.whole.encode(t, add_special_tokens=False).ids), (other, lambda t: other.own.encode(t[1:], num_threads=1))):
        ids, sizes = S.encoded(flat, tokens)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per_text)])]
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole(t) for t in spaced]


def test_remembering_ends(plain):
    own = L.Aligner(BYTES, PIECES)
    own.numbers.most = 40  # forgets at nearly every call
    for _ in range(2):
        for text in ("one two three four", "five six seven eight nine", "two nine"):
            totals, raw, _ = own.align(pa.array([text, text]))
            want = plain(text)
            assert totals[1].tolist() == [sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want)]
            assert np.frombuffer(raw[0], np.int64).tolist() == [a[-1] << L.SHIFT | b[-1] for a, b in want]


def test_transducer_refuses_other_bytes():
    own = L.Transducer({1: b"ab", 2: b"c"}, {1: b"a", 2: b"bc", 3: b"x"})
    assert own.groups([1, 2], [1, 2]) == [(2, 2)]
    assert own.groups([1, 2], [1, 3]) is None and own.groups([1], [1]) is None and own.groups([], [1]) is None and own.groups([9], [1]) is None
    assert own.groups([], []) == [] and len(own.moves) >= 4

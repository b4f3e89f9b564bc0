"""Packing: binary lengths, ids equal to the tokenizer's, round trip."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from payspark.llm import packing as P

TEXTS = ["", None, "a", "don't stop <|endoftext|> now", "ΑΣ ́a İstanbul ½²a_b\xa0c", "x " * 5000, "é" * 20_000, "line\nline\tline", "x", "x"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 20_000), min_size=1, max_size=8))
def test_binary_pieces(lengths):
    row, start, size = P.binary_pieces(np.array(lengths), 4096)
    for k, n in enumerate(lengths):
        own = size[row == k].tolist()
        assert sum(own) == n and all(s & (s - 1) == 0 and s <= 4096 for s in own) and own == sorted(own, reverse=True)
        assert start[row == k].tolist() == np.cumsum([0, *own])[:-1].tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pack(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    assert P.is_known(path) == (name == "word_bpe_49k.json")  # any other file goes the long way
    whole = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "no id", "y")] + [(100, "met twice here", "x")] * 2, "doc_id long, text string, start string").repartition(3)
    rows = P.pack(docs, path).collect()
    for k, text in [*enumerate(TEXTS), (None, "no id")]:
        want = whole.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == want
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) == 2**r.bucket and r.doc_tokens == len(want) and r.offset == 0 for r in own)
    twice = [r for r in rows if r.doc_id == 100]  # a row that comes twice is packed twice
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens and all(sum(r.start == s.start for s in twice) == 2 for r in twice)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert P.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.pack(docs, length=100)


def test_buckets_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    P.write_buckets(P.pack(docs), str(tmp_path / "out"))
    assert {r.bucket for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {2, 1}

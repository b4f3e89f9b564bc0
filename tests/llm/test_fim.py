"""Fill-in-the-middle: tokens and cuts against a plain pattern, exact round trip."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from payspark.llm import fim as M

TEXTS = ["", None, "a", "1", "ab cd", "Año über, naïve 12", "<P>", "a <S> b", "<M", "x<<P", "P>S<M>", "日本語 text 日本", "\n\n\t ", "a\x00b\U0001f600c", "ab" * 50_000, "é" * 100_000, "same text", "same text"]


def plain(doc_id, text):
    """The contract, word by word."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    found = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(found[k : k + 8], 16) for k in (0, 8, 16, 24)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, len(prefix), len(middle), sha(out), sha(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abPSM<>. \né日\U0001f600\x00Z@[`{", max_size=40), st.integers(-5, 10**12))
def test_round_trip(text, doc_id):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    scan = M.Scan(text)
    assert scan.units == len(units) and scan.has_sentinel == bool(re.search("<[PSM]>", text))
    assert [scan.place(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
    found = M.transform(doc_id, text)
    assert M.restore(found.output, found.form) == text


@pytest.mark.parametrize("parts", [1, 3])
def test_query_rows(spark, parts):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "no id here", "y"), (None, None, "y"), (7, "an id met again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(parts)
    found = M.fill_in_middle(docs).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[:7]) for r in found), key=key) == sorted((plain(i, t) for i, t, _ in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert all(hashlib.sha256(r.output.encode()).hexdigest() == r.output_sha256 for r in found)
    assert M.fill_in_middle(docs.limit(0)).count() == 0

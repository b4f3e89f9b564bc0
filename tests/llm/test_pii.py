"""Strict patterns against regular expressions, the labelers' model, redaction."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from payspark.llm import pii as P

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
PIECES = ["@", "a", "é", ".", "1", "9", "0", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "1.2.3.4", "256", "\n", "x@y.z", "[at]", 'token = "', "abcdef0123456789abcd", "+1 (555) 123-4567", "00000000000000000000"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {0: True, 1: kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 2: 13 <= len(digits) <= 19 and P.luhn(digits.encode()), 3: 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, *m.span()))
    return sorted(out)


def strict(texts):
    begins, found, data = P.candidates(pa.array(texts))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    out = [[] for _ in texts]
    for kind, a, b, sure in found:
        row = int(np.searchsorted(begins, a, side="right") - 1)
        P.votes(data, kind, a, b, sure)
        if sure:
            out[row].append((kind, int(points[a] - points[begins[row]]), int(points[b] - points[begins[row]])))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=6))
def test_strict_spans(texts):
    assert strict(texts) == [brute(t) for t in texts]


LOOSE = {
    0: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+",
    2: r"[0-9](?:[\x20-]?[0-9])+",
    3: r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    4: r"(?<=[=:])( ?[\"']?)([A-Za-z0-9_/+-]{16,})",
    5: r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    6: r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
SEEN = [
    "write " + "long.local.part" * 12 + " [at] " + "sub-domain" * 9 + " (dot) example [dot] org now", "me(at)x.y.z.a.b.c.d.e.f.g.h.i.org", "card 1234 5678 9012 3456 no", "tel (555) 123-4567 or 555.123.4567",
    "key = 'abcd1234efgh5678ijkl' and x:0123456789abcdef0", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432.", "ssn 123-45-6789 not 1123-45-6789", "a@b.c [at] d.e 1.2.3.4",
]


def plain_added(text):
    strict_ones = brute(text)
    out = []
    for kind, pattern in LOOSE.items():
        for m in re.finditer(pattern, text):
            a, b = m.span(2) if kind == 4 else m.span()
            size = len(re.sub("[^0-9]", "", m.group()))
            if (kind != 2 or 13 <= size <= 19) and not any(x < b and a < y for _, x, y in strict_ones):
                out.append((kind, a, b))
    return sorted(out)


def test_added_candidates_are_those_of_plain_patterns():
    for text in SEEN:
        assert [c[:3] for c in P.candidates(pa.array([text]))[1] if not c[3]] == plain_added(text), text
    assert [k for t in SEEN for k, *_ in plain_added(t)].count(5) == 2


def test_added_spans(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(SEEN * 40)], "doc_id long, text string")
    model = P.fit(docs)
    found, name = P.find_personal_data(docs, model)
    for r in found.collect():
        want = [(k, a, b, True) for k, a, b in brute(r.text)]
        for kind, a, b in plain_added(r.text):
            pattern, code = np.array([P.votes(r.text.encode(), kind, a, b, False)]), np.array([P.shape(r.text.encode(), a, b)])
            if model.probability(np.array([kind]), pattern, code)[0] >= 0.5:
                want.append((kind, a, b, False))
        assert r[name].spans == ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b, _ in sorted(want))
    assert P.account("GB82WEST12345698765432") and not P.account("GB82WEST12345698765433")


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + "@ " + "1" * 300_000 + ". " + "1." * 100_000 + " +" * 50_000 + "@" * 100_000
    assert strict([text]) == [[(1, s, e) for _, s, e in strict([text])[0]]]


def counted(spark, kind, pattern, code):
    rows, n = np.unique(np.stack([kind, pattern, code], axis=1), axis=0, return_counts=True)
    return spark.createDataFrame([(*map(int, r), int(k)) for r, k in zip(rows, n)], "kind int, pattern int, code int, n long").repartition(3)


def test_expectation_maximisation_finds_reliable_labelers(spark):
    rng = np.random.default_rng(7)
    truth = rng.random(4000) < 0.4
    vote = np.where(rng.random((4000, P.LABELERS)) < 0.85, np.where(truth[:, None], 2, 0), 1)
    vote[:, 6] = rng.integers(0, 3, 4000)
    pattern, zero = (vote * 3 ** np.arange(P.LABELERS)).sum(axis=1), np.zeros(4000, np.int64)
    model = P.trained(counted(spark, zero, pattern, zero))
    assert ((model.probability(zero, pattern, zero) > 0.5) == truth).mean() > 0.97
    assert model.reliability[0, 1, 0, 2] > 0.7 and model.reliability[0, 1, 6, 2] < 0.5


def test_the_classifier_sees_the_span(spark):
    """Two spans with the same votes, most of them abstentions, are told apart by what spans of reliable votes look like."""
    rng = np.random.default_rng(11)
    truth = rng.random(6000) < 0.5
    says = rng.random((6000, P.LABELERS)) < 0.3  # mostly nobody votes
    vote = np.where(says, np.where(truth[:, None] ^ (rng.random((6000, P.LABELERS)) < 0.05), 2, 0), 1)
    spans = [b"Zk3v9Qp0aL7x" if t else b"aaaa aaaa" for t in truth]
    code = np.array([P.shape(s, 0, len(s)) for s in spans])
    pattern, kind = (vote * 3 ** np.arange(P.LABELERS)).sum(axis=1), np.full(6000, 4)
    model = P.trained(counted(spark, kind, pattern, code))
    silent = (vote == 1).all(axis=1)
    assert silent.sum() > 100
    found = model.probability(kind, pattern, code) >= 0.5
    assert (found[silent] == truth[silent]).mean() > 0.95  # votes alone give all of them one answer
    assert (found == truth).mean() > 0.97


def test_span_features():
    data = 'x = "Ab1-é" y'.encode()
    start = data.index(b"Ab1")
    code, values = P.shape(data, start, start + 6), []
    for base in reversed(P.SHAPES):
        values.append(code % base)
        code //= base
    assert values[::-1] == [3, 3, 0, 3, 3, 1, 1] and code == 0
    assert P.shapes_of(np.array([P.shape(b"1", 0, 1)])).sum() == len(P.SHAPES) and P.shape(b"7" * 1000, 0, 1000) < np.prod(P.SHAPES)


def test_documents(spark):
    seen = ["mail bob.1@mail.example.com now", "host 10.20.30.40 up", "card 4111 1111 1111 1111 ok", "call +1 (555) 123-4567 é", 'é token = "0123abcd4567ef890123" x', "clean prose", "", None, "1.2.3.400 v 1.2.3.4.5"]
    rows = [(k, t, 3) for k, t in enumerate(seen * 6)] + [(None, seen[0], 3), (0, seen[0], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(3)
    found, name = P.find_personal_data(docs, P.fit(docs))
    for r in found.collect():
        base = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in brute(r.text or ""))
        own = r[name]
        assert own.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [own.n_email, own.n_ip, own.n_card, own.n_phone] == [sum(k == i for k, _, _ in brute(r.text or "")) for i in range(4)]
        assert set(filter(None, base.split(","))) <= set(own.spans.split(",")) and own.n_spans == len(list(filter(None, own.spans.split(","))))
        assert r.text != "clean prose" or own.spans == ""
    clean = P.redact(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[0].text == "mail <EMAIL> now" and texts[0].n_chars == len(texts[0].text) and texts[5].text == "clean prose" and texts[7].text is None
    assert P.redact(docs.limit(0)).count() == 0

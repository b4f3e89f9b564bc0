"""Personal data: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates are found by the strict patterns of four kinds (email, ip, card,
phone) and by looser ones, among them secrets after ``=`` or ``:``. Seven
labelers (strict pattern, checksum or format, gazetteer, words before, words
that speak against, neighbouring characters, repetition) vote for, against or
abstain. The votes of all candidates of the corpus are counted by kind and
pattern of votes, a table of at most kinds x 3^7 rows whatever the input.
From it, expectation-maximisation estimates each labeler's reliability and
each pattern's probability. These are the labels that train the final span
classifier, a logistic regression. It sees the votes and, beyond them, the span
itself: its length, the entropy of its characters, its share of digits, its
case, its separators and the characters around it. Its Newton steps sum
gradients in tasks, over a table of candidates counted by votes and span
features, so the driver holds a matrix of fixed size. Strict matches always
stay; other candidates are spans if the classifier gives them at least one
half.

Both passes are maps over whole texts; only the counted candidates are shuffled.

Defined results: a null or empty text has no spans; repeated rows have the
same spans each; starts and ends count code points, ends exclusive; an added
span never overlaps a strict one; other columns pass through ``redact``, which
recomputes ``n_chars`` where there is one; an empty table gives no rows. A
probability of just one half is a span. A very long text is held in one task
with its candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payspark.llm.arrowtext import annotate, as_strings, data_of, offsets_of, slices
from payspark.llm.checkpoints import Scratch

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
STRICT = 4
LABELERS = 7

# Patterns of the strict kinds.
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
# Looser patterns, and what the labelers know.
LOOSE_PHONE = re.compile(rb"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])")
HIDDEN_AT = re.compile(rb"[\[(](?:at|AT)[\])]")
HIDDEN_DOMAIN = re.compile(rb" ?[A-Za-z0-9-]+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")
IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(rb"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(rb"[=:] ?[\"']?([A-Za-z0-9_/+-]{16,})")
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai dev app eu uk de fr es it nl be ch at pl pt se no dk fi ie us ca mx br ar au nz jp cn in ru".split())
COUNTRIES = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98".split())
BANKS = frozenset(
    "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU"
    " NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM TN TR UA VA VG XK".split()
)
SECRET_HEADS = ("sk-", "pk-", "rk_", "ghp_", "gho_", "github_pat_", "glpat-", "xox", "AKIA", "ASIA", "AIza", "ya29.", "eyJ", "hf_", "npm_", "SG.")
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|reach|address|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|client|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|pay|tarjeta|carte|karte", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|tél|anruf|llam", re.I),
    "secret": re.compile(r"token|secret|api.?key|passw|pwd|credential|private|bearer", re.I),
    "iban": re.compile(r"iban|account|bank|transfer|cuenta|konto|compte", re.I),
    "ssn": re.compile(r"ssn|social|security|insured|patient|tax", re.I),
}
AGAINST = re.compile(r"(version|release|isbn|issn|page|pp|fig|figure|section|chapter|sha1|sha256|md5|commit|http|https|www|no|nr|№|[$€£#v])\W{0,3}$", re.I)

FIELDS = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:STRICT]), T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType()),
])


def luhn(digits: bytes) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        d -= 48
        total += d if place % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def strict_spans(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the strict matches, leftmost and non-overlapping for each kind.

    In time linear in the data: an email is found from its ``@``, as nothing
    before one can match without it; numbers with dots are taken four parts at
    a time.
    """
    done, at = 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > done and data[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(data, at + 1) if start < at else None
        if found:
            yield 0, start, found.end()
        done = found.end() if found else at + 1
        at = data.find(b"@", done)
    for chain in NUMBERS.finditer(data):
        start, parts = chain.start(), chain.group().split(b".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := x.lstrip(b"0")) < 4 and int(p or b"0") < 256 for x in four):
                yield 1, start, end
            start = end + 1
    for found in CARD.finditer(data):
        digits = found.group().replace(b" ", b"").replace(b"-", b"")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield 2, found.start(), found.end()
    for found in PHONE.finditer(data):
        if 9 <= sum(48 <= c < 58 for c in found.group()) <= 15:
            yield 3, found.start(), found.end()


ALNUM = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def starting(pattern: re.Pattern, data: bytes, before: frozenset[int]) -> Iterator[tuple[int, int]]:
    """Matches that none of the bytes ``before`` precedes; a pattern that looked back itself would be slower."""
    at = 0
    while found := pattern.search(data, at):
        if found.start() and data[found.start() - 1] in before:
            at = found.start() + 1
        else:
            yield found.span()
            at = found.end()


def loose_spans(data: bytes) -> Iterator[tuple[int, int, int]]:
    """Further candidates; those that overlap a strict match are dropped later."""
    for at in HIDDEN_AT.finditer(data):
        end = at.start() - (data[at.start() - 1 : at.start()] == b" ")
        start = end
        while start > 0 and data[start - 1] in LOCAL:
            start -= 1
        if start < end and (found := HIDDEN_DOMAIN.match(data, at.end())):
            yield 0, start, found.end()
    for found in CARD.finditer(data):
        if 13 <= sum(48 <= c < 58 for c in found.group()) <= 19:
            yield 2, found.start(), found.end()
    for found in LOOSE_PHONE.finditer(data):
        yield 3, found.start(), found.end()
    for found in SECRET.finditer(data):
        yield 4, *found.span(1)
    for kind, pattern, before in ((5, IBAN, ALNUM), (6, SSN, frozenset(b"0123456789-"))):
        for a, b in starting(pattern, data, before):
            yield kind, a, b


def account(own: str) -> bool:
    """The check of an account number: its letters as numbers, country and check digits last, leave 1 by 97."""
    plain = own.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def votes(data: bytes, kind: int, start: int, end: int, strict: bool) -> int:
    """The labelers' votes on a candidate as digits to base 3: 0 against, 1 abstains, 2 for."""
    own = data[start:end].decode()
    digits = [c for c in own if c.isascii() and c.isdigit()]
    before = data[max(0, start - 48) : start].decode(errors="ignore").rpartition("\n")[2]
    fine, listed = 1, 1
    if kind == 0:
        fine, listed = 2 if len(own) <= 254 and ".." not in own else 0, 2 if re.split(r"[^A-Za-z0-9-]+", own.rstrip("])"))[-1].lower() in ENDINGS else 0
    elif kind == 1:
        parts = [int(p) for p in own.split(".")]
        fine, listed = 2 if not any(len(p) > 1 and p[0] == "0" for p in own.split(".")) else 0, 2 if 0 < parts[0] < 224 and parts[0] != 127 else 0
    elif kind == 2:
        fine, listed = 2 if luhn("".join(digits).encode()) else 0, 2 if digits[0] in "3456" else 0
    elif kind == 3:
        fine, listed = 2 if 10 <= len(digits) <= 13 else 0, 2 if own[0] == "+" and "".join(digits).startswith(COUNTRIES) else 1
    elif kind == 5:
        fine, listed = 2 if account(own) else 0, 2 if own[:2] in BANKS else 0
    elif kind == 6:
        fine, listed = 0 if own[:3] in ("000", "666") or own[0] == "9" or own[4:6] == "00" or own[7:] == "0000" else 2, 1
    else:
        fine, listed = 2 if digits and any(c.isalpha() for c in own) else 0, 2 if own.startswith(SECRET_HEADS) else 1
    near = (data[start - 1 : start] + data[end : end + 1]).decode(errors="ignore")
    found = (
        2 if strict else 1,
        fine,
        listed,
        2 if CONTEXT[KINDS[kind]].search(before) else 1,
        0 if AGAINST.search(before) else 1,
        0 if any(c.isalnum() for c in near) else 2,
        0 if len(set(digits)) == 1 else 1,
    )
    return sum(v * 3**k for k, v in enumerate(found))


#: Span features, each with so many values: how long, how mixed, how many digits, letters of which case, separators, what is before and after.
SHAPES = (8, 8, 4, 4, 4, 4, 4)


def _around(text: str) -> int:
    """0 for white space or an end, 1 for a quote or a sign of assignment, 2 for other characters, 3 for letters and digits."""
    return 0 if not text or text.isspace() else 1 if text in "\"'`=:" else 3 if text.isalnum() else 2


def shape(data: bytes, start: int, end: int) -> int:
    """The span's own features as one number, digits to the bases ``SHAPES``."""
    own = data[start:end]
    size = len(own)
    share = np.bincount(np.frombuffer(own, np.uint8), minlength=1)
    share = share[share > 0] / size
    digits = sum(48 <= c < 58 for c in own)
    case = any(97 <= c < 123 for c in own) + 2 * any(65 <= c < 91 for c in own)
    marks = len({c for c in own if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)})
    before, after = (data[max(0, start - 1) : start].decode(errors="replace"), data[end : end + 1].decode(errors="replace"))
    values = (min(7, size.bit_length()), min(7, int(-1.5 * (share * np.log2(share)).sum())), min(3, 4 * digits // size), case, min(3, marks), _around(before), _around(after))
    code = 0
    for value, base in zip(values, SHAPES):
        code = code * base + value
    return code


def shapes_of(code: np.ndarray) -> np.ndarray:
    """One column for each value of each span feature."""
    out = []
    for base in reversed(SHAPES):
        out.append(np.eye(base)[code % base])
        code = code // base
    return np.concatenate(out[::-1], axis=1)


def digits_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(LABELERS) % 3


def candidates(texts: pa.StringArray) -> tuple[np.ndarray, list[tuple[int, int, int, bool]], bytes]:
    """Sorted candidates (kind, start, end, strict) in the texts joined by line ends, these as bytes, and the texts' starts there."""
    bounds = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    data = data_of(pc.binary_join(bounds, "\n")).tobytes()
    strict = sorted(strict_spans(data), key=lambda s: s[1:])
    starts = np.array([s[1] for s in strict] + [len(data) + 1])
    reach = np.maximum.accumulate(np.array([s[2] for s in strict] + [len(data) + 1])) if strict else np.array([len(data) + 1])
    more, last = [], {}
    for kind, a, b in loose_spans(data):
        k = int(np.searchsorted(starts, b))
        if (k == 0 or reach[k - 1] <= a) and last.get(kind, 0) <= a:
            more.append((kind, a, b, False))
            last[kind] = b
    return offsets_of(texts)[:-1] + np.arange(len(texts)), sorted([*((*s, True) for s in strict), *more]), data


def weighed(kind: np.ndarray, pattern: np.ndarray, count: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: the probability of each pattern, and each kind's labeler reliabilities P(vote | no span, span)."""
    vote = digits_of(pattern)
    lean = (vote == 2).sum(axis=1) - 1.5 * (vote == 0).sum(axis=1)
    p = 1 / (1 + np.exp(-(lean - 1.5)))
    table = np.zeros((len(KINDS), 2, LABELERS, 3))
    for _ in range(rounds):  # one pseudo-count of a fair labeler each
        prior = np.full((len(KINDS), 2), 1.0)
        table[:] = np.array([[0.3, 0.5, 0.2], [0.1, 0.5, 0.4]])[None, :, None, :] * 4
        for y, q in enumerate((1 - p, p)):
            np.add.at(prior[:, y], kind, q * count)
            for k in range(LABELERS):
                np.add.at(table[:, y, k], (kind, vote[:, k]), q * count)
        table /= table.sum(axis=3, keepdims=True)
        prior /= prior.sum(axis=1, keepdims=True)
        row = np.arange(len(kind))[:, None]
        each = [np.log(table[kind, y][row, np.arange(LABELERS), vote]).sum(axis=1) for y in (0, 1)]
        log = np.log(prior[kind]) + np.stack(each, axis=1)
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
    return p, table


def features(kind: np.ndarray, pattern: np.ndarray, code: np.ndarray) -> np.ndarray:
    vote = digits_of(pattern)
    return np.concatenate([np.eye(len(KINDS))[kind], (vote == 2).astype(float), (vote == 0).astype(float), shapes_of(code)], axis=1)


WIDTH = len(KINDS) + 2 * LABELERS + sum(SHAPES)
#: Newton steps, the penalty on weights, and the tasks that sum for a step.
STEPS, RIDGE, TASKS = 12, 0.05, 16


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def sums(weights: np.ndarray, labels: np.ndarray, kind: np.ndarray, pattern: np.ndarray, code: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the likelihood of some counted candidates, below one another; ``labels`` by kind and pattern."""
    x = features(kind, pattern, code)
    q = logistic(x, weights)
    return np.concatenate([(x.T @ (share * (labels[kind, pattern] - q)))[None], (x * (share * q * (1 - q))[:, None]).T @ x])


@dataclass
class SpanModel:
    """``weights`` of the span classifier, and each kind's labeler reliabilities P(vote | span)."""

    weights: np.ndarray
    reliability: np.ndarray

    def probability(self, kind: np.ndarray, pattern: np.ndarray, code: np.ndarray) -> np.ndarray:
        return logistic(features(kind, pattern, code), self.weights)


def trained(counted: DataFrame) -> SpanModel:
    """The model from candidates counted by kind, pattern and code: a saved table (kind, pattern, code, n)."""
    rows = sorted(tuple(r) for r in counted.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect())  # at most kinds x 3^7 rows
    table = np.array(rows, np.int64).reshape(-1, 3)
    p, reliability = weighed(table[:, 0], table[:, 1], table[:, 2].astype(np.float64))
    labels, weights = np.zeros((len(KINDS), 3**LABELERS)), np.zeros(WIDTH)
    labels[table[:, 0], table[:, 1]] = p
    scale = 1000 / max(table[:, 2].sum(), 1)

    def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH + 1, WIDTH))
        for batch in batches:
            kind, pattern, code, n = (batch.column(c).to_numpy() for c in ("kind", "pattern", "code", "n"))
            for at in range(0, len(kind), 4096):
                some = slice(at, at + 4096)
                total += sums(weights, labels, kind[some], pattern[some], code[some], n[some] * scale)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    for _ in range(STEPS if len(rows) else 0):
        step = counted.mapInArrow(lambda batches, weights=weights: run(batches, weights), "sums binary")
        total = sum(np.frombuffer(r["sums"]).reshape(WIDTH + 1, WIDTH) for r in step.collect())  # a matrix for each of TASKS tasks
        moved = np.linalg.solve(total[1:] + RIDGE * np.eye(WIDTH), total[0] - RIDGE * weights)
        weights = weights + moved
        if np.abs(moved).max() < 1e-6:
            break
    return SpanModel(weights, reliability)


def fit(docs: DataFrame) -> SpanModel:
    """Weigh the labelers by their votes on all candidates of ``docs``, and train the classifier on what they say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[int, int, int]] = Counter()
            for part in slices(batch):
                _, spans, data = candidates(as_strings(part.column("text")))
                found.update((k, votes(data, k, a, b, s), shape(data, a, b)) for k, a, b, s in spans)
            keys = [pa.array([key[k] for key in found], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(list(found.values()), pa.int64())], names=["kind", "pattern", "code", "n"])

    by = ("kind", "pattern", "code")
    counted = docs.select("text").mapInArrow(run, "kind int, pattern int, code int, n long").groupBy(*by).agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession)
    model = trained(scratch.save(counted.repartition(TASKS, *by)))
    scratch.drop()
    return model


def spans_of(texts: pa.StringArray, model: SpanModel) -> tuple[list[list[tuple[int, int, int, bool]]], bytes, np.ndarray]:
    """Of each text its spans (kind, start, end, strict) in bytes of the joined texts, these, and the texts' starts there."""
    begins, found, data = candidates(texts)
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(len(texts))]
    if found:
        kind = np.array([f[0] for f in found])
        strict = np.array([f[3] for f in found])
        pattern = np.array([votes(data, *f) for f in found])
        row = np.searchsorted(begins, np.array([f[1] for f in found]), side="right") - 1
        code = np.array([shape(data, a, b) for _, a, b, _ in found])
        for k in np.flatnonzero(strict | (model.probability(kind, pattern, code) >= 0.5)).tolist():
            out[row[k]].append(found[k])
    return out, data, begins


def find_personal_data(docs: DataFrame, model: SpanModel) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of ``FIELDS``, and that column's name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(texts: pa.StringArray) -> dict[str, list]:
        spans, data, begins = spans_of(texts, shared.value)
        points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int64)])
        said: dict[str, list] = {f.name: [] for f in FIELDS}
        for own, begin in zip(spans, begins.tolist()):
            written = [(f"{KINDS[k]}:{points[a] - points[begin]}:{points[b] - points[begin]}", strict) for k, a, b, strict in own]
            for k in range(STRICT):
                said[f"n_{KINDS[k]}"].append(sum(s[0] == k and s[3] for s in own))
            said["base_sha256"].append(hashlib.sha256(",".join(w for w, strict in written if strict).encode()).hexdigest())
            said["spans"].append(",".join(w for w, _ in written))
            said["n_spans"].append(len(written))
        return said

    return annotate(docs, describe, FIELDS)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def rewrite(texts: pa.StringArray) -> dict[str, list]:
        spans, data, begins = spans_of(texts, shared.value)
        ends = begins + np.diff(offsets_of(texts))
        out = []
        for own, begin, end in zip(spans, begins.tolist(), ends.tolist()):
            parts, at = [], begin
            for kind, a, b, _ in sorted(own, key=lambda s: s[1:]):
                if a >= at:
                    parts += [data[at:a], b"<%s>" % KINDS[kind].upper().encode()]
                at = max(at, b)
            out.append(b"".join([*parts, data[at:end]]).decode())
        return {"text": out}

    given = docs.columns
    changed, name = annotate(docs, rewrite, T.StructType([T.StructField("text", T.StringType())]))
    text = F.when(F.col("text").isNotNull(), F.col(f"{name}.text"))
    values = {c: F.col(c) for c in given} | {"text": text.alias("text")}
    if "n_chars" in given:
        values["n_chars"] = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars")).alias("n_chars")
    return changed.select(*(values[c] for c in given))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: the personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, name = find_personal_data(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.col(f"{name}.*"))

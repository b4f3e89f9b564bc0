"""License places against brute force, notices, a plan without Python."""

import random
import re

from payspark.llm import license_scan as L

TEXTS = [
    None, "", "MIT License mit license. x general PUBLIC license", "the apache license apache license version 2 0", "Mit", "!!mit, license?", "K mit licenKe MIT LICENSE",
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "mit " * 3000 + "license", "licensemit license", "mité license", "general public", "a general public license b general public license",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(L.UPPER, L.LOWER)))
    places = [(i, label) for label, phrase in L.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def plain_labels(text, weight):
    """Every template tried at every place of the text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(L.UPPER, L.LOWER)))
    labels, best = set(), 0.0
    for t in L.TEMPLATES:
        total = sum(weight[w] for w in t.words)
        key = list(t.words[t.key_start : t.key_start + t.key_length])
        for start in range(-len(t.words), len(words)):
            at = start + t.key_start
            if at < 0 or words[at : at + t.key_length] != key:
                continue
            share = sum(weight[w] for j, w in enumerate(t.words) if 0 <= start + j < len(words) and words[start + j] == w) / total
            if share >= L.ENOUGH:
                labels.add(t.label)
                best = max(best, min(share, 1.0))
    return ",".join(sorted(labels)), best


def damaged(body, share, seed):
    """The body with a share of its words replaced, whatever they are."""
    rnd = random.Random(seed)
    return " ".join(w if rnd.random() > share else "zz" + w for w in body.split())


TEXTS += [body for _, body, _ in L.BODIES] + [f"Copyright X. {damaged(body, share, k)} End." for k, (_, body, _) in enumerate(L.BODIES) for share in (0.05, 0.15, 0.4)]


def test_index_has_more_than_may_be_missing():
    weight = {w: 1.0 + len(w) for t in L.TEMPLATES for w in t.words}
    postings = L.postings_of(L.TEMPLATES, weight)
    for k, t in enumerate(L.TEMPLATES):
        has = sum(weight[w] for w in t.words if any(p // L.PLACE == k or (p + len(t.words)) // L.PLACE == k for p in postings.get(w, [])))
        assert has > (1 - L.ENOUGH) * sum(weight[w] for w in t.words)


def test_scan(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "mit license", "x"), (2, TEXTS[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)
    found = L.scan(docs)
    assert found.count() == len(rows)
    by_id = {r.doc_id: r for r in found.collect()}
    for k, text in enumerate(TEXTS):
        r = by_id[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [by_id[k].labels for k in (7, 8, 9, 10)] == ["apache,apache-2.0", "mit", "cc-by-nc", "gpl,gpl-3.0"]
    weight = {w: max(v, 1e-3) for w, v in L.weights_of(docs).items()}
    for k, text in enumerate(TEXTS):
        labels, score = plain_labels(text, weight)
        assert by_id[k].labels == labels and abs(by_id[k].score - score) < 1e-9
    assert by_id[None].n_base == 1 and by_id[1].score == 0.0
    assert L.scan(docs.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())

"""License scan with a positional rare-token index, in DataFrame functions alone.

The templates are bodies of licenses, notices and phrases. Their words are
weighed by inverse document frequency over all documents. The index keeps the
postings (template, position) of each template's highest-weighed words, as
many as hold more than 1 - ``ENOUGH`` of its weight. A file's words that are
in the index are its rarest license words; each, looked up, says where in the
file a template would have to begin. Postings that agree on that relative
position are one candidate. A candidate counts if the template's mandatory key
phrase stands there word for word and the matched share of the template's
weight is at least ENOUGH. As the rest is less than what the index has, no
place with enough weight is missed; a base phrase is a template that is all
key phrase, so each of its places is found.

Words are compared place by place: a text in which words are missing or added
matches up to there, so bodies are also cut into their sentences, each a
template of its own with the same label.

Both passes are row by row; only the frequencies of template words (some
hundred rows) are shuffled and collected. Nothing is joined, so no row meets
another.

Defined results: a null or empty text has no words, null places, empty labels
and the score 0; repeated rows get the same result each; a null ``doc_id``
stays null; other columns are ignored; an empty table gives no rows. Of
templates that match at one place all give their labels. A very long text is
one row with an array of its words.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The share of a template's weight that must match.
ENOUGH = 0.75
#: Sentences of a body with fewer words are no templates.
SENTENCE = 12

# Label, text, key phrase; a base phrase has its whole text as key.
BASE = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
NOTICES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can redistribute it"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute this software for any purpose"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "creative commons attribution 4 0 international", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)

# Label, body, key phrase. Names that vary stand outside the bodies.
PERMISSION = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability,
fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other
liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings
in the Software.
"""
REDISTRIBUTION = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
ENDORSEMENT = """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
"""
DISCLAIMER = """
This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the
implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be
liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute
goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict
liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such
damage.
"""
PLAIN_PERMISSION = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all warranties with regard to this
software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or
consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other
tortious action, arising out of or in connection with the use or performance of this software.
"""
APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.
"""
# The same words for three licenses.
COPYLEFT = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation,
either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You
should have received a copy of the GNU {kind} along with this program.
"""
PUBLIC_DOMAIN = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that
recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law.
"""
ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions. The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or
altered from any source distribution.
"""
MOZILLA = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
obtain one at http://mozilla.org/MPL/2.0/.
"""
BOOST = """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following.
"""
BODIES = (
    ("mit", PERMISSION, "permission is hereby granted free of charge to any person obtaining"),
    ("bsd", REDISTRIBUTION + DISCLAIMER, "redistribution and use in source and binary forms"),
    ("bsd-3-clause", REDISTRIBUTION + ENDORSEMENT + DISCLAIMER, "endorse or promote products derived from this software"),
    ("isc", PLAIN_PERMISSION, "distribute this software for any purpose"),
    ("apache-2.0", APACHE, "apache license version 2"),
    *((f"{label}-{version}.0", COPYLEFT.format(kind=kind, version=version), f"terms of the gnu {kind.lower()}") for label, kind in
      (("gpl", "General Public License"), ("lgpl", "Lesser General Public License"), ("agpl", "Affero General Public License")) for version in (2, 3)),
    ("unlicense", PUBLIC_DOMAIN, "free and unencumbered software"),
    ("zlib", ZLIB, "permission is granted to anyone to use this software"),
    ("mpl-2.0", MOZILLA, "mozilla public license"),
    ("bsl-1.0", BOOST, "person or organization obtaining a copy"),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of a candidate as one number: template above, start plus this offset below.
PLACE, SHIFT = 1 << 40, 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_start: int
    key_length: int
    base: bool

    @classmethod
    def of(cls, label: str, text: str, key: str, base: bool = False) -> Template:
        words, own = WORD.findall(text.lower()), key.split()
        start = next(k for k in range(len(words)) if words[k : k + len(own)] == own)
        return cls(label, tuple(words), start, len(own), base)


WORD = re.compile("[a-z0-9]+")


def of_body(label: str, body: str, key: str) -> list[Template]:
    """The whole body; and, as longer texts are rarely without a change, the sentence that has its key phrase."""
    sentences = [t for t in re.split(r"[.;:](?=\s)", body) if key in " ".join(WORD.findall(t.lower()))]
    return [Template.of(label, body, key), *(Template.of(label, t, key) for t in sentences if len(WORD.findall(t.lower())) >= SENTENCE)]


TEMPLATES = (
    *(Template.of(label, text, text, True) for label, text in BASE),
    *(Template.of(*n) for n in NOTICES),
    *(t for body in BODIES for t in of_body(*body)),
)


def words_column(text: str = "text") -> Column:
    """The words of a text, ASCII letters in lower case.

    ``lower`` also changes other letters, but no word of a template has any;
    only the Kelvin sign would become an ASCII letter.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    lower = F.when(F.contains(own, F.lit("\u212a")), F.translate(own, UPPER, LOWER)).otherwise(F.lower(own))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def weights_of(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each template word over all documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = F.array_distinct(F.filter(words_column(), lambda w: w.isin(vocabulary)))
    found = docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in found.collect()}  # one row for each template word
    total = count.get("", 0)
    return {w: math.log((total + 1) / (count.get(w, 0) + 0.5)) for w in vocabulary}


def postings_of(templates: tuple[Template, ...], weight: dict[str, float]) -> dict[str, list[int]]:
    """The index: of each template the highest-weighed words that hold more than 1 - ENOUGH of its weight."""
    out: dict[str, list[int]] = {}
    for k, t in enumerate(templates):
        needed = (1 - ENOUGH) * sum(weight[w] for w in t.words) * (1 + 1e-9)
        for word in sorted(set(t.words), key=lambda w: (-weight[w], w)):
            places = [at for at, w in enumerate(t.words) if w == word]
            out.setdefault(word, []).extend(k * PLACE + SHIFT - at for at in places)
            needed -= weight[word] * len(places)
            if needed < 0:
                break
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every document.

    ``places`` lists what was verified: label, first word, words, matched share.
    """
    weight = {w: max(v, 1e-3) for w, v in weights_of(docs, templates).items()}
    postings = postings_of(templates, weight)
    # Constants as JSON, which the optimizer reads once.
    index = F.from_json(F.lit(json.dumps(postings)), "map<string, array<bigint>>")
    said = [
        {"label": t.label, "words": t.words, "weights": [weight[w] for w in t.words], "total": sum(weight[w] for w in t.words), "key_start": t.key_start, "key_length": t.key_length, "base": t.base}
        for t in templates
    ]
    facts = F.from_json(F.lit(json.dumps(said)), "array<struct<label string, words array<string>, weights array<double>, total double, key_start int, key_length int, base boolean>>")
    rare = sorted(postings)
    spots = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    begins = F.flatten(F.transform("spots", lambda i: F.transform(F.element_at(index, F.get("words", i)), lambda p: p + i)))

    def verified(candidate: Column) -> Column:
        own = F.get(facts, (candidate / PLACE).cast("int"))
        start = (candidate % PLACE - SHIFT).cast("int")
        same = F.transform(own["words"], lambda w, j: F.coalesce(F.get("words", start + j) == w, F.lit(False)))
        share = F.aggregate(F.zip_with(same, own["weights"], lambda s, v: F.when(s, v).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b) / own["total"]
        key = F.forall(F.slice(same, own["key_start"] + 1, own["key_length"]), lambda s: s)
        return F.struct(own["label"].alias("label"), start.alias("start"), own["base"].alias("base"), F.when(key, F.least(share, F.lit(1.0))).otherwise(0.0).alias("share"), F.size(own["words"]).alias("n"))

    placed = F.filter(F.transform(F.array_distinct("begins"), verified), lambda c: c["share"] >= F.lit(ENOUGH))
    base = F.filter("placed", lambda c: c["base"])
    starts = F.transform("based", lambda c: c["start"].cast("long"))
    joined = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda c: c["label"]))), ",")
    read = docs.select("doc_id", words_column().alias("words"))
    found = read.withColumn("spots", spots).withColumn("begins", begins).withColumn("placed", placed).withColumn("based", base)
    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("based").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("based").alias("base_labels"), joined("placed").alias("labels"), F.coalesce(F.array_max(F.transform("placed", lambda c: c["share"])), F.lit(0.0)).alias("score"),
        F.transform("placed", lambda c: F.struct(c["label"].alias("label"), c["start"].alias("first_word"), c["n"].alias("n_words"), c["share"].alias("share"))).alias("places"),
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: license labels and places of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("places")

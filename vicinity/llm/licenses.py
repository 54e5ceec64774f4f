"""License scans with a positional rare-token index.

The index maps each word of a license template to its postings, the places where it stands in the template. A file's
licence words are ordered by IDF, with document frequencies counted over the whole corpus; of each template that the file
may hold, the ``RARE`` highest ones and the ``VOTES`` highest ones of each key phrase are looked up, so that no template's
words displace another's. Each of their places in the file votes for the places where their templates would begin, and a
template with enough distinct votes for one beginning is a candidate. A candidate counts if one of its mandatory key
phrases stands within its span; its score is the share of the template's words found at their relative places.

The contract's base phrases are verified at every place on their own, so that base labels are exact.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import as_bytes, bounded_batches, documents, map_arrow

#: Phrases and labels of the contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, template, mandatory key phrases (one of them must stand in the span).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["the apache license", "this file except in compliance with the license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0", "cc0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["copies or substantial portions of the software"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["fitness for a particular purpose and noninfringement"]),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability", ["provided by the copyright holders and contributors as is"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["software distributed under the license is distributed on an as is basis"]),
    ("apache", "spdx license identifier apache 2 0", ["spdx license identifier apache"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("bsd", "spdx license identifier bsd", ["spdx license identifier bsd"]),
    ("gpl", "spdx license identifier gpl", ["spdx license identifier gpl"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["copy of the gnu general public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("artistic", "this package is free software you may redistribute it under the terms of the artistic license", ["the artistic license"]),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("bsl", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want to public license"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ["gnu free documentation license"]),
]

#: Highest-IDF words of each template looked up in a file, distinct places that must agree on a beginning, and slack of a key phrase.
RARE, VOTES, SLACK = 12, 2, 3

#: A-Z to a-z; other ASCII letters, digits and all bytes of non-ASCII characters stay; the rest ends a word.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]


def templates() -> list[Template]:
    return [
        Template(label, tuple(text.encode().split()), tuple(tuple(k.encode().split()) for k in keys))
        for label, text, keys in TEMPLATES
    ]


def vocabulary() -> list[bytes]:
    """All words of the templates and base phrases, in order."""
    return sorted({w for t in templates() for w in t.words} | {w for p in BASE for w in p.encode().split()})


def frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many of them each word of the vocabulary stands; over all of ``docs``."""
    known = {w: i for i, w in enumerate(vocabulary())}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(len(known) + 1, np.int64)
        for text in as_bytes(batch.column(0)):
            n[[known[w] for w in known.keys() & set(words_of(text))]] += 1
        n[-1] = batch.num_rows
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["word", "n"])

    sums = map_arrow(docs.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in sums.collect()}  # at most one row a word of the vocabulary
    return found.get(len(known), 0), {w: found.get(i, 0) for w, i in known.items()}


class Index:
    """Postings and IDF of the license words."""

    def __init__(self, total: int, seen: dict[bytes, int]):
        self.templates = templates()
        self.idf = {w: math.log((total + 1) / (n + 1)) for w, n in seen.items()}
        self.postings: list[dict[bytes, list[int]]] = [defaultdict(list) for _ in self.templates]
        for postings, template in zip(self.postings, self.templates):
            for place, word in enumerate(template.words):
                postings[word].append(place)
        self.base = [(tuple(p.encode().split()), label) for p, label in BASE.items()]

    def scan(self, text: bytes) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
        words = words_of(text)
        present = self.idf.keys() & set(words)
        base = [(p, label) for p, label in self.base if present.issuperset(p)]
        able = [t for t, x in enumerate(self.templates) if any(present.issuperset(k) for k in x.keys)]
        if not base and not able:
            return len(words), 0, None, None, "", "", 0.0
        line = b" " + b" ".join(words) + b" "
        starts, base_labels = [], set()
        for phrase, label in base:
            if found := _places(line, phrase):
                starts += found
                base_labels.add(label)
        labels, score = set(base_labels), float(bool(base_labels))
        for label, share in self._aligned(words, line, present, set(able)):
            labels.add(label)
            score = max(score, share)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score

    def _rarest(self, words: set[bytes], count: int) -> list[bytes]:
        return sorted(words, key=lambda w: (-self.idf[w], w))[:count]

    def _aligned(self, words: list[bytes], line: bytes, present: set[bytes], able: set[int]) -> list[tuple[str, float]]:
        if not able:
            return []
        wanted: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t in able:
            template = self.templates[t]
            chosen = set(self._rarest(present.intersection(template.words), RARE))
            # a key phrase always brings its own votes, wherever the template's rarer words stand
            chosen.update(w for k in template.keys if present.issuperset(k) for w in self._rarest(set(k), VOTES))
            for word in chosen:
                wanted[word] += [(t, place) for place in self.postings[t][word]]
        votes: dict[tuple[int, int], set[int]] = defaultdict(set)
        for at, word in enumerate(words):
            if word in wanted:
                for t, place in wanted[word]:
                    votes[t, at - place].add(place)
        keys = {t: [(k, _places(line, k)) for k in self.templates[t].keys] for t in able}
        out = []
        for (t, begin), agreed in votes.items():
            template = self.templates[t]
            if len(agreed) < min(VOTES, len(template.words)):
                continue
            end = begin + len(template.words)
            if any(begin - SLACK <= at <= end + SLACK - len(k) for k, places in keys[t] for at in places):
                same = sum(0 <= begin + i < len(words) and words[begin + i] == w for i, w in enumerate(template.words))
                out.append((template.label, same / len(template.words)))
        return out


def _places(line: bytes, phrase: tuple[bytes, ...]) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively; ``line`` has one blank around each word."""
    needle, out, at, word, before = b" " + b" ".join(phrase) + b" ", [], -1, 0, 0
    while (at := line.find(needle, at + 1)) >= 0:
        word += line.count(b" ", before, at)
        before = at
        out.append(word)
    return out


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def scan(docs: DataFrame) -> DataFrame:
    """A row of SCHEMA for every row of ``docs``, from its whole text.

    A null or empty text has no word, no label and score 0; null ids and repeated rows stay; an empty table returns no
    row. Other columns are not read. The score is 1 with a base label, else the best template's share, else 0.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(*frequencies(docs)))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*map(index.value.scan, as_bytes(batch.column(1)))))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)

    bounded_batches(docs.sparkSession)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, SCHEMA)


def op6_license_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir))

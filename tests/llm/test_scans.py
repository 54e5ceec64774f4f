"""License scans and nearest neighbours against brute force."""

import collections
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ROWS, frame
from vicinity.llm import licenses, multi_index

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    starts, found = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        found |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_corpus_equals_brute_force(corpus):
    texts = {r.doc_id: r.text for r in corpus.collect()}
    rows = licenses.scan(corpus).collect()
    assert len(rows) == len(texts) and all(base(r) == plain(texts[r.doc_id]) for r in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_awkward_rows(awkward, nothing):
    rows = licenses.scan(awkward).collect()
    assert collections.Counter((r.doc_id, *base(r)) for r in rows) == collections.Counter((d, *plain(t)) for d, t, *_ in ROWS)
    assert licenses.scan(nothing).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("MIT License. MIT License!", "mit"),
        ("x " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
        ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY, fitness for a particular purpose and noninfringement.", "mit"),
        ("// SPDX-License-Identifier: Apache-2.0", "apache"),
        ("made available under the terms of the Eclipse Public License 2.0", "epl"),
        ("licensed under the SIL Open Font License, Version 1.1", "ofl"),
        ("the software is provided as a service, without warranty", ""),
        ("an artistic license was taken by the author of this file", ""),
        ("permission to enter is granted free of fees, in source form", ""),
        ("the license of the source", ""),
    ],
)
def test_labels(spark, text, labels):
    assert licenses.scan(frame(spark, [(1, text, "en", "a")])).first().labels == labels


def test_templates_do_not_displace_each_other(corpus):
    index = licenses.Index(*licenses.frequencies(corpus))
    notices = [(label, text.encode()) for label, text, _ in licenses.TEMPLATES]
    alone = [set(index.scan(text)[5].split(",")) for _, text in notices]
    assert all(label in found for (label, _), found in zip(notices, alone))
    for some in itertools.combinations(range(18), 3):
        found = set(index.scan(b"\n\n".join(notices[i][1] for i in some))[5].split(","))
        assert set().union(*(alone[i] for i in some)) <= found, some
    whole = set(index.scan(b"\n\n".join(text for _, text in notices))[5].split(","))
    assert whole == {label for label, _ in notices}
    for a, b in itertools.combinations(range(len(notices)), 2):
        found = set(index.scan(notices[a][1] + b"\n\n" + notices[b][1])[5].split(","))
        assert alone[a] | alone[b] <= found, (notices[a], notices[b])
    # rarer words of the template elsewhere don't displace the key phrase
    template = index.templates[0]
    text = b" ".join(reversed(template.words)) + b" x " + b" ".join(template.keys[0])
    assert index.scan(text)[5] == "mit"


def plain_labels(index, text):
    """Labels by trying every template at every place, without postings or votes by word."""
    words = licenses.words_of(text)
    present = set(words)
    out = set(filter(None, index.scan(text)[4].split(",")))
    stands = lambda phrase, lo, hi: any(tuple(words[i : i + len(phrase)]) == phrase for i in range(max(0, lo), min(len(words), hi + 1)))
    for t in index.templates:
        able = [k for k in t.keys if present.issuperset(k)]
        rare = sorted(present.intersection(t.words), key=lambda w: (-index.idf[w], w))[: licenses.RARE]
        sought = {*rare, *(w for k in able for w in sorted(set(k), key=lambda w: (-index.idf[w], w))[: licenses.VOTES])}
        for begin in range(-len(t.words), len(words)) if able else ():
            same = [i for i, w in enumerate(t.words) if 0 <= begin + i < len(words) and words[begin + i] == w and w in sought]
            end = begin + len(t.words)
            if len(same) >= min(licenses.VOTES, len(t.words)) and any(stands(k, begin - licenses.SLACK, end + licenses.SLACK - len(k)) for k in t.keys):
                out.add(t.label)
    return ",".join(sorted(out))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, len(licenses.TEMPLATES) - 1), st.floats(0, 1), st.floats(0, 1)), max_size=4), st.integers(1, 50))
def test_labels_equal_an_aligner_without_an_index(parts, n):
    index = licenses.Index(1000, {w: (i * 7919 * n) % 900 for i, w in enumerate(licenses.vocabulary())})
    text = []
    for t, a, b in parts:
        words = licenses.TEMPLATES[t][1].split()
        lo, hi = sorted((int(a * len(words)), int(b * len(words))))
        text += ["other", *words[lo : hi + 1]]
    assert index.scan(" ".join(text).encode())[5] == plain_labels(index, " ".join(text).encode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["mit", "license", "cc", "by", "apache", "gnu", "general", "public", "x", "é", "MIT-License"]), max_size=30))
def test_base_places(words):
    index = licenses.Index(10, {w: 1 for w in licenses.vocabulary()})
    text = " ".join(words)
    assert index.scan(text.encode())[:5] == plain(text)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "extra") for i, v in rows], "vec_id long, embedding array<float>, score string")


def exact(rows, k=20):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % 20 == 0:
            out[i] = sorted((-float((q * v).sum()), j) for j, v in fine if j != i)[:k]
    return out


def search(spark, rows):
    v = vectors(spark, rows)
    found = collections.defaultdict(list)
    for r in multi_index.search(v, v.where("vec_id % 20 = 0")).collect():
        found[r.query_id].append((r["rank"], -r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(x)] for q, x in found.items()}


def test_awkward_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 6).tolist()) for i in range(60)]
    rows += [(60, None), (80, [0.0] * 6), (100, [1, None, 1, 1, 1, 1]), (120, [1, float("nan"), 1, 1, 1, 1]), (140, [float("inf")] * 6), (None, [1] * 6)]
    rows += [(i, [1, 2, 1, 2, 1, 2]) for i in range(200, 260)]  # many copies of one vector
    rows = [(i, v) for i, v in rows if v is None or any(x for x in v) or i == 80]
    got, want = search(spark, rows), exact(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert len(got[q]) == 20
        for s, i in got[q]:
            assert (s, i) in [(s2, i2) for s2, i2 in exact(rows, 1000)[q]]
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.9


def test_repeated_ids_and_other_lengths(spark):
    """A query whose id repeats more often than k; rows that repeat; the less frequent length takes no part."""
    v = [1.0, 2.0, -1.0, 0.5]
    rows = [(20, v)] * 25 + [(25, v)] + [(i, [float(i % 7), 1.0, float(i % 3), -1.0]) for i in range(40, 75)] + [(41, [9.0, 9.0])] * 3
    got, want = search(spark, rows), exact([r for r in rows if len(r[1]) == 4])
    assert got.keys() == want.keys() and 25 in [i for _, i in got[20]]
    assert got == want


@pytest.mark.parametrize("bytes_", [64, 400, 8 << 20])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, bytes_):
    """One row a block, cells cut into several blocks, queries cut into parts, and everything in one."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(400, 480)]
    plain = search(spark, rows)
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(multi_index, "ASKED_BYTES", bytes_)
    assert search(spark, rows) == plain
    want = exact(rows)
    assert np.mean([len({i for _, i in plain[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def test_centroids_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "FIT_ROWS", 100)
    rng = np.random.default_rng(3)
    table = vectors(spark, [(i, rng.normal(size=6).tolist()) for i in range(500)])
    built = [multi_index.build(t)[1] for t in (table.coalesce(1), table.repartition(7))]
    assert np.array_equal(built[0].left, built[1].left) and np.array_equal(built[0].right, built[1].right)
    assert np.array_equal(built[0].counts, built[1].counts) and built[0].counts.sum() == 500


def test_fewer_rows_than_k_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert search(spark, rows) == {0: [(-1.0, 2), (0.0, 1)]} or search(spark, rows) == {0: [(-1.0, 2), (-0.0, 1)]}
    assert search(spark, []) == {} and search(spark, [(1, [1.0])]) == {}


def test_recall_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = search(spark, rows), exact(rows)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def test_walk_is_ordered_and_complete():
    rng = np.random.default_rng(0)
    index = multi_index.Index(rng.random((200, 8)), 2000)
    left, right = index.halves(rng.random((1, 8)))
    walked = list(index.walk(left[0], right[0]))
    sums = [d for d, _, _ in walked]
    assert sums == sorted(sums) and len({(i, j) for _, i, j in walked}) == len(index.left) * len(index.right)


@pytest.mark.parametrize("steps", [0, 7, 10_000])
def test_reach_is_that_of_the_walk(monkeypatch, steps):
    rng = np.random.default_rng(5)
    index = multi_index.Index(rng.normal(size=(300, 6)), 3000)
    index.counts = rng.integers(0, 9, index.counts.shape)
    monkeypatch.setattr(multi_index, "STEPS", steps)
    for q in rng.normal(size=(10, 6)):
        left, right = (x[0] for x in index.halves(q[None]))
        for wanted in (0.5, 1, 40, index.counts.sum() / 2, index.counts.sum(), index.counts.sum() + 5):
            seen, d = 0, np.inf
            for d, i, j in index.walk(left, right):
                seen += index.counts[i, j]
                if seen >= wanted:
                    break
            assert index.reach(left, right, wanted) == d

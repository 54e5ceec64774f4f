import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from vicinity.llm import components, simhash

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows, radius=4):
    """(doc_id, fingerprint, component_id) of each row, comparing all pairs of distinct fingerprints."""
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    least = {}
    for (doc_id, _), f in zip(rows, fps):
        if doc_id is not None:
            least[find(f)] = min(doc_id, least.get(find(f), doc_id))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for (d, _), f in zip(rows, fps)), key=str)


def got(docs):
    rows = simhash.groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    return sorted(map(tuple, rows), key=str)


def test_corpus_equals_brute_force(corpus):
    assert got(corpus) == brute([(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()])


def test_awkward_rows(awkward):
    assert got(awkward) == brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])


def test_empty(nothing):
    assert got(nothing) == [] and simhash.dedup(nothing).count() == 0


def test_empty_texts_are_one_group(spark):
    rows = [(5, None, "en", "a"), (3, "", "en", "a"), (4, " \t", "en", "a")]
    assert {r[2] for r in got(frame(spark, rows))} == {3}


@pytest.mark.parametrize("n", [1, 3, 4, 300, 70_000])
def test_fingerprint_lengths(n):
    text = " ".join(f"W{i * i % 1009}" for i in range(n))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def near_values(seed, centres, copies, flips):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 2**63, centres):
        for _ in range(copies):
            v = int(c)
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                v ^= 1 << int(b)
            out.append(v)
    return sorted(set(out))


def classes(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    return {v: find(v) for v in values}


def same_partition(a, b):
    return len(set(zip(a.values(), [b[k] for k in a]))) == len(set(a.values())) == len(set(b.values()))


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(1, 90), st.integers(0, 6))
def test_bit_sliced_bucket_equals_popcount(seed, centres, copies, flips):
    values = near_values(seed, centres, copies, flips)
    u, v = simhash.spanning_links(np.zeros(len(values), np.int64), np.array(values, np.uint64))
    want = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert same_partition(classes(values, want), classes(values, zip(u.tolist(), v.tolist())))
    assert len(u) < len(values)  # a forest, never all pairs


@pytest.mark.parametrize("count, blocks", [(0, 6), (10**8, 6), (10**9, 7), (5 * 10**10, 8)])
def test_number_of_blocks(count, blocks):
    assert simhash.blocks_for(count) == blocks


@pytest.mark.parametrize("cell, blocks", [(16, 6), (32768, 6), (64, 7), (32768, 8)])
def test_links_lose_nothing(spark, cell, blocks):
    values = near_values(5, 3, 120, 4)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), cell=cell, blocks=blocks).collect()
    want = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    found = [(r.u % 2**64, r.v % 2**64) for r in links]
    assert same_partition(classes(values, want), classes(values, found))


@pytest.mark.parametrize("shape", ["chain", "star", "ring", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(2)
    n = 60
    names = rng.permutation(1000)[:n].tolist()
    edges = {
        "chain": [(names[i], names[i + 1]) for i in range(n - 1)],
        "star": [(names[0], x) for x in names[1:]],
        "ring": [(names[i], names[(i + 1) % n]) for i in range(n)],
        "random": [(names[a], names[b]) for a, b in rng.integers(0, n, (40, 2)).tolist()],
    }[shape]
    roots = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = classes(names, edges)
    least = {}
    for x, c in want.items():
        least[c] = min(x, least.get(c, x))
    assert {x: roots.get(x, x) for x in names} == {x: least[c] for x, c in want.items()}


def test_dedup_keeps_one_of_each_group(awkward):
    groups = brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    kept = simhash.dedup(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = {c for _, _, c in groups if c is not None}
    assert {i for i in ids if i is not None} == want
    assert len(ids) == len(want) + len({f for _, f, c in groups if c is None})


def test_dedup_of_repeated_rows(spark):
    rows = [(1, "same text in both rows of this table", "en", "a")] * 3 + [(None, "only rows without an id", "en", "a")] * 2
    assert simhash.dedup(frame(spark, rows)).count() == 2
    assert simhash.dedup(frame(spark, rows)).where(F.col("doc_id") == 1).count() == 1

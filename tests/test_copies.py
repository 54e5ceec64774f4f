"""Searches whose work doesn't grow with the square of the rows: copies and blocks of neighbours."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_search import brute, found
from vicinity.functions.scalars import quantize
from vicinity.operators import boxes, cells, ivf, knn


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(1, 4), st.booleans(), st.booleans(), st.integers(0, 99))
def test_blocks_equal_a_scan(n, k, dims, skipping, bounded, seed):
    rng = np.random.default_rng(seed)
    x, ids = rng.integers(0, 6, (n, dims)).astype(float), rng.permutation(3 * n)[:n]
    q, skip = np.concatenate([x[: n // 2 + 1], rng.integers(0, 6, (9, dims))]), np.r_[ids[: n // 2 + 1], np.full(9, -1)]
    more = [rng.integers(0, 8, len(q)).astype(float)] if bounded else []
    got, want = (maker(x, ids, k)(q, skip if skipping else None, *more) for maker in (boxes.boxed, cells.scan))
    assert sorted(zip(*map(list, got))) == sorted(zip(*map(list, want)))


def test_blocks_compare_few_rows(monkeypatch):
    """Of 20,000 references in clusters a query meets a small part; a scan meets all."""
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 100, (200, 6)) * 1000)[rng.integers(0, 200, 20_000)] + rng.integers(0, 50, (20_000, 6)).astype(float)
    seen, plain = [0], boxes.smallest
    monkeypatch.setattr(boxes, "smallest", lambda d, ids, k: seen.__setitem__(0, seen[0] + d.size) or plain(d, ids, k))
    boxes.boxed(x, np.arange(20_000), 5)(x[:2000], np.arange(2000))
    assert seen[0] < 2000 * 20_000 / 10


@pytest.mark.parametrize("search", ["ivf", "pruned", "capped"])
def test_equal_vectors_are_searched_once(spark, monkeypatch, search):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(0, 4, 3) / 4).tolist() if i < 20 else None, i % 2) for i in range(300)]
    rows = [(i, rows[i % 20][1], label) for i, _, label in rows]
    raw = spark.createDataFrame(rows, "orig_id long, vector array<float>, label int")
    refs = raw.select("orig_id", quantize(F.col("vector")).alias("codes"), "label")
    queries = refs.select(F.col("orig_id").alias("qid"), "codes")
    asked, plain = [], cells.nearest
    monkeypatch.setattr(cells, "nearest", lambda refs, q, total, *a, **k: asked.append(total) or plain(refs, q, total, *a, **k))
    index = ivf.build_ivf(raw, 4, rounds=1)
    got = {
        "ivf": lambda: knn.knn_ivf(index, queries, nprobe=4, skip_self=True),
        "pruned": lambda: knn.knn_pruned(index, queries, nprobe=1, skip_self=True),
        "capped": lambda: knn.knn_pruned(index, queries, nprobe=1, skip_self=True, most=4),
    }[search]()
    assert found(got) == brute(refs, queries)
    assert asked and max(asked) <= 20


def test_positions_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def each(rows):
        for row in rows:
            made.add(1)
            yield row

    rows = spark.createDataFrame(spark.range(500).rdd.mapPartitions(each), "id long")
    assert ivf.positions(rows, "id").count() == 500
    assert made.value == 500


def test_exact_search_reaches_few_buckets(spark, monkeypatch):
    """Buckets whose balls overlap but whose boxes lie apart aren't scanned; the result is that of brute force."""
    rng = np.random.default_rng(7)
    flat = np.repeat(np.arange(16) / 16, 40)
    raw = spark.createDataFrame([(i, [float(x), float(rng.random())], i % 2) for i, x in enumerate(flat)], "orig_id long, vector array<float>, label int")
    refs = raw.select("orig_id", quantize(F.col("vector")).alias("codes"), "label")
    queries = refs.select(F.col("orig_id").alias("qid"), "codes", F.col("orig_id").alias("name"))
    index = ivf.index_from(raw, np.array([[x, 0.5] for x in np.arange(16) / 16], np.float32))
    scanned, plain = [], cells.nearest
    monkeypatch.setattr(cells, "nearest", lambda refs, q, *a, **k: scanned.append(q.count()) or plain(refs, q, *a, **k))
    assert found(knn.knn_pruned(index, queries, nprobe=6, skip_self=True)) == brute(refs, queries)
    assert sum(scanned) < 640 * 6
    want = {qid: sum(i % 2 for _, i in near) for qid, near in brute(refs, queries).items()}
    got = knn.exact_frauds(index, queries, nprobe=6, skip_self=True).collect()
    assert {r.name: r.frauds for r in got} == want and all(r.name == r.qid for r in got)


def test_equal_references_are_thinned(spark):
    rows = [(b, i, i % 2, [i % 3, b]) for b in range(2) for i in range(b * 100, b * 100 + 100)]
    few = ivf.few_equal(spark.createDataFrame(rows, "bucket int, orig_id long, label int, codes array<int>").coalesce(1), 6)
    want = sorted(r for b in range(2) for c in range(3) for r in sorted((b, i, i % 2, [c, b]) for i in range(b * 100, b * 100 + 100) if i % 3 == c)[:6])
    assert sorted(map(tuple, few.collect())) == want


@pytest.mark.parametrize("search", ["pruned", "capped", "ivf"])
def test_large_buckets_are_searched_by_parts(spark, monkeypatch, search):
    """A query meets few of the parts that a bucket is cut into; the result is that of brute force."""
    from vicinity.operators import parts

    monkeypatch.setattr(parts, "PART", 40)
    monkeypatch.setattr(parts, "SEEN", 40)
    rng = np.random.default_rng(8)
    at = rng.integers(0, 2, (60, 3)).repeat(12, axis=0) * 0.5 + rng.integers(0, 100, (720, 3)) / 1000
    raw = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(at)], "orig_id long, vector array<float>, label int")
    refs = raw.select("orig_id", quantize(F.col("vector")).alias("codes"), "label")
    queries = refs.select(F.col("orig_id").alias("qid"), "codes")
    index = ivf.index_from(raw, np.array([[0.1, 0.1, 0.1], [0.6, 0.6, 0.6]], np.float32))
    met, plain = [], cells.nearest
    monkeypatch.setattr(cells, "nearest", lambda refs, q, *a, **k: met.append(q.count()) or plain(refs, q, *a, **k))
    got = {
        "pruned": lambda: knn.knn_pruned(index, queries, nprobe=1, skip_self=True),
        "capped": lambda: knn.knn_pruned(index, queries, nprobe=1, skip_self=True, most=2),
        "ivf": lambda: knn.knn_ivf(index, queries, nprobe=2, skip_self=True),
    }[search]()
    assert found(got) == brute(refs, queries)
    assert len(index.parts(6).owner) >= 12 and sum(met) < 720 * 12 / 2


def test_cuts_send_every_row_to_a_part():
    from vicinity.operators import parts

    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (30_000, 4)).astype(float)
    of = rng.integers(0, 3, len(x))
    cuts, owner = parts.cut({b: x[of == b][:500] for b in range(2)}, np.bincount(of, minlength=4))
    part = cuts.of(of, x)
    assert (owner[part] == of).all() and set(owner) == {0, 1, 2, 3} and (np.diff(owner) >= 0).all()
    assert len({tuple(v) for v in x[of == 0]}) > 1 and (owner == 0).sum() > 1 and (owner == 2).sum() == 1


def test_index_takes_codes_that_are_known(spark, monkeypatch):
    raw = spark.createDataFrame([(i, [i % 7 / 7, i % 3 / 3], i % 2) for i in range(100)], "orig_id long, vector array<float>, label int")
    made, plain, centroids = [], ivf.quantize, np.array([[0.1, 0.1], [0.8, 0.6]], np.float32)
    monkeypatch.setattr(ivf, "quantize", lambda *a: made.append(a) or plain(*a))
    known = ivf.index_from(raw.withColumn("codes", quantize(F.col("vector"))), centroids)
    assert len(made) == 1  # the centroids'
    want = ivf.index_from(raw, centroids)
    assert sorted(known.rows.collect()) == sorted(want.rows.collect()) and known.rows.columns == want.rows.columns
    assert sorted(known.centroids.collect()) == sorted(want.centroids.collect())

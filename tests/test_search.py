"""Search modes against brute force in numpy, index files, and the stream."""

import gzip
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinity.functions.scalars import quantize
from vicinity.operators import cells, ivf, knn, topk, vptree
from vicinity.plans import registry
from vicinity.plans import transactions as tx
from vicinity.sources import index_files, readers
from vicinity.streaming import score as scoring

DATA = "/root/testdata/sf0.001"


def sample(spark, n=300, dims=6, seed=3):
    """Vectors on a coarse grid, so that ties are common; a fifth has missing values."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, dims)) / 4
    x[rng.random(n) < 0.2, 2:4] = -1
    rows = [(i, v.tolist(), int(rng.random() < 0.5)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "orig_id long, vector array<float>, label int")


def brute(refs, queries, k=5, skip_self=True):
    r = {a.orig_id: np.array(a.codes, np.int64) for a in refs.collect()}
    out = {}
    for q in queries.collect():
        d = sorted((int(((np.array(q.codes, np.int64) - v) ** 2).sum()), i) for i, v in r.items() if not skip_self or i != q.qid)
        out[q.qid] = d[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r["rank"], r.dist, r.orig_id))
    return {q: [(d, i) for _, d, i in sorted(v)] for q, v in out.items()}


@pytest.fixture(scope="module")
def sets(spark):
    raw = sample(spark).cache()
    refs = raw.select("orig_id", quantize(F.col("vector")).alias("codes"), "label").cache()
    return raw, refs, refs.select(F.col("orig_id").alias("qid"), "codes")


def test_brute_force(sets):
    _, refs, queries = sets
    assert found(knn.knn_brute(refs, queries, skip_self=True)) == brute(refs, queries)


def test_vptree(sets):
    _, refs, queries = sets
    assert found(vptree.knn_vptree(refs, queries, skip_self=True, chunk=100)) == brute(refs, queries)


@pytest.fixture(params=["whole", "cut"])
def way(request, monkeypatch):
    """Buckets in one cell with all their queries, and cut into cells and blocks of queries."""
    if request.param == "cut":
        monkeypatch.setattr(ivf, "CELL", 20)
        monkeypatch.setattr(cells, "BLOCK", 100)


@pytest.mark.parametrize("k", [1, 2, 5, 16, 64])
def test_pruned_is_exact_for_any_number_of_buckets(sets, k, way):
    raw, refs, queries = sets
    index = ivf.build_ivf(raw, k, rounds=1)
    assert found(knn.knn_pruned(index, queries, nprobe=2, skip_self=True)) == brute(refs, queries)


def test_all_buckets_probed_is_exact_and_rows_come_once(sets, way):
    raw, refs, queries = sets
    index = ivf.build_ivf(raw, 3, rounds=1)
    assert found(knn.knn_ivf(index, queries, nprobe=80, skip_self=True)) == brute(refs, queries)


def test_warm_index_gives_the_same_and_deals_out_only_the_queries(sets, way):
    raw, refs, queries = sets
    warm = ivf.warm_up(ivf.build_ivf(raw, 7, rounds=1))
    rows = knn.knn_ivf(warm, queries, nprobe=7, skip_self=True)
    assert found(rows) == brute(refs, queries)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    cogroup = plan[plan.index("FlatMapCoGroups") :]
    assert "InMemoryTableScan" in cogroup
    if cells.BLOCK > 300:
        assert not [line for line in cogroup.splitlines() if "hashpartitioning(cell" in line and "ENSURE_REQUIREMENTS" in line]
    ivf.cool_down(warm)


def test_long_vectors(spark):
    raw = sample(spark, 200, 40)
    refs = raw.select("orig_id", quantize(F.col("vector")).alias("codes"), "label")
    queries = refs.select(F.col("orig_id").alias("qid"), "codes")
    assert found(knn.knn_pruned(ivf.build_ivf(raw, 9, 1), queries, nprobe=1, skip_self=True)) == brute(refs, queries)


def test_fraud_count_of_raw_vectors(sets):
    raw, refs, queries = sets
    index = ivf.build_ivf(raw, 1)
    label = {r.orig_id: r.label for r in refs.collect()}
    want = {q: sum(label[i] for _, i in v) for q, v in brute(refs, queries, skip_self=False).items()}
    assert {r.qid: r.frauds for r in knn.fraud_count(index, raw.select(F.col("orig_id").alias("qid"), "vector")).collect()} == want


def test_positions_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 100_003).alias("x")).repartition(9)
    got = [tuple(r) for r in ivf.positions(rows, "x").orderBy("x").collect()]
    assert got == [(x, i) for i, x in enumerate(sorted(i * 7919 % 100_003 for i in range(1000)))]


def test_more_buckets_than_bytes_is_an_error(sets, monkeypatch):
    monkeypatch.setattr(ivf, "CENTROID_BYTES", 100)
    with pytest.raises(ValueError):
        ivf.lloyd(sets[0], 16, 1)
    assert len(ivf.lloyd(sets[0], 1, 1)) == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=6, max_size=6), min_size=1, max_size=5), st.integers(1, 8))
def test_smallest_equals_a_sort(rows, k):
    d, ids = np.array(rows, float), np.array([5, 3, 9, 1, 7, 2])
    d[d == 3] = np.inf
    row, column = topk.smallest(d, ids, k)
    got = [[(d[r, c], ids[c]) for r, c in zip(row, column) if r == i] for i in range(len(rows))]
    assert got == [sorted((x, j) for x, j in zip(d[i], ids) if x < np.inf)[:k] for i in range(len(rows))]


def test_recall_is_reported(sets):
    raw, refs, queries = sets
    index = ivf.build_ivf(raw, 16)
    got, want = found(knn.knn_ivf(index, queries, nprobe=4, skip_self=True)), brute(refs, queries)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want])
    assert 0 < recall <= 1


def test_fewer_references_than_k(spark):
    refs = spark.createDataFrame([(0, [1, 2], 1), (1, [3, 4], 0)], "orig_id long, codes array<int>, label int")
    queries = spark.createDataFrame([(7, [1, 2])], "qid long, codes array<int>")
    assert found(knn.knn_brute(refs, queries)) == {7: [(0, 0), (8, 1)]}
    assert knn.knn_brute(refs, queries.limit(0)).count() == 0
    assert knn.knn_brute(refs.limit(0), queries).count() == 0


def test_two_pass_rescans_the_edge_only(sets, way):
    raw, _, queries = sets
    index = ivf.build_ivf(raw, 16)
    votes = lambda n: {r.qid: r.frauds for r in knn.frauds(knn.knn_ivf(index, queries, nprobe=n, skip_self=True)).collect()}
    fast, full = votes(2), votes(8)
    want = {q: full[q] if fast.get(q, 0) in (2, 3) else fast.get(q, 0) for q in full}
    assert {r.qid: r.frauds for r in knn.two_pass(index, queries, fast=2, full=8, skip_self=True).collect()} == want


def test_empty_buckets_are_reseeded(spark):
    rows = [(i, [0.0, 0.0] if i < 30 else [1.0, 1.0 + i / 100], 0) for i in range(40)]
    refs = spark.createDataFrame(rows, "orig_id long, vector array<float>, label int")
    centroids = ivf.lloyd(refs, 4, 1)
    # the second and third bucket start on the same point as the first, which wins their rows
    assert centroids[1].tolist() == pytest.approx(rows[7919 % 40][1])
    assert len(centroids) == 4


def test_layout_adds_up(sets):
    raw, _, _ = sets
    rows = ivf.layout(ivf.build_ivf(raw, 8)).orderBy("bucket").collect()
    assert rows[0].start == 0 and all(a.start + a.n == b.start for a, b in zip(rows, rows[1:]))
    assert rows[-1].start + rows[-1].n == 300


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 3)] * 3), min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 5))
def test_tree_search_equals_a_scan(points, leaf, k):
    x = np.array(points, float)
    ids = np.arange(len(x)) * 3 % 97
    tree = vptree.build(x, leaf)
    for q in x[:5]:
        d = ((x - q) ** 2).sum(axis=1)
        want = sorted(zip(d.tolist(), ids.tolist()))[:k]
        assert [(a, b) for a, b, _ in vptree.search(tree, x, ids, q, k)] == want


def test_tree_file_round_trip():
    x = np.random.default_rng(1).random((200, 4))
    tree = vptree.build(x, leaf=1)
    back = index_files.decode_tree(index_files.encode_tree(tree))
    ids = np.arange(200)
    assert tree.size == 200
    for q in x[:10]:
        assert [i for _, i, _ in vptree.search(back, x, ids, q, 5)] == [i for _, i, _ in vptree.search(tree, x, ids, q, 5)]
    with pytest.raises(ValueError):
        index_files.decode_tree(b"\0" * 32)


@pytest.mark.parametrize("version", [1, 2])
def test_index_file_round_trip(spark, sets, version, tmp_path):
    raw, _, _ = sets
    index = ivf.build_ivf(raw, 8)
    arrays = index_files.arrays_of(index)
    back = index_files.decode_index(index_files.encode_index(arrays, version), dims=6)
    for name in ("centroids", "offsets", "labels", "ids", "codes"):
        assert np.array_equal(getattr(arrays, name), getattr(back, name)), name
    assert (back.radius is None) == (version == 1)
    index_files.write_index_file(index, str(tmp_path), version)
    rows, table = index_files.read_index_files(spark, str(tmp_path))
    assert sorted(map(tuple, rows.select("bucket", "orig_id").collect())) == sorted(map(tuple, index.rows.select("bucket", "orig_id").collect()))
    assert table.count() == 8
    data = gzip.decompress(index_files.encode_index(arrays))
    for broken in (b"XXXX" + data[4:], data[:-1], data + b"\0", data[:20]):
        with pytest.raises(ValueError):
            index_files.decode_index(broken)
    with pytest.raises(ValueError):
        index_files.decode_index(data, dims=14)


def test_index_tables_round_trip(spark, sets, tmp_path):
    raw, refs, queries = sets
    index_files.save_index(ivf.build_ivf(raw, 8), str(tmp_path))
    back = index_files.load_index(spark, str(tmp_path), "i16")
    assert (back.k, back.dims) == (8, 6)
    assert found(knn.knn_pruned(back, queries, skip_self=True)) == brute(refs, queries)
    with pytest.raises(ValueError):
        index_files.load_index(spark, str(tmp_path), "int8")
    # the rows are read bucketed, and only the queries shuffled, whatever the session's number of partitions
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        plan = knn.knn_ivf(back, queries, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    cogroup = plan[plan.index("FlatMapCoGroups") :]
    assert "Bucketed: true" in cogroup and "hashpartitioning(cell" not in cogroup
    # saved again over itself, by another number of parts
    index_files.save_index(ivf.build_ivf(raw, 4), str(tmp_path), 3)
    assert found(knn.knn_pruned(index_files.load_index(spark, str(tmp_path)), queries, skip_self=True)) == brute(refs, queries)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("vicinity_")]


def test_readers(spark, tmp_path):
    refs = [{"vector": [i / 10, 0.5], "label": "fraud" if i % 3 == 0 else "legit"} for i in range(9)]
    with gzip.open(tmp_path / "references.json.gz", "wt") as f:
        json.dump(refs, f)
    rows = readers.read_references(spark, str(tmp_path / "references.json.gz")).orderBy("orig_id").collect()
    assert [(r.orig_id, r.label) for r in rows] == [(i, int(i % 3 == 0)) for i in range(9)]
    assert [r.vector[0] for r in rows] == pytest.approx([i / 10 for i in range(9)])
    (tmp_path / "normalization.json").write_text(json.dumps(tx.NORM))
    assert readers.read_normalization(spark, str(tmp_path / "normalization.json")) == tx.NORM
    (tmp_path / "mcc.json").write_text(json.dumps(tx.RISK))
    assert dict(map(tuple, readers.read_mcc_risk(spark, str(tmp_path / "mcc.json")).collect())) == tx.RISK
    entries = [{"request": {"id": str(i)}, "expected_approved": True, "expected_fraud_score": 0.2} for i in range(4)]
    (tmp_path / "test.json").write_text(json.dumps({"entries": entries}))
    labeled = readers.read_labeled(spark, str(tmp_path / "test.json"))
    assert labeled.count() == 4 and json.loads(labeled.first().request) == {"id": "0"}
    assert [r.expected_fraud_score for r in readers.limited(labeled, 2, "request").collect()] == [0.2, 0.2]


def test_stream_equals_batch(spark):
    got = {r.qid: r.response for r in registry.stream_score(spark, DATA).collect()}
    index, risks = registry._event_index(spark, DATA), tx.risks(spark)
    asked = tx.requests(spark, DATA).select("qid", "body")
    want = scoring.score(asked, index, tx.NORM, risks, fast=registry.FAST, full=registry.FULL)
    assert got == {r.qid: r.response for r in want.collect()} and len(got) == 1000


def test_bucket_cap(sets):
    raw, refs, queries = sets
    index = ivf.build_ivf(raw, 16, rounds=1)
    want = brute(refs, queries)
    assert found(knn.knn_pruned(index, queries, nprobe=2, skip_self=True, most=128)) == want
    capped = found(knn.knn_pruned(index, queries, nprobe=2, skip_self=True, most=1))
    assert capped.keys() <= want.keys() and capped != want


def test_command_line(spark, tmp_path):
    from tests.test_core import BODY, LAST
    from vicinity import __main__ as cli

    rng = np.random.default_rng(0)
    refs = [{"vector": rng.random(14).round(2).tolist(), "label": "fraud" if i % 2 else "legit"} for i in range(60)]
    with gzip.open(tmp_path / "references.json.gz", "wt") as f:
        json.dump(refs, f)
    (tmp_path / "normalization.json").write_text(json.dumps(tx.NORM))
    (tmp_path / "mcc_risk.json").write_text(json.dumps(tx.RISK))
    bodies = [json.loads(BODY % (a, 100, "[]", "5411", LAST)) for a in (10, 200, 400)]
    entries = [{"request": b, "expected_approved": True, "expected_fraud_score": 0.4} for b in bodies]
    (tmp_path / "test-data.json").write_text(json.dumps({"entries": entries}))
    cli.build(spark, str(tmp_path / "references.json.gz"), str(tmp_path / "index"), 4, 1)
    result = cli.check(spark, str(tmp_path / "index"), str(tmp_path), str(tmp_path / "test-data.json"))
    assert result["n"] == 3 and result["tp"] + result["fn"] == 0 and result["tn"] + result["fp"] == 3
    assert result["score_mismatches"] == len(result["samples"])
    assert cli.check(spark, str(tmp_path / "index"), str(tmp_path), str(tmp_path / "test-data.json"), limit=2)["n"] == 2


def test_request_rate(spark, tmp_path):
    from vicinity.streaming import load

    stream = load.requests_at(spark, ["a", "b"], rate=50)
    query = stream.writeStream.format("memory").queryName("rate_test").start()
    import time

    for _ in range(60):
        time.sleep(0.5)
        if spark.table("rate_test").count() >= 20:
            break
    query.stop()
    rows = spark.table("rate_test").collect()
    assert len(rows) >= 20 and all(r.body == "ab"[r.qid % 2] for r in rows)
    assert all(len(p) == 3 for p in load.throughput(query))

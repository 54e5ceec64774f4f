"""Scalar functions, parsing and features."""

import math
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vicinity.functions import features, scalars, scratch
from vicinity.operators import decide, evaluate
from vicinity.plans import transactions as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x, want", [(-0.5, 0.0), (0.25, 0.25), (1.5, 1.0)])
def test_clamp(spark, x, want):
    assert one(spark, scalars.clamp01(F.lit(x))) == want


def test_clamp_keeps_nan(spark):
    assert math.isnan(one(spark, scalars.clamp01(F.lit(float("nan")))))


@pytest.mark.parametrize(
    "codec, v, want",
    [
        ("int8", -1.0, -128), ("int8", 0.5, 64), ("int8", -0.3, 0), ("int8", 2.0, 127), ("int8", float("nan"), 0),
        ("i16", -1.0, -32768), ("i16", -1.000001, -32768), ("i16", 0.5, 5000), ("i16", 9.0, 32767), ("i16", -0.00005, -1),
        ("i16", float("nan"), 0),
    ],
)
def test_quantize(spark, codec, v, want):
    assert one(spark, scalars.quantize_value(F.lit(v), codec)) == want


@pytest.mark.parametrize("dims", [None, 2])
def test_distance_to_missing_value_does_not_wrap(spark, dims):
    a, b = F.array(F.lit(0), F.lit(0)), F.array(F.lit(-32768), F.lit(-32768))
    assert one(spark, scalars.l2sq(a, b, dims)) == 2147483648


@pytest.mark.parametrize(
    "iso, days, dow, hour",
    [("1970-01-01T00:00:00Z", 0, 3, 0), ("2024-02-29T23:59:59Z", 19782, 3, 23), ("2024-03-03T05:00:00Z", 19785, 6, 5), ("1969-12-31T01:00:00Z", -1, 2, 1)],
)
def test_timestamps(spark, iso, days, dow, hour):
    at = scalars.epoch_seconds(F.lit(iso))
    row = spark.range(1).select(scalars.epoch_days(at), scalars.day_of_week(at), scalars.hour_of(at)).first()
    assert tuple(row) == (days, dow, hour)


def test_minutes(spark):
    got = one(spark, scalars.minutes_between(*(scalars.epoch_seconds(F.lit(t)) for t in ("2024-01-01T00:01:30Z", "2023-12-31T23:59:00Z"))))
    assert got == 2.5


@pytest.mark.parametrize("mcc, want", [("0742", "742"), ("5411", "5411"), ("0000", "0"), ("x", "0")])
def test_mcc_digits(spark, mcc, want):
    assert one(spark, scalars.mcc_digits(F.lit(mcc))) == want


BODY = """{"id":"1","transaction":{"amount":%s,"installments":2.7,"requested_at":"2024-01-01T12:00:00Z"},
"customer":{"avg_amount":%s,"tx_count_24h":3,"known_merchants":%s},"merchant":{"id":"M1","mcc":"%s","avg_amount":50},
"terminal":{"is_online":true,"card_present":false,"km_from_home":10},"last_transaction":%s}"""
LAST = '{"timestamp":"2024-01-01T11:00:00Z","km_from_current":100}'


def vector(spark, body, compat=False):
    df = features.parse(spark.createDataFrame([(1, body)], "qid long, body string"))
    return features.vectorize(df, tx.NORM, tx.risks(spark), compat).first()


def test_vector(spark):
    row = vector(spark, BODY % (250, 100, '["M0","M1"]', "5411", LAST))
    want = [0.5, 2 / 12, 0.25, 12 / 23, 0.0, 60 / 1440, 0.1, 0.01, 0.15, 1.0, 0.0, 0.0, 0.15, 0.1]
    assert row.parsed and row.vector == pytest.approx(want, abs=1e-6)


def test_missing_last_transaction(spark):
    assert vector(spark, BODY % (250, 100, "[]", "5411", "null")).vector[5:7] == [-1.0, -1.0]
    whole = BODY % (250, 100, "[]", "5411", "null")
    assert vector(spark, whole.replace(',"last_transaction":null', "")).vector[5:7] == [-1.0, -1.0]


def test_later_last_transaction(spark):
    late = LAST.replace("11:00", "13:00")
    assert vector(spark, BODY % (1, 1, "[]", "5411", late)).vector[5:7] == pytest.approx([0.0, 0.1])
    assert vector(spark, BODY % (1, 1, "[]", "5411", late), compat=True).vector[5:7] == [-1.0, -1.0]


def test_zero_average(spark):
    assert vector(spark, BODY % (250, 0, "[]", "5411", LAST)).vector[2] == 1.0
    assert math.isnan(vector(spark, BODY % (0, 0, "[]", "5411", LAST)).vector[2])


def test_unknown_merchant_and_code(spark):
    row = vector(spark, BODY % (1, 1, "[null]", "0742", LAST))
    assert row.vector[11] == 1.0 and row.vector[12] == pytest.approx(0.8)
    assert vector(spark, BODY % (1, 1, "[]", "0742", LAST), compat=True).vector[12] == 0.5
    assert vector(spark, BODY % (1, 1, "[]", "9999", LAST)).vector[12] == 0.5


@pytest.mark.parametrize("body", [None, "", "{", '{"id":"1"}', (BODY % (1, 1, "null", "1", LAST)), (BODY % (1, 1, "[]", "1", LAST))[:90]])
def test_parse_failures_keep_the_row(spark, body):
    row = vector(spark, body)
    assert not row.parsed and row.vector is None


def test_key_order_does_not_matter(spark):
    a = BODY % (250, 100, "[]", "5411", LAST)
    head, tail = a[1:-1].split(',"terminal"', 1) if ',"terminal"' in a else a[1:-1].split(',\n"terminal"', 1)
    assert vector(spark, a).vector == vector(spark, '{"terminal"' + tail + "," + head + "}").vector


@pytest.mark.parametrize("n, want", [(0, '{"approved":true,"fraud_score":0.0}'), (2, '{"approved":true,"fraud_score":0.4}'), (3, '{"approved":false,"fraud_score":0.6}'), (9, '{"approved":true,"fraud_score":0.0}')])
def test_response_bodies(spark, n, want):
    assert one(spark, decide.body(F.lit(n))) == want


def test_detection_score_worked_example(spark):
    got = one(spark, F.round(evaluate.detection_score(F.lit(51), F.lit(60), F.lit(0), F.lit(54100))))
    assert got == 1660


@pytest.mark.parametrize("p99, want", [(0.5, 3000), (1.0, 3000), (5.0, 2301), (1000.0, 0)])
def test_latency_score(spark, p99, want):
    assert round(one(spark, evaluate.latency_score(F.lit(p99)))) == want


def test_mismatches_with_tolerance_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0.2, 0.205), (2, 0.2, 0.4), (3, None, 0.2), (4, None, None)], "id int, a double, b double")
    got = evaluate.mismatches(rows, F.col("a"), F.col("b"), 0.01)
    assert [r.id for r in got.orderBy("id").collect()] == [2, 3]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    unset = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset), conf=unset)
    with pytest.raises(ValueError):
        scratch.scratch_dir(session)
    assert scratch.scratch_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_scratch_tables_go_with_their_scope(spark):
    kept = scratch.written(spark.range(5), "kept")
    with scratch.scratch_scope(spark):
        inner = scratch.written(spark.range(7), "inner")
        assert inner.count() == 7
        path = Path(inner_path(inner))
    assert kept.count() == 5 and not path.exists()
    settled = scratch.settled(spark, "settled", lambda: scratch.written(spark.range(3), "inner").select("id"))
    assert settled.count() == 3 and len(list(Path(scratch.scratch_dir(spark)).glob("inner-*"))) == 0


def inner_path(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]

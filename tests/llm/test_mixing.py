import collections
import hashlib
import itertools
import math
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import frame
from vicinity.llm import mixing


def plain_targets(sizes, share=1.5, most=2.0):
    """Water filling, round by round. ``sizes``: source -> words."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            goal |= {s: level * weight[s] for s in free}
            break
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
        free -= over
    return goal


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs):
    rows = mixing.assignments(docs).collect()
    sizes = collections.Counter()
    for r in docs.select("source", "text").collect():
        sizes[r.source] += words(r.text)
    goal = plain_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.copies in (0, 1, 2) and r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s]
    assert len(rows) == docs.count()
    return rows


def plain_draw(rows, share=1.5, most=2.0):
    """Copies of each (doc_id, text, source, weight) row, by a plain Efraimidis-Spirakis draw over whole sources."""
    sizes = collections.Counter()
    for _, text, source, _ in rows:
        sizes[source] += words(text)
    goal, out = plain_targets(sizes, share, most), {}
    for source in sizes:
        drawn = []
        for i, (doc_id, text, s, w) in enumerate(rows):
            if s == source:
                inner = hashlib.md5((text or "").encode()).hexdigest()
                h = hashlib.md5(f"{'' if doc_id is None else doc_id}|{s or ''}|{inner}".encode()).hexdigest()
                u = (int(h[:13], 16) + 0.5) / 2**52
                drawn.append((-math.log(u) / w if w and w > 0 else math.inf, int(h[13:28], 16), i, words(text)))
        epochs = math.floor(goal[source] / sizes[source]) if sizes[source] else 0
        left, taken = goal[source] - epochs * sizes[source], set()
        for _ in range(mixing.ROUNDS):
            upto, fresh = 0, []
            for _, same in itertools.groupby(sorted(x for x in drawn if x[2] not in taken and x[3] <= left and left > 0), key=lambda x: x[:2]):
                same = list(same)  # repeated rows are taken together
                upto += sum(x[3] for x in same)
                if upto > left:
                    break
                fresh += same
            taken |= {x[2] for x in fresh}
            left -= sum(x[3] for x in fresh)
        out |= {x[2]: epochs + (x[2] in taken) for x in drawn}
    return [out[i] for i in range(len(rows))]


def same_as_plain(docs, weight=None, share=1.5):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", (mixing.quality(F.col("text"), mixing.words(F.col("text"))) if weight is None else weight).alias("w")).collect()]
    want = collections.Counter((r[0], r[2], words(r[1]), n) for r, n in zip(rows, plain_draw(rows, share=share)))
    got = collections.Counter((r.doc_id, r.source, r["size"], r.copies) for r in mixing.assignments(docs, weight, share).collect())
    assert got == want


def test_the_documents_of_a_plain_draw_are_taken(corpus, awkward):
    same_as_plain(corpus)
    same_as_plain(awkward)


@pytest.mark.parametrize("weight", ["0.01D", "0D", "CAST(NULL AS DOUBLE)", "CASE WHEN doc_id % 3 = 0 THEN 100D WHEN doc_id % 3 = 1 THEN 1e-6D END", "-1D"])
def test_any_weights(corpus, weight):
    """The documents of a plain draw, and no bucket that holds a source."""
    docs = corpus.withColumn("good", F.expr(weight))
    same_as_plain(docs, F.col("good"), 0.7)
    sized = mixing._sized(docs.withColumn("source", F.lit("one")), F.col("good"))
    assert sized.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 4


def test_sql_draws_the_same(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = collections.Counter(con.sql(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.oracle_sql()})").fetchall())
    got = mixing.op2_mix_sources(spark, "/root/testdata/sf0.001").collect()
    assert collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want


def test_buckets_follow_the_keys(spark):
    rows = [(10.0**e * m, t) for e in range(-16, 8) for m in (1.0, 1.0001, 3.3) for t in (0, 1 << 59)] + [(float("inf"), t) for t in (0, 1, 1 << 50, (1 << 60) - 1)]
    found = spark.createDataFrame(rows, "key double, tie long").select("key", "tie", mixing._bucket(F.col("key"), F.col("tie")).alias("b")).collect()
    assert [r.b for r in sorted(found)] == sorted(r.b for r in found) and max(r.b for r in found) < 2 * mixing.WEIGHTLESS


def test_many_sources(spark):
    rows = [(i, f"word{i} " * (i % 7 + 1), "en", f"host{i % 300:03d}" if i % 50 else None) for i in range(1200)]
    check(frame(spark, rows, clashes=False))


def test_copies_do_not_stand_side_by_side(spark):
    rows = [(i, f"some words {i}", "en", "a") for i in range(40)]
    ids = [r.doc_id for r in mixing.mix(frame(spark, rows, clashes=False).coalesce(1)).collect()]
    assert len(ids) > 40 and len(set(ids[:40])) == 40


def test_corpus(corpus):
    check(corpus)


def test_awkward_rows(awkward):
    check(awkward)


def test_empty(nothing):
    assert mixing.assignments(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_only_empty_texts(spark):
    rows = mixing.assignments(frame(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [(r["size"], r.target, r.copies * r["size"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_reruns_and_row_order_agree(corpus):
    a = {tuple(r) for r in mixing.assignments(corpus).collect()}
    b = {tuple(r) for r in mixing.assignments(corpus.orderBy(F.col("doc_id").desc()).repartition(3)).collect()}
    assert a == b


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from("abcdefgh")), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets_equal_water_filling(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_complete_epochs_come_before_a_fraction(corpus):
    by_source = collections.defaultdict(set)
    for r in mixing.assignments(corpus).collect():
        if r["size"]:
            by_source[r.source].add(r.copies)
    for copies in by_source.values():
        assert max(copies) - min(copies) <= 1


def test_quality_weights_favour_good_documents(spark):
    rows = [(i, f"word{i} " * 60, "en", "abc"[i % 3]) for i in range(1500)]
    docs = frame(spark, rows, clashes=False).withColumn("good", (F.col("doc_id") % 2).cast("double") * 4 + 1)
    got = mixing.assignments(docs, weight=F.col("good"), share=0.6).where("source = 'b'").collect()
    # source b has the smallest weight: 30 % of it is taken
    good, bad = (sum(r.copies for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad


def test_mix_repeats_rows_as_assigned(awkward):
    want = collections.Counter()
    for r in mixing.assignments(awkward).collect():
        want[r.doc_id] += r.copies
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    assert collections.Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +want


def test_main_path_is_native(corpus):
    plan = mixing.assignments(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

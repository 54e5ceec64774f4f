"""Registry of the engine's named queries and their DuckDB oracle SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions import features, scalars
from vicinity.functions.scratch import scratch_path, written
from vicinity.operators import decide, evaluate, ivf, knn, vptree
from vicinity.plans import transactions as tx
from vicinity.sources import index_files, readers
from vicinity.streaming import load
from vicinity.streaming import score as scoring

#: Buckets and probes of the embedding queries: the tables hold 500 to 2,000 vectors.
BUCKETS, FAST, FULL = 16, 2, 6
#: Buckets of the event index, and dims of its vectors.
EVENT_BUCKETS, DIMS = 128, 14
#: Buckets at which a capped search of the events stops.
CAP = 4


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(orig_id, vector, label): the embeddings as a reference set; labels below 4 count as fraud."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("orig_id"), F.col("embedding").alias("vector"), (F.col("label") < 4).cast("int").alias("label"))


def coded(spark: SparkSession, sf_dir: str, codec: str = "i16") -> tuple[DataFrame, DataFrame]:
    """References and queries: all embeddings, each against the others."""
    refs = references(spark, sf_dir).select("orig_id", scalars.quantize(F.col("vector"), codec).alias("codes"), "label")
    return refs, refs.select(F.col("orig_id").alias("qid"), "codes")


def first_index(spark: SparkSession, sf_dir: str) -> ivf.IvfIndex:
    """The index over the initial centroids."""
    refs = references(spark, sf_dir)
    return ivf.index_from(refs, ivf.initial_centroids(refs, BUCKETS))


def _codes_text(spark, sf_dir, codec):
    codes = scalars.quantize(F.col("vector"), codec)
    return references(spark, sf_dir).select("orig_id", F.array_join(codes.cast("array<string>"), ",").alias("codes"))


def quantize_int8(spark, sf_dir):
    return _codes_text(spark, sf_dir, "int8")


def quantize_i16(spark, sf_dir):
    return _codes_text(spark, sf_dir, "i16")


def knn_brute_top5(spark, sf_dir):
    refs, queries = coded(spark, sf_dir)
    return knn.knn_brute(refs, queries, skip_self=True).select("qid", "rank", "orig_id", "dist")


def vptree_knn(spark, sf_dir):
    refs, queries = coded(spark, sf_dir)
    return vptree.knn_vptree(refs, queries, skip_self=True).select("qid", "rank", "orig_id", "dist")


def knn_pruned_exact(spark, sf_dir):
    index = first_index(spark, sf_dir)
    _, queries = coded(spark, sf_dir)
    return knn.knn_pruned(index, queries, nprobe=FAST, skip_self=True).select("qid", "rank", "orig_id", "dist")


def knn_vote(spark, sf_dir):
    refs, queries = coded(spark, sf_dir)
    return decide.vote(queries, knn.knn_brute(refs, queries, skip_self=True))


def knn_decision_json(spark, sf_dir):
    return knn_vote(spark, sf_dir).select("qid", decide.body(F.col("frauds")).alias("response"))


def centroid_distances(spark, sf_dir):
    index = first_index(spark, sf_dir)
    _, queries = coded(spark, sf_dir)
    return knn.probes(index, queries, BUCKETS).select("qid", "bucket", "cdist", "rank")


def ivf_probe(spark, sf_dir):
    index = first_index(spark, sf_dir)
    _, queries = coded(spark, sf_dir)
    return knn.knn_ivf(index, queries, nprobe=FAST, skip_self=True).select("qid", "rank", "orig_id", "dist")


def ivf_two_pass(spark, sf_dir):
    index = first_index(spark, sf_dir)
    _, queries = coded(spark, sf_dir)
    return knn.two_pass(index, queries, fast=FAST, full=FULL, skip_self=True)


def kmeans_assign_init(spark, sf_dir):
    refs = references(spark, sf_dir)
    return ivf.assign(refs, ivf.initial_centroids(refs, BUCKETS)).select("orig_id", "bucket")


def kmeans_update(spark, sf_dir):
    """The sums of k-means' update after the first assignment."""
    refs = references(spark, sf_dir)
    sums = ivf.bucket_sums(refs, ivf.initial_centroids(refs, BUCKETS))
    long = sums.select("bucket", "n", F.posexplode("sums").alias("dim", "total"))
    return long.select("bucket", "n", "dim", F.round("total", 6).alias("total"))


def _centroid_rows(spark, centroids):
    rows = [(i, d, float(x)) for i, c in enumerate(centroids) for d, x in enumerate(c)]
    return spark.createDataFrame(rows, "bucket int, dim int, value double").withColumn("value", F.round("value", 5))


def kmeans_final(spark, sf_dir):
    return _centroid_rows(spark, ivf.lloyd(references(spark, sf_dir), BUCKETS))


def kmeans_layout(spark, sf_dir):
    return ivf.layout(ivf.build_ivf(references(spark, sf_dir), BUCKETS))


def kmeans_reseed(spark, sf_dir):
    """A round over few distinct vectors: buckets that start on the same one are empty, and reseeded."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector = F.array((F.col("label") * F.lit(0.5)).cast("float"), (F.col("label") % 3).cast("float"))
    refs = rows.select(F.col("vec_id").alias("orig_id"), vector.alias("vector"), F.lit(0).alias("label"))
    return _centroid_rows(spark, ivf.lloyd(refs, BUCKETS, 1))


def index_places(spark, sf_dir):
    """Each row's place in the index: its bucket's start and its rank by id in the bucket."""
    index = first_index(spark, sf_dir)
    rank = F.row_number().over(ivf.Window.partitionBy("bucket").orderBy("orig_id"))
    return ivf.placed(index).join(ivf.layout(index).select("bucket", "start"), "bucket").select("orig_id", "bucket", (F.col("start") + rank - 1).alias("place"))


def knn_int8(spark, sf_dir):
    refs, queries = coded(spark, sf_dir, "int8")
    return knn.knn_brute(refs, queries, skip_self=True).select("qid", "rank", "orig_id", "dist")


def fraud_count(spark, sf_dir):
    """The index's one-call interface, on raw vectors; a vector finds itself too."""
    index = first_index(spark, sf_dir)
    vectors = references(spark, sf_dir).select(F.col("orig_id").alias("qid"), "vector")
    return knn.fraud_count(index, vectors, fast=FAST, full=FULL)


def index_file(spark, sf_dir):
    """The index written as a binary file and read back by Spark: (orig_id, bucket, label, codes)."""
    folder = scratch_path(spark, "index-file")
    index_files.write_index_file(first_index(spark, sf_dir), folder)
    rows, _ = index_files.read_index_files(spark, folder)
    return rows.select("orig_id", "bucket", "label", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


def index_file_centroids(spark, sf_dir):
    """The centroid table of an index file of the first version, which has no radius."""
    folder = scratch_path(spark, "index-file")
    index_files.write_index_file(first_index(spark, sf_dir), folder, version=1)
    _, table = index_files.read_index_files(spark, folder)
    codes = scalars.quantize(F.col("centroid"))
    return table.select("bucket", F.array_join(codes.cast("array<string>"), ",").alias("codes"), "n", F.col("radius").isNull().alias("no_radius"))


def index_table(spark, sf_dir):
    """Search of an index that was saved as tables, loaded and warmed up."""
    folder = scratch_path(spark, "index-table")
    index_files.save_index(first_index(spark, sf_dir), folder)
    index = ivf.warm_up(index_files.load_index(spark, folder, "i16"))
    _, queries = coded(spark, sf_dir)
    found = written(knn.knn_ivf(index, queries, nprobe=FAST, skip_self=True).select("qid", "rank", "orig_id", "dist"), "found")
    ivf.cool_down(index)
    return found


def vectors_file(spark, sf_dir):
    """Quantized vectors and labels, saved and loaded."""
    path = scratch_path(spark, "vectors")
    index_files.save_vectors(coded(spark, sf_dir, "int8")[0], path)
    rows = index_files.load_vectors(spark, path)
    return rows.select("orig_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), "label")


def _through_file(x):
    return index_files.decode_tree(index_files.encode_tree(vptree.build(x, leaf=1)))


def vptree_file(spark, sf_dir):
    """Exact search by trees that went through their binary form."""
    refs, queries = coded(spark, sf_dir)
    return vptree.knn_vptree(refs, queries, skip_self=True, grow=_through_file).select("qid", "rank", "orig_id", "dist")


def scan_references(spark, sf_dir):
    """Reference files: JSON arrays, gzipped, a file for each hundred vectors."""
    path = scratch_path(spark, "references")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("label") < 4, "fraud").otherwise("legit")
    part = F.floor(F.col("vec_id") / 100)
    entry = F.struct(F.col("embedding").alias("vector"), label.alias("label"))
    arrays = rows.groupBy(part.alias("part")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("vec_id", entry.alias("e")))).getField("e")).alias("value"))
    arrays.write.partitionBy("part").option("compression", "gzip").text(path)
    found = readers.read_references(spark, f"{path}/*/*")
    return found.select(F.array_join(scalars.quantize(F.col("vector")).cast("array<string>"), ",").alias("codes"), "label")


def scan_labeled(spark, sf_dir):
    """A labelled set: entries of a request and what is expected, a file for each 500."""
    path = scratch_path(spark, "labeled")
    rows = tx.requests(spark, sf_dir).where("qid % 97 <> 0")
    fraud = F.col("event_type") == "error"
    entry = F.struct(F.from_json("body", features.PAYLOAD).alias("request"), (~fraud).alias("expected_approved"), F.when(fraud, 1.0).otherwise(0.2).alias("expected_fraud_score"))
    files = rows.groupBy(F.floor(F.col("qid") / 500).alias("part")).agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("value"))
    files.write.partitionBy("part").text(path)
    found = readers.read_labeled(spark, f"{path}/*/*")
    return found.select(F.get_json_object("request", "$.id").cast("long").alias("qid"), "expected_approved", "expected_fraud_score")


def scan_limit(spark, sf_dir):
    return readers.limited(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), 100, "event_id")


def scan_config(spark, sf_dir):
    """The normalization constants and category risks, from their files."""
    folder = scratch_path(spark, "config")
    for name, value in (("normalization", tx.NORM), ("mcc_risk", tx.RISK)):
        spark.range(1).select(F.lit(json.dumps(value)).alias("value")).write.text(f"{folder}/{name}.json")
    norm = readers.read_normalization(spark, f"{folder}/normalization.json")
    constants = spark.createDataFrame(list(norm.items()), "name string, value double")
    return constants.union(readers.read_mcc_risk(spark, f"{folder}/mcc_risk.json"))


def bucket_layout(spark, sf_dir):
    return ivf.layout(first_index(spark, sf_dir))


def bucket_radius(spark, sf_dir):
    return first_index(spark, sf_dir).centroids.select("bucket", "radius_sq")


def label_bitmap(spark, sf_dir):
    packed = decide.label_bitmap(references(spark, sf_dir))
    return packed.select("bucket_number", F.bitmap_count("bitmap").alias("frauds"))


def label_bit_test(spark, sf_dir):
    """Labels read back from the bitmap."""
    refs = references(spark, sf_dir)
    at = F.col("orig_id") + 1
    rows = refs.select("orig_id", F.bitmap_bucket_number(at).alias("bucket_number"), F.bitmap_bit_position(at).alias("position"))
    rows = rows.join(decide.label_bitmap(refs), "bucket_number", "left")
    return rows.select("orig_id", F.coalesce(scalars.bit_at(F.col("bitmap"), F.col("position")).cast("int"), F.lit(0)).alias("label"))


def _vectors(spark, sf_dir):
    seen = features.parse(tx.requests(spark, sf_dir))
    return features.vectorize(seen, tx.NORM, tx.risks(spark))


def _codes(rows):
    return rows.where("parsed").select("qid", F.posexplode(scalars.quantize(F.col("vector"), dims=DIMS)).alias("dim", "code"))


def features_events(spark, sf_dir):
    return _codes(_vectors(spark, sf_dir))


def features_compat(spark, sf_dir):
    """The features as the positional parsers read them."""
    return _codes(features.vectorize(features.parse(tx.requests(spark, sf_dir)), tx.NORM, tx.risks(spark), compat=True))


def request_source(spark, sf_dir):
    """Request bodies that arrive as text, a line each, read as a stream."""
    folder = scratch_path(spark, "requests")
    tx.requests(spark, sf_dir).select("body").write.text(f"{folder}/in")
    seen = features.parse(readers.request_stream(spark, f"{folder}/in")).select(F.get_json_object("body", "$.id").cast("long").alias("qid"), "parsed")
    seen.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("qid long, parsed boolean").parquet(f"{folder}/out").where("parsed")


def payload_parse(spark, sf_dir):
    seen = features.parse(tx.requests(spark, sf_dir))
    cents = F.round(F.col("payload.transaction.amount") * 100).cast("bigint")
    return seen.select("qid", "parsed", F.when(F.col("parsed"), cents).otherwise(F.lit(-1)).alias("cents"), (F.col("parsed") & F.col("payload.last_transaction").isNotNull()).alias("has_last"))


def mcc_lookup(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    mcc = F.element_at(F.create_map(*[F.lit(x) for pair in tx.MCC.items() for x in pair]), F.col("event_type"))
    return features.with_risk(events.select("event_id", mcc.alias("mcc")), F.col("mcc"), tx.risks(spark)).select("event_id", "mcc", "risk")


def unknown_merchant(spark, sf_dir):
    seen = features.parse(tx.requests(spark, sf_dir)).where("parsed")
    return seen.select("qid", features.unknown_merchant(F.col("payload.merchant.id"), F.col("payload.customer.known_merchants")).alias("unknown"))


def _judged(spark, sf_dir):
    """labels as pairs of a decision and its expectation."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rows.select("doc_id", (F.col("toxic") == 0).alias("got"), (F.col("quality") == 1).alias("expected"))


def confusion(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir), F.col("got"), F.col("expected"))


def failure_rate(spark, sf_dir):
    return evaluate.failure_rate(confusion(spark, sf_dir)).select("n", F.round("failure_rate", 9).alias("failure_rate"))


def detection_score(spark, sf_dir):
    m = confusion(spark, sf_dir)
    value = evaluate.detection_score(F.col("fp"), F.col("fn"), F.lit(0), F.col("n"))
    return m.select(evaluate.weighted_errors(F.col("fp"), F.col("fn"), F.lit(0)).alias("errors"), F.round(value).cast("bigint").alias("score"))


def mismatches(spark, sf_dir):
    wrong = evaluate.mismatches(_judged(spark, sf_dir), F.col("got"), F.col("expected"))
    return wrong.select("doc_id", "got", "expected")


def mismatch_samples(spark, sf_dir):
    return evaluate.samples(mismatches(spark, sf_dir), "doc_id")


def latency_quantiles(spark, sf_dir):
    rows = evaluate.latencies(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value"))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


def latency_points(spark, sf_dir):
    rows = evaluate.latencies(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value"))
    return rows.select(F.round(evaluate.latency_score(F.col("p99"))).cast("bigint").alias("points"))


def final_points(spark, sf_dir):
    """The final score: that of detection and that of latency."""
    rows = latency_quantiles(spark, sf_dir).select(evaluate.latency_score(F.col("p99")).alias("latency"))
    m = confusion(spark, sf_dir).select(evaluate.detection_score(F.col("fp"), F.col("fn"), F.lit(0), F.col("n")).alias("detection"))
    return m.join(rows, F.lit(True)).select(F.round(evaluate.final_score(F.col("detection"), F.col("latency"))).cast("bigint").alias("points"))


def mismatch_report(spark, sf_dir):
    """The mismatches, written as JSON lines and read back."""
    path = scratch_path(spark, "mismatches")
    evaluate.write_mismatches(mismatches(spark, sf_dir), path)
    return spark.read.schema("doc_id long, got boolean, expected boolean").json(path)


def _event_references(spark, sf_dir):
    """All events that can be read, as a reference set whose ids are positions, with codes; fraud if they are errors."""
    rows = _vectors(spark, sf_dir).where("parsed").select("qid", "vector", (F.col("event_type") == "error").cast("int").alias("label"))
    return written(ivf.positions(rows, "qid").withColumn("codes", scalars.quantize(F.col("vector"), dims=DIMS)), "events")


def _event_queries(refs):
    return refs.select(F.col("orig_id").alias("qid"), "codes")


def _first_event_index(refs):
    return ivf.index_from(refs, ivf.initial_centroids(refs, EVENT_BUCKETS))


def event_ivf(spark, sf_dir):
    """Probes and inverted lists of short vectors, at the shape of the original workload."""
    refs = _event_references(spark, sf_dir)
    return knn.knn_ivf(_first_event_index(refs), _event_queries(refs), nprobe=FAST, skip_self=True).select("qid", "rank", "orig_id", "dist")


def event_two_pass(spark, sf_dir):
    refs = _event_references(spark, sf_dir)
    return knn.two_pass(_first_event_index(refs), _event_queries(refs), fast=FAST, full=FULL, skip_self=True)


def event_pruned(spark, sf_dir):
    """Exact search by pruning, with the query's own event left out."""
    refs = _event_references(spark, sf_dir)
    return knn.knn_pruned(_first_event_index(refs), _event_queries(refs), nprobe=FAST, skip_self=True).select("qid", "rank", "orig_id", "dist")


def event_capped(spark, sf_dir):
    """Pruned search that stops at four buckets: two probed ones, and the two nearest that can hold a nearer row."""
    refs = _event_references(spark, sf_dir)
    return knn.knn_pruned(_first_event_index(refs), _event_queries(refs), nprobe=FAST, skip_self=True, most=CAP).select("qid", "rank", "orig_id", "dist")


def event_decisions(spark, sf_dir):
    """A decision on every event, by exact search of all others; one that can't be read is approved with score 0."""
    refs = _event_references(spark, sf_dir)
    queries = refs.select(F.col("orig_id").alias("qid"), "codes", F.col("qid").alias("event_id"))
    voted = knn.exact_frauds(_first_event_index(refs), queries, nprobe=FULL, skip_self=True).select("event_id", "frauds")
    frauds = F.coalesce("frauds", F.lit(0))
    asked = tx.requests(spark, sf_dir).select(F.col("qid").alias("event_id"))
    return asked.join(voted, "event_id", "left").select(F.col("event_id").alias("qid"), frauds.alias("frauds"), decide.approved(frauds).alias("approved"))


def _event_judged(spark, sf_dir):
    """The index's approximate decisions beside the exact ones, by event."""
    refs = _event_references(spark, sf_dir)
    index, queries = _first_event_index(refs), _event_queries(refs)
    asked = knn.distinct(queries)
    got = knn.two_pass(index, queries, fast=FAST, full=FULL, skip_self=True, asked=asked).select("qid", decide.score(F.col("frauds")).alias("got"))
    want = knn.exact_frauds(index, queries, nprobe=FULL, skip_self=True, asked=asked).select("qid", decide.score(F.col("frauds")).alias("expected"))
    return evaluate.compare(got, want, "qid")


def event_confusion(spark, sf_dir):
    """The confusion matrix of the index's decisions against those of exact search."""
    return evaluate.confusion(_event_judged(spark, sf_dir), F.col("got") < 0.6, F.col("expected") < 0.6)


def event_mismatches(spark, sf_dir):
    """Events whose approximate score differs from the exact one by more than a tolerance."""
    return evaluate.mismatches(_event_judged(spark, sf_dir), F.col("got"), F.col("expected"), 0.01).select("qid", "got", "expected")


def _event_index(spark, sf_dir):
    """A trained index of all events that can be read."""
    return ivf.build_ivf(_event_references(spark, sf_dir).select("orig_id", "vector", "label"), EVENT_BUCKETS)


def stream_score(spark, sf_dir):
    """Scores all requests as a stream over arriving files, and returns what the sink holds. Events find themselves too."""
    folder = scratch_path(spark, "stream")
    tx.requests(spark, sf_dir).select("qid", "body").write.parquet(f"{folder}/in")
    index_files.save_index(_event_index(spark, sf_dir), f"{folder}/index")
    index, risks = ivf.warm_up(index_files.load_index(spark, f"{folder}/index")), tx.risks(spark)
    stream = spark.readStream.schema("qid long, body string").parquet(f"{folder}/in")
    run = scoring.score_stream(stream, lambda batch: scoring.score(batch, index, tx.NORM, risks, fast=FAST, full=FULL), f"{folder}/out", f"{folder}/log", once=True)
    run.awaitTermination()
    ivf.cool_down(index)
    return spark.read.parquet(f"{folder}/out").select("qid", "frauds", "approved", "response")


def stream_progress(spark, sf_dir):
    """The rows that a stream's micro-batches report to have read."""
    folder = scratch_path(spark, "progress")
    tx.requests(spark, sf_dir).select("qid", "body").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("qid long, body string").parquet(f"{folder}/in")
    run = scoring.score_stream(stream, lambda batch: features.parse(batch).select("qid", "parsed"), f"{folder}/out", f"{folder}/log", once=True)
    run.awaitTermination()
    return spark.createDataFrame([(sum(rows for _, rows, _ in load.throughput(run)),)], "n_rows long")


def queries() -> dict:
    return {f.__name__: f for f in (
        quantize_int8, quantize_i16, knn_brute_top5, knn_int8, knn_vote, knn_decision_json, vptree_knn, vptree_file,
        knn_pruned_exact, centroid_distances, ivf_probe, ivf_two_pass, fraud_count, kmeans_assign_init, kmeans_update,
        kmeans_final, kmeans_layout, kmeans_reseed, bucket_layout, bucket_radius, index_places, index_file,
        index_file_centroids, index_table, vectors_file, scan_references, scan_labeled, scan_limit, scan_config,
        label_bitmap, label_bit_test, features_events, features_compat, payload_parse, request_source, mcc_lookup,
        unknown_merchant, confusion, failure_rate, detection_score, mismatches, mismatch_samples, mismatch_report,
        latency_quantiles, latency_points, final_points, event_ivf, event_two_pass, event_pruned, event_capped,
        event_decisions, event_confusion, event_mismatches, stream_score, stream_progress,
    )}


def _code_sql(codec: str, x: str = "x") -> str:
    scale, missing, low, high = scalars.CODECS[codec]
    scaled = f"{x} * CAST({scale} AS FLOAT)"
    whole = f"floor(CAST({scaled} AS DOUBLE) + 0.5)" if codec == "int8" else f"round({scaled})"
    test = f"{x} = -1" if codec == "int8" else f"abs({x} + CAST(1 AS FLOAT)) < 1e-5"
    return f"CASE WHEN isnan({x}) THEN 0 WHEN {test} THEN {missing} ELSE CAST(greatest({low}, least({high}, {whole})) AS BIGINT) END"


def _codes_sql(codec: str = "i16") -> str:
    return f"list_transform(embedding, lambda x: {_code_sql(codec)})"


def _far_sql(a: str, b: str, kind: str = "BIGINT") -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::{kind} - z[2]::{kind}) * (z[1]::{kind} - z[2]::{kind})))"


_REFS = f"refs AS (SELECT vec_id AS orig_id, embedding, {_codes_sql()} AS codes, CAST(label < 4 AS INT) AS label FROM embeddings)"
_TOP = f"""
pairs AS (SELECT q.orig_id AS qid, r.orig_id, r.label, CAST({_far_sql("q.codes", "r.codes")} AS BIGINT) AS dist
    FROM refs q JOIN refs r ON q.orig_id <> r.orig_id),
near AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, orig_id) AS INT) AS rank, orig_id, label, dist
    FROM pairs QUALIFY rank <= 5)
"""
_VOTES = f"WITH {_REFS}, {_TOP}, votes AS (SELECT qid, CAST(sum(label) AS INT) AS frauds FROM near GROUP BY qid)"
_CENTRES = f"""
centres AS (SELECT CAST(i AS INT) AS bucket, embedding AS c, codes AS cc FROM range({BUCKETS}) t(i)
    JOIN refs ON orig_id = i * (SELECT count(*) FROM refs) // {BUCKETS}),
assigned AS (SELECT orig_id, codes, label, bucket, cc FROM refs CROSS JOIN centres
    QUALIFY row_number() OVER (PARTITION BY orig_id ORDER BY {_far_sql("embedding", "c", "DOUBLE")}, bucket) = 1),
probed AS (SELECT orig_id AS qid, codes, bucket, CAST({_far_sql("codes", "cc")} AS BIGINT) AS cdist,
    CAST(row_number() OVER (PARTITION BY orig_id ORDER BY {_far_sql("codes", "cc")}, bucket) AS INT) AS rank FROM refs CROSS JOIN centres)
"""


def _ivf_sql(n: int, name: str) -> str:
    return f"""
{name} AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, orig_id) AS INT) AS rank, orig_id, label, dist FROM (
    SELECT p.qid, a.orig_id, a.label, CAST({_far_sql("p.codes", "a.codes")} AS BIGINT) AS dist
    FROM probed p JOIN assigned a ON p.bucket = a.bucket AND p.qid <> a.orig_id WHERE p.rank <= {n}) QUALIFY rank <= 5)
"""


def _mean_sql(number: int) -> str:
    """A round of k-means: centres{number} to centres{number + 1}, over refs (orig_id, embedding) with reseeding."""
    return f"""
near{number} AS (SELECT orig_id, embedding, bucket FROM refs CROSS JOIN centres{number}
    QUALIFY row_number() OVER (PARTITION BY orig_id ORDER BY {_far_sql("embedding", "c", "DOUBLE")}, bucket) = 1),
long{number} AS (SELECT bucket, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM near{number}),
means{number} AS (SELECT bucket, list(m ORDER BY d) AS c FROM
    (SELECT bucket, d, CAST(sum(x) / count(*) AS FLOAT) AS m FROM long{number} GROUP BY bucket, d) GROUP BY bucket),
centres{number + 1} AS (SELECT s.bucket, coalesce(m.c, r.embedding) AS c FROM centres{number} s LEFT JOIN means{number} m USING (bucket)
    JOIN refs r ON r.orig_id = s.bucket * {ivf.RESEED} % (SELECT count(*) FROM refs))"""


_START = f"""centres0 AS (SELECT CAST(i AS INT) AS bucket, embedding AS c FROM range({BUCKETS}) t(i)
    JOIN refs ON orig_id = i * (SELECT count(*) FROM refs) // {BUCKETS})"""
_LONG_CENTRES = """SELECT bucket, CAST(unnest(range(len(c))) AS INT) AS dim, round(unnest(c)::DOUBLE, 5) AS value FROM """


def _wide(a: str, b: str, x: str, kind: str) -> str:
    return "(" + " + ".join(f"({a}.{x}{d}::{kind} - {b}.{x}{d}::{kind}) * ({a}.{x}{d}::{kind} - {b}.{x}{d}::{kind})" for d in range(DIMS)) + ")"


def _event_sql(rounds: int = 0) -> str:
    """ev (orig_id, event_id, label, x0.., c0..: floats and codes), its centres after so many rounds, and each row's bucket."""
    every = lambda text, sep=", ": sep.join(text.replace("#", str(d)) for d in range(DIMS))
    floats = ", ".join(f"CAST({x} AS FLOAT) AS x{i}" for i, x in enumerate(tx.DIMS_SQL))
    codes = ", ".join(f"CAST({_code_sql('i16', f'x{d}')} AS BIGINT) AS c{d}" for d in range(DIMS))
    parts = [f"""{tx.SQL}, raw AS (SELECT event_id, CAST(event_type = 'error' AS INT) AS label, {floats} FROM tx WHERE event_id % 97 <> 0),
ev AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id) - 1 AS orig_id, *, {codes} FROM raw),
m0 AS MATERIALIZED (SELECT CAST(i AS INT) AS bucket, {every("x#")} FROM range({EVENT_BUCKETS}) t(i)
    JOIN ev ON orig_id = i * (SELECT count(*) FROM ev) // {EVENT_BUCKETS})"""]
    for r in range(rounds + 1):
        parts.append(f"""b{r} AS MATERIALIZED (SELECT e.orig_id, m.bucket FROM ev e CROSS JOIN m{r} m
    QUALIFY row_number() OVER (PARTITION BY e.orig_id ORDER BY {_wide("e", "m", "x", "DOUBLE")}, m.bucket) = 1)""")
        if r < rounds:
            parts.append(f"""m{r + 1} AS MATERIALIZED (SELECT m.bucket, {every("coalesce(s.x#, seed.x#) AS x#")} FROM m{r} m
    LEFT JOIN (SELECT bucket, {every("CAST(sum(x#::DOUBLE) / count(*) AS FLOAT) AS x#")} FROM b{r} JOIN ev USING (orig_id) GROUP BY bucket) s USING (bucket)
    JOIN ev seed ON seed.orig_id = m.bucket * {ivf.RESEED} % (SELECT count(*) FROM ev))""")
    mcodes = ", ".join(f"CAST({_code_sql('i16', f'x{d}')} AS BIGINT) AS c{d}" for d in range(DIMS))
    parts.append(f"centres AS (SELECT bucket, {mcodes} FROM m{rounds})")
    parts.append(f"""probed AS MATERIALIZED (SELECT e.orig_id AS qid, m.bucket, row_number() OVER (PARTITION BY e.orig_id
    ORDER BY {_wide("e", "m", "c", "BIGINT")}, m.bucket) AS place FROM ev e CROSS JOIN centres m QUALIFY place <= {FULL})""")
    return "WITH " + ",\n".join(parts) + f",\nlists AS (SELECT ev.*, bucket FROM ev JOIN b{rounds} USING (orig_id))"


def _event_near(n: int, name: str, own: bool = False) -> str:
    """The five nearest of n probed buckets."""
    left_out = "" if own else "AND q.orig_id <> r.orig_id"
    return f"""{name} AS MATERIALIZED (SELECT p.qid, r.orig_id, r.label, CAST({_wide("q", "r", "c", "BIGINT")} AS BIGINT) AS dist,
    CAST(row_number() OVER (PARTITION BY p.qid ORDER BY dist, r.orig_id) AS INT) AS rank
    FROM probed p JOIN ev q ON q.orig_id = p.qid JOIN lists r ON r.bucket = p.bucket {left_out} WHERE p.place <= {n} QUALIFY rank <= 5)"""


def _event_votes(own: bool = False) -> str:
    count = lambda name: f"(SELECT e.orig_id AS qid, CAST(coalesce(sum(n.label), 0) AS INT) AS frauds FROM ev e LEFT JOIN {name} n ON n.qid = e.orig_id GROUP BY 1)"
    return f"""{_event_near(FAST, "fast", own)}, {_event_near(FULL, "full_", own)},
votes AS (SELECT a.qid, CASE WHEN a.frauds IN (2, 3) THEN b.frauds ELSE a.frauds END AS frauds FROM {count("fast")} a JOIN {count("full_")} b USING (qid))"""


_EVENT_CAPPED = f"""radii AS (SELECT l.bucket, sqrt(max({_wide("l", "m", "c", "BIGINT")})::DOUBLE) AS radius FROM lists l JOIN centres m USING (bucket) GROUP BY 1),
worst AS (SELECT qid, max(dist) FILTER (rank = 5) AS far FROM fast GROUP BY qid),
apart AS (SELECT e.orig_id AS qid, m.bucket, {_wide("e", "m", "c", "BIGINT")} AS cdist, row_number() OVER (PARTITION BY e.orig_id ORDER BY cdist, m.bucket) AS place
    FROM ev e CROSS JOIN centres m),
later AS (SELECT a.qid, a.bucket FROM apart a LEFT JOIN radii r USING (bucket) LEFT JOIN worst w USING (qid) WHERE place > {FAST}
    AND (far IS NULL OR greatest(0, sqrt(cdist::DOUBLE) - coalesce(radius, 0)) ** 2 <= far * (1 + 1e-9::DOUBLE) + 1e-6::DOUBLE)
    QUALIFY row_number() OVER (PARTITION BY a.qid ORDER BY cdist, a.bucket) <= {CAP - FAST}),
more AS (SELECT p.qid, r.orig_id, CAST({_wide("q", "r", "c", "BIGINT")} AS BIGINT) AS dist
    FROM later p JOIN ev q ON q.orig_id = p.qid JOIN lists r ON r.bucket = p.bucket AND q.orig_id <> r.orig_id),
capped AS (SELECT qid, orig_id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, orig_id) AS INT) AS rank
    FROM (SELECT qid, orig_id, dist FROM fast UNION ALL SELECT * FROM more) QUALIFY rank <= 5)"""

#: (orig_id, dist) of the five nearest of all, as one number each: squared distances are below 10^11 and ids below 10^7.
_EVENT_EXACT = f"""hits AS (SELECT q.orig_id AS qid, unnest(list_sort(min({_wide("q", "r", "c", "BIGINT")}::HUGEINT * 10000000 + r.orig_id, 5))) AS hit
    FROM ev q JOIN ev r ON q.orig_id <> r.orig_id GROUP BY q.orig_id),
exact AS MATERIALIZED (SELECT qid, CAST(hit % 10000000 AS BIGINT) AS orig_id, CAST(hit // 10000000 AS BIGINT) AS dist FROM hits),
truth AS (SELECT qid, CAST(sum(label) AS INT) AS frauds FROM exact JOIN ev USING (orig_id) GROUP BY qid)"""

_JUDGED = "judged AS (SELECT doc_id, toxic = 0 AS got, quality = 1 AS expected FROM labels)"
_MATRIX = f"""{_JUDGED}, matrix AS (SELECT CAST(count_if(NOT got AND NOT expected) AS BIGINT) AS tp, CAST(count_if(got AND expected) AS BIGINT) AS tn,
    CAST(count_if(NOT got AND expected) AS BIGINT) AS fp, CAST(count_if(got AND NOT expected) AS BIGINT) AS fn,
    CAST(count_if(got IS NOT NULL AND expected IS NOT NULL) AS BIGINT) AS n FROM judged)"""


def oracle_sql() -> dict:
    brute = f"WITH {_REFS}, {_TOP} SELECT qid, rank, orig_id, dist FROM near"
    index = f"WITH {_REFS}, {_CENTRES}"
    rounds = f"{_START}, {', '.join(map(_mean_sql, range(ivf.ROUNDS)))}"
    dims = " UNION ALL ".join(f"SELECT event_id, {i} AS dim, CAST({x} AS FLOAT) AS v FROM tx WHERE event_id % 97 <> 0" for i, x in enumerate(tx.DIMS_SQL))
    mcc = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.MCC.items()) + " END"
    risk = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {tx.RISK[v]}" for k, v in tx.MCC.items() if v in tx.RISK) + " ELSE 0.5 END"
    return {
        "quantize_int8": f"SELECT vec_id AS orig_id, array_to_string({_codes_sql('int8')}, ',') AS codes FROM embeddings",
        "quantize_i16": f"SELECT vec_id AS orig_id, array_to_string({_codes_sql('i16')}, ',') AS codes FROM embeddings",
        "knn_brute_top5": brute,
        "vptree_knn": brute,
        "knn_pruned_exact": brute,
        "knn_vote": f"{_VOTES} SELECT qid, frauds, frauds / 5 AS fraud_score, frauds < 3 AS approved FROM votes",
        "knn_decision_json": f"""{_VOTES} SELECT qid, '{{"approved":' || CASE WHEN frauds < 3 THEN 'true' ELSE 'false' END
            || ',"fraud_score":' || CAST(frauds * 2 // 10 AS VARCHAR) || '.' || CAST(frauds * 2 % 10 AS VARCHAR) || '}}' AS response FROM votes""",
        "centroid_distances": f"{index} SELECT qid, bucket, cdist, rank FROM probed",
        "ivf_probe": f"{index}, {_ivf_sql(FAST, 'fast')} SELECT qid, rank, orig_id, dist FROM fast",
        "ivf_two_pass": f"""{index}, {_ivf_sql(FAST, "fast")}, {_ivf_sql(FULL, "full_")},
            a AS (SELECT q.orig_id AS qid, CAST(coalesce(sum(f.label), 0) AS INT) AS frauds FROM refs q LEFT JOIN fast f ON f.qid = q.orig_id GROUP BY 1),
            b AS (SELECT q.orig_id AS qid, CAST(coalesce(sum(f.label), 0) AS INT) AS frauds FROM refs q LEFT JOIN full_ f ON f.qid = q.orig_id GROUP BY 1)
            SELECT a.qid, CASE WHEN a.frauds IN (2, 3) THEN b.frauds ELSE a.frauds END AS frauds FROM a JOIN b USING (qid)""",
        "kmeans_assign_init": f"{index} SELECT orig_id, bucket FROM assigned",
        "kmeans_update": f"""{index}, long AS (SELECT bucket, CAST(unnest(range(len(embedding))) AS INT) AS dim, unnest(embedding)::DOUBLE AS x FROM assigned JOIN refs USING (orig_id))
            SELECT bucket, count(*) AS n, dim, round(sum(x), 6) AS total FROM long GROUP BY bucket, dim""",
        "kmeans_final": f"WITH {_REFS}, {rounds} {_LONG_CENTRES} centres3",
        "kmeans_layout": f"""WITH {_REFS}, {rounds}, home AS (SELECT orig_id, bucket FROM refs CROSS JOIN centres3
                QUALIFY row_number() OVER (PARTITION BY orig_id ORDER BY {_far_sql("embedding", "c", "DOUBLE")}, bucket) = 1),
            sizes AS (SELECT c.bucket, count(h.orig_id) AS n FROM centres3 c LEFT JOIN home h USING (bucket) GROUP BY c.bucket)
            SELECT bucket, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sizes""",
        "kmeans_reseed": f"""WITH refs AS (SELECT vec_id AS orig_id, [CAST(label * 0.5 AS FLOAT), CAST(label % 3 AS FLOAT)] AS embedding FROM embeddings),
            {_START}, {_mean_sql(0)} {_LONG_CENTRES} centres1""",
        "index_places": f"{index} SELECT orig_id, bucket, CAST(row_number() OVER (ORDER BY bucket, orig_id) - 1 AS BIGINT) AS place FROM assigned",
        "index_file": f"{index} SELECT orig_id, bucket, label, array_to_string(codes, ',') AS codes FROM assigned",
        "index_file_centroids": f"""{index} SELECT c.bucket, array_to_string(c.cc, ',') AS codes, count(a.orig_id) AS n, true AS no_radius
            FROM centres c LEFT JOIN assigned a USING (bucket) GROUP BY ALL""",
        "index_table": f"{index}, {_ivf_sql(FAST, 'fast')} SELECT qid, rank, orig_id, dist FROM fast",
        "vectors_file": f"SELECT vec_id AS orig_id, array_to_string({_codes_sql('int8')}, ',') AS codes, CAST(label < 4 AS INT) AS label FROM embeddings",
        "vptree_file": brute,
        "knn_int8": f"WITH {_REFS.replace(_codes_sql(), _codes_sql('int8'))}, {_TOP} SELECT qid, rank, orig_id, dist FROM near",
        "fraud_count": f"""{index}, {_ivf_sql(FAST, "fast").replace("AND p.qid <> a.orig_id", "")}, {_ivf_sql(FULL, "full_").replace("AND p.qid <> a.orig_id", "")},
            a AS (SELECT qid, CAST(sum(label) AS INT) AS frauds FROM fast GROUP BY 1), b AS (SELECT qid, CAST(sum(label) AS INT) AS frauds FROM full_ GROUP BY 1)
            SELECT a.qid, CASE WHEN a.frauds IN (2, 3) THEN b.frauds ELSE a.frauds END AS frauds FROM a JOIN b USING (qid)""",
        "scan_references": f"SELECT array_to_string({_codes_sql()}, ',') AS codes, CAST(label < 4 AS INT) AS label FROM embeddings",
        "scan_labeled": """SELECT event_id AS qid, event_type <> 'error' AS expected_approved, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.2 END::DOUBLE AS expected_fraud_score
            FROM events WHERE event_id % 97 <> 0""",
        "scan_limit": "SELECT event_id FROM events ORDER BY event_id LIMIT 100",
        "scan_config": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in {**tx.NORM, **tx.RISK}.items()) + ") t(name, value)",
        "features_compat": f"""WITH {tx.SQL}, long AS ({dims.replace("WHEN 'error' THEN 0.8", "WHEN 'error' THEN 0.5")})
            SELECT event_id AS qid, dim, CAST({_code_sql('i16', 'v')} AS INT) AS code FROM long""",
        "request_source": "SELECT event_id AS qid, true AS parsed FROM events WHERE event_id % 97 <> 0",
        "mismatch_report": f"WITH {_JUDGED} SELECT doc_id, got, expected FROM judged WHERE got IS DISTINCT FROM expected",
        "final_points": f"""WITH {_MATRIX}, e AS (SELECT n, fp + 3 * fn AS errors FROM matrix),
            p AS (SELECT least(3000.0, 1000 * log10(1000 / quantile_cont(value, 0.99))) AS latency FROM events)
            SELECT CAST(round(least(6000.0, latency + 1000 * log10(n / greatest(errors, 1)) - 300 * log10(1 + errors))) AS BIGINT) AS points FROM e, p""",
        "event_ivf": f"{_event_sql()}, {_event_near(FAST, 'fast')} SELECT qid, rank, orig_id, dist FROM fast",
        "event_two_pass": f"{_event_sql()}, {_event_votes()} SELECT qid, frauds FROM votes",
        "event_pruned": f"""{_event_sql()}, {_EVENT_EXACT} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, orig_id) AS INT) AS rank, orig_id, dist FROM exact""",
        "event_capped": f"{_event_sql()}, {_event_near(FAST, 'fast')}, {_EVENT_CAPPED} SELECT qid, rank, orig_id, dist FROM capped",
        "stream_progress": "SELECT count(*) AS n_rows FROM events",
        "event_confusion": f"""{_event_sql()}, {_event_votes()}, {_EVENT_EXACT}, both_ AS (SELECT v.frauds < 3 AS got, t.frauds < 3 AS expected FROM votes v JOIN truth t USING (qid))
            SELECT count_if(NOT got AND NOT expected)::BIGINT AS tp, count_if(got AND expected)::BIGINT AS tn, count_if(NOT got AND expected)::BIGINT AS fp,
            count_if(got AND NOT expected)::BIGINT AS fn, count(*) AS n FROM both_""",
        "event_mismatches": f"""{_event_sql()}, {_event_votes()}, {_EVENT_EXACT} SELECT qid, v.frauds / 5 AS got, t.frauds / 5 AS expected
            FROM votes v JOIN truth t USING (qid) WHERE v.frauds <> t.frauds""",
        "stream_score": f"""{_event_sql(ivf.ROUNDS)}, {_event_votes(own=True)} SELECT tx.event_id AS qid, coalesce(v.frauds, 0) AS frauds, coalesce(v.frauds, 0) < 3 AS approved,
            '{{"approved":' || CASE WHEN coalesce(v.frauds, 0) < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || CAST(coalesce(v.frauds, 0) * 2 // 10 AS VARCHAR)
            || '.' || CAST(coalesce(v.frauds, 0) * 2 % 10 AS VARCHAR) || '}}' AS response FROM tx LEFT JOIN ev USING (event_id) LEFT JOIN votes v ON v.qid = ev.orig_id""",
        "bucket_layout": f"""{index}, sizes AS (SELECT c.bucket, count(a.orig_id) AS n FROM centres c LEFT JOIN assigned a USING (bucket) GROUP BY c.bucket)
            SELECT bucket, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sizes""",
        "bucket_radius": f"""{index} SELECT c.bucket, CAST(coalesce(max({_far_sql("a.codes", "a.cc")}), 0) AS BIGINT) AS radius_sq
            FROM centres c LEFT JOIN assigned a USING (bucket) GROUP BY c.bucket""",
        "label_bitmap": "SELECT vec_id // 32768 + 1 AS bucket_number, count(*) AS frauds FROM embeddings WHERE label < 4 GROUP BY 1",
        "label_bit_test": "SELECT vec_id AS orig_id, CAST(label < 4 AS INT) AS label FROM embeddings",
        "features_events": f"WITH {tx.SQL}, long AS ({dims}) SELECT event_id AS qid, dim, CAST({_code_sql('i16', 'v')} AS INT) AS code FROM long",
        "payload_parse": f"""WITH {tx.SQL} SELECT event_id AS qid, event_id % 97 <> 0 AS parsed, CASE WHEN event_id % 97 <> 0 THEN cents ELSE -1 END AS cents,
            event_id % 97 <> 0 AND last_sec IS NOT NULL AS has_last FROM tx""",
        "mcc_lookup": f"SELECT event_id, {mcc} AS mcc, CAST({risk} AS DOUBLE) AS risk FROM events",
        "unknown_merchant": f"WITH {tx.SQL} SELECT event_id AS qid, CASE WHEN known THEN 0 ELSE 1 END AS unknown FROM tx WHERE event_id % 97 <> 0",
        "confusion": f"WITH {_MATRIX} SELECT tp, tn, fp, fn, n FROM matrix",
        "failure_rate": f"WITH {_MATRIX} SELECT n, round((fp + fn) / greatest(n, 1), 9) AS failure_rate FROM matrix",
        "detection_score": f"""WITH {_MATRIX}, e AS (SELECT n, fp + 3 * fn AS errors FROM matrix)
            SELECT errors, CAST(round(1000 * log10(n / greatest(errors, 1)) - 300 * log10(1 + errors)) AS BIGINT) AS score FROM e""",
        "mismatches": f"WITH {_JUDGED} SELECT doc_id, got, expected FROM judged WHERE got IS DISTINCT FROM expected",
        "mismatch_samples": f"WITH {_JUDGED} SELECT doc_id, got, expected FROM judged WHERE got IS DISTINCT FROM expected ORDER BY doc_id LIMIT 3",
        "latency_quantiles": """SELECT round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS med,
            round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
            round(quantile_cont(value, 0.999), 6) AS p99_9, round(max(value), 6) AS max FROM events""",
        "latency_points": "SELECT CAST(round(least(3000.0, 1000 * log10(1000 / quantile_cont(value, 0.99)))) AS BIGINT) AS points FROM events",
        "event_decisions": f"""WITH {tx.SQL}, long AS ({dims}), coded AS (SELECT event_id, dim, {_code_sql('i16', 'v')} AS code FROM long),
            wide AS (SELECT event_id, {", ".join(f"max(code) FILTER (dim = {d}) AS d{d}" for d in range(14))} FROM coded GROUP BY event_id),
            refs AS (SELECT wide.*, CAST(event_type = 'error' AS INT) AS label FROM wide JOIN tx USING (event_id)),
            votes AS (SELECT q.event_id, list_sum(arg_min(r.label, ({" + ".join(f"(q.d{d} - r.d{d}) * (q.d{d} - r.d{d})" for d in range(14))}) * 100000000 + r.event_id, 5)) AS frauds
                FROM refs q JOIN refs r ON q.event_id <> r.event_id GROUP BY q.event_id)
            SELECT event_id AS qid, CAST(coalesce(frauds, 0) AS INT) AS frauds, coalesce(frauds, 0) < 3 AS approved FROM tx LEFT JOIN votes USING (event_id)""",
    }

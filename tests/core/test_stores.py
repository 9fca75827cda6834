"""Bucketed store, streams into it, files with odd names, pairs of hot keys, ranges."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators.pairs import pairs_within
from lodestone.sources import ingest
from lodestone.sources.store import Store
from lodestone.streaming import streams


def traces_of(spark, rows):
    d = spark.createDataFrame(rows, "request_id string, text string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return d.selectExpr("request_id", "struct(text, request_id, '' AS timestamp, 's' AS source) AS input", "struct(array(text) AS reasoning_steps, 0.5D AS confidence_score) AS reasoning", "NULL AS evaluation", "NULL AS tool_calls", "created_at")


def texts(d):
    return sorted((r.request_id, r.input.text) for r in d.collect())


def plan(d, mode="formatted"):
    d.collect()
    return d._jdf.queryExecution().explainString(d.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_store_reads_without_shuffle(spark, tmp_path):
    s = Store(spark, str(tmp_path / "it's a store"), buckets=8)
    assert s.last().count() == 0
    s.put(traces_of(spark, [(str(i), f"a{i}", "2024-01-01") for i in range(40)] + [(None, "none", "2024-01-01")]))
    s.put(traces_of(spark, [(str(i), f"b{i}", "2024-01-02") for i in range(0, 40, 4)] + [("1", "older", "2023-01-01"), ("2", "same", "2024-01-01")]), 1)
    want = sorted([(str(i), "same" if i == 2 else f"b{i}" if i % 4 == 0 else f"a{i}") for i in range(40)])
    assert texts(s.last().filter("request_id IS NOT NULL")) == want and texts(s.last().filter("request_id IS NULL")) == [(None, "none")]
    assert "Exchange" not in plan(s.last())
    assert texts(s.get("4")) == [("4", "b4")] and s.get("gone").count() == 0
    assert "SelectedBucketsCount: 1 out of 8" in plan(s.get("4")) and "Exchange" not in plan(s.get("4"))
    before = s.last()
    s.compact()
    assert texts(s.last().filter("request_id IS NOT NULL")) == want and s.rows().count() == 41 and before.count() == 41
    s.put(traces_of(spark, [("2", "later", "2024-01-01")]), 2)
    assert texts(s.get("2")) == [("2", "later")]
    s.clear()
    assert s.last().count() == 0 and Store(spark, s.path, 8).version() == 2


def files(spark, path, batches):
    for k, rows in enumerate(batches):
        traces_of(spark, rows).coalesce(1).write.parquet(f"{path}/{k}")
        t = 1_700_000_000 + 100 * k
        for f in os.listdir(f"{path}/{k}"):
            os.utime(f"{path}/{k}/{f}", (t, t))
    schema = spark.read.parquet(f"{path}/0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_stream_keeps_the_last(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [[("a", "a1", "2024-01-01 10:00:00"), ("b", "b1", "2024-01-01 10:00:00")], [("a", "a3", "2024-01-01 12:00:00")], [("a", "a2", "2024-01-01 11:00:00"), ("c", "c1", "2024-01-01 09:00:00")]])
    s = Store(spark, str(tmp_path / "store"), 4)
    streams.upsert(stream, s, str(tmp_path / "cp"), every=2).awaitTermination()
    assert texts(s.last()) == [("a", "a3"), ("b", "b1"), ("c", "c1")] and s.version() == 1
    streams.upsert(stream, s, str(tmp_path / "cp2"), every=2).awaitTermination()  # as if all batches had been lost
    assert texts(s.last()) == [("a", "a3"), ("b", "b1"), ("c", "c1")]


def test_stream_keeps_the_first_within_the_delay(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [[("a", "a1", "2024-01-01 10:00:00"), ("b", "b1", "2024-01-01 10:00:00")], [("a", "a2", "2024-01-01 10:30:00"), ("c", "c1", "2024-01-01 10:40:00")], [("b", "b2", "2024-01-01 10:50:00"), ("c", "c2", "2024-01-01 10:41:00")]])
    s = Store(spark, str(tmp_path / "store"), 4)
    streams.upsert(stream, s, str(tmp_path / "cp"), keep="first", delay="2 hours").awaitTermination()
    assert texts(s.rows()) == [("a", "a1"), ("b", "b1"), ("c", "c1")]
    with pytest.raises(ValueError):
        streams.upsert(stream, s, str(tmp_path / "cp3"), keep="both")


def test_names_are_taken_literally(spark, tmp_path):
    sub = tmp_path / "f{o}[1] x%20y"
    sub.mkdir()
    names = ["a[1].txt", "x{1}.txt", "s*.txt", "q?.txt", "ok.txt", "sp ace%41.txt", "b\\s.txt", "ü#é.txt"]
    for n in [*names, "other.txt"]:
        (sub / n).write_text(f"text of {n}")
    rows = [(i, str(sub / n), "text") for i, n in enumerate([*names, "gone[1].txt", names[0]])] + [(50, "/nowhere/x.txt", "text"), (51, "/now[h]ere/x.txt", "text")]
    good, bad = ingest.ingest(spark, spark.createDataFrame(rows, "pos int, path string, format string"), "c")
    assert sorted((r.doc_pos, r.content) for r in good.collect()) == [(i, f"text of {n}") for i, n in enumerate(names)] + [(9, f"text of {names[0]}")]
    assert {r.pos: r.error_type for r in bad.collect()} == {8: "FileNotFound", 50: "FileNotFound", 51: "FileNotFound"}
    p = ingest.as_packets(good.limit(1)).first()
    assert p.text == p.content and p.source == f"text:{p.content.removeprefix('text of ') and str(sub / p.content.removeprefix('text of '))}"
    assert {r.corpus_id for r in good.select("corpus_id").collect()} == {"c"}


@pytest.mark.parametrize("cell", [1024, 16])
def test_pairs_of_hot_keys(spark, cell):
    rows = [("hot", i) for i in range(150)] + [("cold", i) for i in range(5)] + [(None, 1), (None, 2), ("hot", 7), ("one", 0)]
    d = spark.createDataFrame(rows, "key string, pos long").withColumn("name", F.col("pos").cast("string"))
    got = sorted(map(tuple, pairs_within(d, "key", "pos", "name", cell=cell).collect()))
    want = sorted((k, str(a), str(b)) for i, (k, a) in enumerate(rows) for l, b in rows if k is not None and k == l and a < b)
    assert got == want


def test_a_hot_key_is_spread_over_tasks(spark):
    """With cells of 64, no task joins more than a few cells of the one key."""
    from pyspark.sql.functions import spark_partition_id

    d = spark.range(2000).selectExpr("1 AS key", "id AS pos")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        n = [r["count"] for r in pairs_within(d, "key", "pos", "pos", cell=64).groupBy(spark_partition_id()).count().collect()]
    finally:
        for k, v in (("spark.sql.adaptive.enabled", "true"), ("spark.sql.shuffle.partitions", "4"), ("spark.sql.autoBroadcastJoinThreshold", "10485760")):
            spark.conf.set(k, v)
    assert sum(n) == 2000 * 1999 // 2 and len(n) == 16 and max(n) < 3 * sum(n) / 16


def test_violations_and_fail_fast(spark):
    d = spark.createDataFrame([(1, 0.5, 0.2), (2, None, 0.2), (3, 0.5, 1.5), (4, 0.0, 1.0), (5, -0.1, 0.5)], "id long, a double, b double")
    assert sorted(r.id for r in scoring.violations(d, a=(0.0, 1.0), b=(0.0, 1.0)).collect()) == [2, 3, 5]
    raw = spark.createDataFrame([("ok", "s"), ("", "s")], "text string, source string")
    with pytest.raises(Exception, match="rejected input: Empty from s"):
        scoring.accept_all(raw).collect()
    assert scoring.accept_all(raw.limit(1)).count() == 1

"""What a task holds does not grow with the table: texts are dealt out before they become words, plug-ins get rows in short batches."""

from lodestone import queries
from lodestone.functions.plugins import Plugin
from lodestone.operators import extract
from lodestone.plans import runs


def test_words_are_dealt_out_by_characters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "CHARS_A_TASK", 500, raising=False)
    rows = [(c, t, "user", f"one two three {c} {t} " * 5) for c in range(40) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    _, e = queries.annotated_tokens(spark, str(tmp_path))
    n = sum(len(r[3]) for r in rows) // 500
    assert extract.valid_entities(e).rdd.getNumPartitions() == n > 4 * spark.sparkContext.defaultParallelism
    got = {r.start: (r.text, r.end) for r in e.filter("doc_id = '7:3'").collect()}
    text = rows[7 * 5 + 3][3]
    assert len(got) == 10 and all(text[a:b] == t for a, (t, b) in got.items())


def test_plugins_of_compare_get_short_batches(spark):
    packets = spark.range(3000).selectExpr("CAST(id AS string) AS request_id", "'a text' AS text", "TIMESTAMP '2024-01-01' AS ts").coalesce(1)
    configs = spark.createDataFrame([(0, "c", "counts", False)], "pos int, name string, reasoner string, evaluate boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = Plugin("counts", lambda: lambda texts: [{"steps": [str(len(texts))], "confidence": 0.5} for _ in texts], "struct<steps:array<string>,confidence:double>", batch=1 << 20)
    got = runs.compare(packets, configs, {"counts": counts}).selectExpr("CAST(steps[0] AS int) AS n").collect()
    assert len(got) == 3000 and max(r.n for r in got) <= 1024
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

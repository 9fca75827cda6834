"""Plug-ins: failures end in their own rows, batches in rows; scored spans, embeddings, annotations; comparison with reasoners that fail."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.functions.plugins import Plugin, call
from lodestone.operators import extract, models
from lodestone.plans import runs


def lengths():
    def run(texts):
        if any(t and "bad" in t for t in texts):
            raise ValueError("bad text")
        return [None if t is None else float(len(t)) for t in texts]

    return run


def test_only_failing_rows_have_errors(spark):
    rows = [(i, None if i == 7 else "bad" if i % 50 == 3 else "x" * i) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, text string").select("id", call(Plugin("lengths", lengths, "double", 16), "text").alias("r"))
    for r in d.collect():
        t = rows[r.id][1]
        assert (r.r.error and (r.r.error.error_type, r.r.error.message)) == (("ValueError", "bad text") if t == "bad" else None)
        assert r.r.value == (None if t in (None, "bad") else len(t))


@pytest.mark.parametrize("make, kind", [(lambda: 1 / 0, "ZeroDivisionError"), (lambda: lambda x: x[:-1], "ValueError"), (lambda: lambda x: ["no number"] * len(x), "ArrowInvalid")])
def test_models_that_cannot_be_made_or_give_something_else(spark, make, kind):
    d = spark.createDataFrame([("a",), ("b",)], "text string").select(call(Plugin("p", make, "double"), "text").alias("r"))
    assert [(r.r.value, r.r.error.error_type) for r in d.collect()] == [(None, kind)] * 2
    assert d.limit(0).count() == 0


def test_several_columns(spark):
    p = Plugin("sum", lambda: lambda rows: [a + b for a, b in rows], "long")
    d = spark.createDataFrame([(1, 2), (3, None)], "a long, b long").select(call(p, "a", F.col("b")).alias("r"))
    assert [(r.r.value, r.r.error and r.r.error.error_type) for r in d.collect()] == [(3, None), (None, "TypeError")]


def test_scored_spans(spark):
    def model():
        def run(spans):
            if "fail" in "".join(spans):
                raise RuntimeError("no")
            return [[] if s == "None." else [float(len(s)), 1.0, 20.0] for s in spans]

        return run

    d = spark.createDataFrame([(1, " Short. This one is rather a long one! None."), (2, "fail."), (3, None), (1, "Fine.")], "doc_id long, text string")
    got = sorted(models.scored_spans(d, Plugin("m", model, "array<double>"), ["a", "b", "c"]).collect(), key=lambda r: (r.doc_id, r.k, r.span_text))
    assert [(r.doc_id, r.span_text, r.start, r.end, r.role, r.error and r.error.error_type) for r in got] == [
        (1, "Fine.", 0, 5, "c", None), (1, "Short.", 1, 7, "c", None), (1, "This one is rather a long one!", 8, 38, "a", None), (1, "None.", 39, 44, "a", None), (2, "fail.", 0, 5, None, "RuntimeError"),
    ]
    assert got[2].confidence == pytest.approx(1 / (1 + math.exp(-29) + math.exp(-10))) and got[3].confidence == 0
    assert got[0].provenance.model == "m" and got[0].provenance.role_vocab == ["a", "b", "c"] and got[4].error.module == "roles"


def test_embeddings_and_annotations(spark):
    e = models.embedded(spark.createDataFrame([("a",), (None,)], "text string"), Plugin("e", lambda: lambda x: [[float(len(t))] for t in x], "array<double>"))
    assert sorted(((r.text, r.embedding, r.error and r.error.error_type) for r in e.collect()), key=str) == [("a", [1.0], None), (None, None, "TypeError")]

    def annotator():
        def one(text):
            words, at = text.split(" "), 0
            out = []
            for i, w in enumerate(words):
                dep = {0: "nsubj", 1: "ROOT", 2: "dobj"}[i]
                out.append({"text": w, "lemma": w.rstrip("s"), "pos": "VERB" if i == 1 else "NOUN", "dep": dep, "head": 1, "idx": at})
                at += len(w) + 1
            return out

        return lambda texts: [one(t) for t in texts]

    d = spark.createDataFrame([(1, "heat causes waves"), (2, "far too many words")], "doc_id long, text string")
    tokens, failed = models.annotated(d, Plugin("n", annotator, models.TOKENS))
    entities = spark.createDataFrame([(1, 0, "heat", 0, 4), (1, 1, "waves", 12, 17)], "doc_id long, ord int, text string, start int, end int")
    assert [(r.subject, r.relation_type, r.object) for r in extract.relations(tokens, entities).collect()] == [("heat", "CAUSES", "waves")]
    assert [(r.doc_id, r.error.error_type, r.error.module) for r in failed.collect()] == [(2, "KeyError", "relations")]


def test_reasoners_that_fail_at_run_time(spark):
    raw = spark.createDataFrame([(str(i), "one two" if i % 3 else "stop here", "s") for i in range(12)], "request_id string, text string, source string")
    p = scoring.accepted(scoring.accept(raw)).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))

    def model():
        def run(texts):
            if any("stop" in t for t in texts):
                raise ValueError("stopped")
            return [{"steps": ["a", "b"], "confidence": 0.5} for _ in texts]

        return run

    ways = {
        "default": scoring.reason, "plugin": Plugin("r", model, "struct<steps:array<string>,confidence:double>", 4),
        "raises": lambda d: scoring.reason(d).withColumn("confidence", F.when(F.col("text").contains("stop"), F.raise_error(F.lit("broken"))).otherwise(F.col("confidence"))),
    }
    configs = spark.createDataFrame([(0, "ok", "default", True, [("echo", "x")]), (1, "rows", "plugin", True, [("echo", "x")]), (2, "all", "raises", False, None), (3, "none", "unknown", False, None)], "pos int, name string, reasoner string, evaluate boolean, calls array<struct<name:string,input:string>>")
    got = runs.compare(p, configs, ways).collect()
    by = {c: sorted((r for r in got if r.config == c), key=lambda r: int(r.request_id)) for c in ("ok", "rows", "all", "none")}
    assert all(len(v) == 12 for v in by.values())
    assert all(r.error is None and r.overall_score is not None and r.tool_calls for r in by["ok"])
    for r in by["rows"]:
        failed = int(r.request_id) % 3 == 0
        assert (r.error and r.error.message) == ("stopped" if failed else None) and (r.steps is None, r.overall_score is None, r.tool_calls is None) == (failed,) * 3
    assert all(r.error and r.steps is None for r in by["all"]) and {r.error.error_type for r in by["none"]} == {"LookupError"}

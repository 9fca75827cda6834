"""Accepting texts and scoring them: native column expressions over packets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clamp, iso, normalise, split_words, strip, tokens

MAX_LENGTH = 10_000
SCORES = ("step_count_score", "coherence_score", "confidence_alignment_score", "input_coverage_score", "overall_score")

#: User functions on a text column by name; the last registration wins.
TOOLS: dict[str, Callable[[Column], Column]] = {
    "echo": lambda c: c,
    "word_count": lambda c: F.size(split_words(c)).cast("string"),
}


def register_tool(name: str, tool: Callable[[Column], Column]) -> None:
    TOOLS[name] = tool


def tool_names() -> list[str]:
    return sorted(TOOLS)


def normalised(raw: DataFrame) -> DataFrame:
    """raw with its texts as accept() makes them, unjudged: blank ones are empty, null ones stay null."""
    return raw.withColumn("text", normalise(F.col("text")))


def accept(raw: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """raw (text, source, ...) normalised, with error_code (null if accepted), actual_length and max_length.

    Null texts and sources are blank; repeated rows are judged one by one; further columns are kept.
    """
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    # the number of the task keeps Spark from copying the normalised text into each filter on error_code
    d = raw.withColumns({"text": normalise(F.coalesce("text", F.lit(""))), "source": strip(F.coalesce("source", F.lit(""))), "_n": F.spark_partition_id()})
    n = F.length("text")
    code = F.when(F.col("_n") < 0, "").when(F.col("source") == "", "MissingSource").when(F.col("text") == "", "Empty").when(n > max_length, "MaxLength")
    long = F.col("error_code") == "MaxLength"
    return d.withColumn("error_code", code).withColumns({"actual_length": F.when(long, n), "max_length": F.when(long, F.lit(max_length))}).drop("_n")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("error_code IS NULL").drop("error_code", "actual_length", "max_length")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter("error_code IS NOT NULL")


def accept_all(raw: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Accepted packets; any rejected row stops the job."""
    j = accept(raw, max_length)
    stop = F.when(F.col("error_code").isNotNull(), F.raise_error(F.concat(F.lit("rejected input: "), "error_code", F.lit(" from "), "source"))).otherwise(F.col("text"))
    return j.withColumn("text", stop).drop("error_code", "actual_length", "max_length")


def reason(packets: DataFrame) -> DataFrame:
    """packets (request_id, text, ts) with steps and confidence."""
    n, w = F.length("text"), F.size(split_words(F.col("text")))
    # The texts of the steps, whose words count in the coverage score.
    kind = (
        F.when(F.col("text") == "", "Step 4: Input is empty, minimal processing required")
        .when(w == 1, "Step 4: Single-word input detected, likely a simple command or query")
        .when(w <= 5, "Step 5: Short input detected, processing as concise request")
        .otherwise("Step 5: Multi-word input detected, processing as detailed request")
    )
    steps = F.array(
        F.concat(F.lit("Step 1: Received input with request ID "), "request_id"),
        F.concat(F.lit("Step 2: Input contains "), n.cast("string"), F.lit(" characters and "), w.cast("string"), F.lit(" words")),
        F.concat(F.lit("Step 3: Input timestamp is "), iso(F.col("ts"))),
        kind,
    )
    ladder = F.when(n == 0, 0.2).when(n <= 5, 0.5).when(n <= 20, 0.65).when(n <= 100, 0.8).otherwise(0.9)
    return packets.withColumns({"steps": steps, "confidence": ladder})


def evaluate(results: DataFrame) -> DataFrame:
    """results (text, steps, confidence) with the five scores.

    A null text has no words, and so is covered; null steps count as none.
    """
    n = F.size("steps")
    count = F.when(n == 0, 0.0).otherwise(clamp(1 - F.abs(n - 4.0) / 4.0))
    coherence = F.when(n == 0, 0.0).otherwise(F.size(F.filter("steps", lambda s: strip(s) != "")) / n)
    alignment = clamp(1 - F.abs(F.col("confidence") - F.least(F.lit(1.0), F.length("text") / 120.0)))
    # as in accept(): a filter on a score must not split the text anew for each word
    d = results.withColumns({"_words": tokens(F.col("text")), "_known": F.array_distinct(tokens(F.array_join("steps", "\n"))), "_n": F.spark_partition_id()})
    covered = F.size(F.filter("_words", lambda x: F.array_contains(F.col("_known"), x)))
    coverage = F.when((F.size("_words") == 0) | (F.col("_n") < 0), 1.0).otherwise(covered / F.size("_words"))
    d = d.withColumns({"step_count_score": count, "coherence_score": coherence, "confidence_alignment_score": alignment, "input_coverage_score": coverage})
    total = F.col(SCORES[0]) + F.col(SCORES[1]) + F.col(SCORES[2]) + F.col(SCORES[3])
    return d.withColumn("overall_score", total / 4).drop("_words", "_known", "_n")


def conclusion(steps: Column) -> Column:
    return F.coalesce(F.try_element_at(steps, F.lit(-1)), F.lit("No reasoning steps"))


def violations(d: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Rows whose named columns leave their ranges or are null."""
    bad = F.lit(False)
    for c, (low, high) in ranges.items():
        bad = bad | F.col(c).isNull() | ~F.col(c).between(low, high)
    return d.filter(bad)

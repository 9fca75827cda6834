"""Quality rules: a table of thresholds compiled into one projection.

measures() turns each whole text into counts with array functions in the row itself, so no row
moves. compile_rules() turns a table of (name, numerator, denominator, least, most) into one
boolean column. No user functions.

Defined results: a null or empty text has no words, all counts 0, and fails the length rule. A
ratio whose denominator is 0 passes (its length rule decides). Rows with a null or repeated id are
judged one by one like any other. Further columns of the input are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, trimmed, words


class Rule(NamedTuple):
    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


#: Symbols that markup, tables and broken text are full of.
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is was that for it with as on be at by this from are or an have not they which "
    "le la les de des et un une que qui dans en est pour par sur avec au du ce il "
    "der die das und ist von den mit zu dem ein eine nicht auf im für sich als auch "
    "el los las y se del con no por su al lo como más"
).split()

#: The languages of these words: in keep_good a text that is said to be of another one is not asked for them.
LANGUAGES = ("en", "fr", "de", "es")

#: Base rules: their failure alone rejects. Multiplied out, so that no division rounds.
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: The method's table: what a text must keep to, besides the base rules.
RULES = (
    Rule("length", "n_words", None, 50, None),
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("shouts", "n_shouts", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)

#: Bits of a packed value that hold a word position; a string of 2 GB has fewer than 2^30 words.
POSITION_BITS = 30


def _window(w: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(width)])


def _repeated(w: Column, packed: Column, width: int) -> Column:
    """Words covered by windows that occur twice or more.

    packed is sorted and holds a part of each window's hash above its position. Neighbours that
    agree in that part are candidates; they are sorted again by whole hash, which decides.
    """
    mask = F.lit((1 << POSITION_BITS) - 1).cast("long")
    near = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), POSITION_BITS) == 0
    likely = F.filter(packed, lambda x, j: near(x, F.get(packed, j + 1)) | near(x, F.get(packed, j - 1)))
    pairs = F.sort_array(F.transform(F.transform(likely, lambda x: x.bitwiseAND(mask).cast("int")), lambda at: F.struct(_window(w, at, width).alias("h"), at.alias("at"))))
    same = lambda p: F.filter(p, lambda x, j: (x.h == F.get(p, j - 1).h) | (x.h == F.get(p, j + 1).h))
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    starts = let(pairs, lambda p: F.sort_array(F.transform(same(p), lambda x: x["at"])))
    covered = lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(s, j + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return let(starts, covered)


def _stop_pattern() -> str:
    """The stop words as one pattern, alternatives grouped by first letter."""
    first = sorted({x[0] for x in STOP_WORDS})
    ways = "|".join(c + "(?:" + "|".join(sorted((x[1:] for x in STOP_WORDS if x[0] == c), key=len, reverse=True)) + ")" for c in first)
    return rf"(?<![^\x20\x09-\x0D])(?:{ways})(?![^\x20\x09-\x0D])"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None, width: int = 3) -> DataFrame:
    """One row per row of docs: id_col, what carry names, and the counts that rules refer to. One narrow stage."""
    kept = [F.col(id_col).alias("doc_id"), *(carry or [])]
    names = ["doc_id", *docs.select(*(carry or [])).columns] if carry else ["doc_id"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a = docs.select(*kept, text.alias("_text"), trimmed(text).alias("_trim"))
    b = a.select(*names, "_text", words(F.col("_trim")).alias("_w"), F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"))
    w, lines = F.col("_w"), F.col("_lines")
    high = F.lit(-1 << POSITION_BITS).cast("long")
    packed = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: _window(w, i, width).bitwiseAND(high).bitwiseOR(i.cast("long")))
    c = b.select(
        *names, "_w",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.regexp_count(F.lower("_text"), F.lit(_stop_pattern())).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) < width, F.array().cast("array<bigint>")).otherwise(F.sort_array(packed)).alias("_packed"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_lines", "n_dup_lines"]
    return c.select(*names, *counts, _repeated(w, F.col("_packed"), width).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def compile_rules(rules=RULES, spared: dict[str, Column] | None = None) -> Column:
    """One boolean column: every rule of the table holds. Ratios are compared multiplied out. spared: conditions under which the rules of these names are not asked."""
    verdict = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double") if r.denominator else F.lit(1.0)
        holds = F.lit(True)
        if r.least is not None:
            holds = holds & (top >= r.least * bottom)
        if r.most is not None:
            holds = holds & (top <= r.most * bottom)
        verdict = verdict & (spared[r.name] | holds if spared and r.name in spared else holds)
    return verdict


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per row of docs: the counts, base_failed and kept."""
    # the row number keeps Spark from copying the measures into a later filter once for each use
    m = measures(docs, id_col, text_col).withColumn("_n", F.monotonically_increasing_id())
    m = m.withColumn("base_failed", base_failed() & (F.col("_n") >= 0))
    return m.withColumn("kept", ~F.col("base_failed") & compile_rules(rules)).drop("_n")


def other_language(lang: Column) -> Column:
    """Whether a language is given, as a tag like pt or pt-BR, and none of LANGUAGES; never null."""
    first = F.regexp_extract(F.lower(lang.cast("string")), r"^\s*([a-z]+)", 1)
    return F.coalesce((first != "") & (first != "und") & ~first.isin(*LANGUAGES), F.lit(False))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with their columns, that pass all rules. Where lang_col says another language than those of the stop words, the rule on these is not asked."""
    spared = {"stop_words": other_language(F.col(f"_row.`{lang_col}`"))} if lang_col in docs.columns else None
    m = measures(docs, id_col, text_col, carry=[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")])
    # the row number keeps Spark from copying the measures into the filter once for each use
    return m.withColumn("_n", F.monotonically_increasing_id()).filter(~base_failed() & compile_rules(rules, spared) & (F.col("_n") >= 0)).select("_row.*")

"""Secret scans: candidates by pattern, weighed by corpus-wide ownership frequency.

Each candidate's value is hashed; hashes are counted by distinct repositories and owners. A value
that more than max_owners owners have, or more than max_repositories repositories, is a widely copied
example; the others look live. Base kinds
(assign, access, hex) are always reported; opaque tokens (mixed letters and digits, standing for no
base kind) are reported where ownership says that they look live.

Positions come from the pieces between matches: a match starts after the pieces and matches before
it. Only array and string functions, in code points.

Defined results: null text is empty and has no spans; null owners or repositories count as one
owner or repository; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# The kinds in their order, their patterns and the least lengths of what they catch.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}+", 24),
)
OPAQUE = ("opaque", r"[A-Za-z0-9+/_=-]{20,}+", 20)

#: A value that more distinct owners have, or more distinct repositories, is an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4

CANDIDATE = "array<struct<start:int,`end`:int,rank:int,kind:string,value:string>>"


def _found(text: Column, kind: str, pattern: str, least: int, rank: int) -> Column:
    """All matches of one kind with their places, leftmost first; failing ones dropped after matching."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,`end`:int,hit:string>>").alias("out"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit")))).alias("out"))

    # the last piece has no match after it; zipping leaves a null there, which is cut off
    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    places = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    value = (lambda x: F.regexp_extract(x["hit"], pattern, 2)) if kind == "assign" else (lambda x: x["hit"])
    good = F.filter(places, lambda x: F.length(value(x)) >= least)
    rows = F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.sha2(value(x), 256).alias("value")))
    return F.when(text.rlike(pattern), rows.cast(CANDIDATE)).otherwise(F.array().cast(CANDIDATE))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidates(docs: DataFrame, text_col="text", owner_col="source", repository_cols=("source", "lang"), carry=()) -> DataFrame:
    """One row per row of docs: row (a number), what carry names, owner, repository, base and more (arrays of candidates in order)."""
    repository = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repository_cols]) if repository_cols else F.lit("")
    names = docs.select(*carry).columns
    d = docs.select(*carry, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("_owner"), repository.alias("_repository"))
    each = [_found(F.col("_text"), kind, pattern, least, k).alias(f"_{kind}") for k, (kind, pattern, least) in enumerate(KINDS)]
    mixed = F.filter(_found(F.col("_text"), *OPAQUE, len(KINDS)), lambda x: F.substring(F.col("_text"), x["start"] + 1, x["end"] - x["start"]).rlike(r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"))
    d = d.select(*names, "_owner", "_repository", *each, mixed.alias("_opaque"))
    base = F.array_sort(F.concat(*[F.col(f"_{kind}") for kind, _, _ in KINDS]))
    d = d.select(*names, "_owner", "_repository", *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind, _, _ in KINDS], base.alias("_base"), "_opaque")
    free = F.filter("_opaque", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return d.withColumn("_opaque", free).withColumn("_n", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repositories, n_owners) over the whole corpus; distinct triples are combined before they move."""
    one = found.select("_owner", "_repository", F.explode(F.concat("_base", "_opaque")).alias("c")).select("_owner", "_repository", F.col("c.value").alias("value")).distinct()
    per_owner = one.groupBy("value", "_owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, text_col="text", owner_col="source", repository_cols=("source", "lang"), carry=(), max_owners=MAX_OWNERS, max_repositories=MAX_REPOSITORIES) -> DataFrame:
    """One row per row of docs: what carry names, n_assign, n_access, n_hex, base_sha256, spans, owners and repositories (how many have each span's value), n_live, n_example, and _spans."""
    names = docs.select(*carry).columns
    found = staged(candidates(docs, text_col, owner_col, repository_cols, carry), "secrets")
    known = staged(ownership(found), "owners")  # so that the join may split a value with many copies over tasks
    counts = [f"n_{kind}" for kind, _, _ in KINDS]
    none = F.size("_base") + F.size("_opaque") == 0
    nothing = F.array().cast("array<struct<start:int,`end`:int,rank:int,kind:string,live:boolean,owners:bigint,repositories:bigint>>")
    plain = found.filter(none).select(*names, *counts, F.col("_base"), nothing.alias("_judged"))
    some = found.filter(~none)
    each = some.select("_n", F.explode(F.concat("_base", "_opaque")).alias("c")).select("_n", "c.*")
    judged = each.join(known.withColumnRenamed("value", "_value"), each["value"] == F.col("_value"), "left")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = judged.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rank", "kind", live.alias("live"), F.col("n_owners").alias("owners"), F.col("n_repositories").alias("repositories")))).alias("_judged"))
    dealt = some.join(judged.withColumnRenamed("_n", "_m"), F.col("_n") == F.col("_m"), "left").select(*names, *counts, "_base", "_judged")
    out = plain.unionByName(dealt)
    spans = F.filter("_judged", lambda x: (x["rank"] < len(KINDS)) | x["live"])
    out = out.withColumn("_spans", spans)
    n_live = lambda yes: F.size(F.filter("_spans", lambda x: x["live"] == yes)).cast("long")
    line = lambda name: F.array_join(F.transform("_spans", lambda x: x[name].cast("string")), ",")
    return out.select(*names, *counts, F.sha2(_line(F.col("_base")), 256).alias("base_sha256"), _line(F.col("_spans")).alias("spans"), line("owners").alias("owners"), line("repositories").alias("repositories"), n_live(True).alias("n_live"), n_live(False).alias("n_example"), "_spans")


def redact(docs: DataFrame, text_col="text", owner_col="source", repository_cols=("source", "lang"), mark="<secret>") -> DataFrame:
    """docs with each reported span's text replaced by mark; overlapping spans are one."""
    s = scan(docs, text_col, owner_col, repository_cols, carry=(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),))
    text = F.col(f"_row.`{text_col}`")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.when(x["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.size("_spans") == 0, text).otherwise(clean)
    return s.select(*[(new if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])

"""Extraction over annotated tables: role spans, role scores, relations, JSON inputs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, WS_CHARS, clamp, sentences, strip

# Roles that name concepts, and verbs by relation.
CONCEPT_ROLES = ("method", "result", "finding", "objective", "conclusion")
VERBS = {
    "CAUSES": ("cause", "trigger", "induce", "lead", "produce", "generate"),
    "PART_OF": ("contain", "include", "comprise", "consist"),
    "USES": ("use", "utilize", "employ", "apply"),
    "DEPENDS_ON": ("require", "need", "depend", "rely"),
    "CONTRADICTS": ("contradict", "oppose", "conflict", "disagree"),
}


def sentence_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k, span_text, start, end): sentences with their places in the text as given, in code points.

    Places are summed up in the row, so repeated ids are texts of their own and nothing moves. Null and
    blank texts have no sentences.
    """
    text = F.col(text_col)
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(WS_CHARS)))
    d = docs.select(F.col(id_col).alias("doc_id"), lead.alias("lead"), sentences(text).alias("s"), F.regexp_extract_all(strip(text), F.lit(rf"(?<=[.!?]){WS}+"), F.lit(0)).alias("gap"))
    steps = F.zip_with("s", "gap", lambda s, g: F.length(s) + F.coalesce(F.length(g), F.lit(0)))
    starts = F.aggregate(steps, F.array("lead"), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    d = d.select("doc_id", F.posexplode(F.arrays_zip(F.col("s").alias("s"), starts.alias("start"))).alias("k", "p")).filter("p.s IS NOT NULL")
    return d.select("doc_id", "k", F.col("p.s").alias("span_text"), F.col("p.start").alias("start"), (F.col("p.start") + F.length("p.s")).alias("end"))


def role_scores(logits: Column, roles: list[str]) -> Column:
    """struct(role, confidence): softmax over the roles' logits and its first greatest; no logits: the first role, 0."""
    n = len(roles)
    names = F.array(*[F.lit(r) for r in roles])
    x = F.slice(logits, 1, n)
    exps = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double")))
    total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    at = F.array_position(x, F.array_max(x)).cast("int")
    empty = F.coalesce(F.size(x), F.lit(0)) <= 0
    return F.when(empty, F.struct(F.lit(roles[0]).alias("role"), F.lit(0.0).alias("confidence"))).otherwise(F.struct(F.element_at(names, at).alias("role"), (F.element_at(exps, at) / total).alias("confidence")))


def concept_spans(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("role").isin(*CONCEPT_ROLES) & (F.col("confidence") > 0.3))


def valid_entities(entities: DataFrame) -> DataFrame:
    """entities (doc_id, ord, text, start, end): empty or negative spans fall out; equal spans keep the first place and the last value."""
    e = entities.filter("start >= 0 AND `end` > start")
    return e.groupBy("doc_id", "start", "end").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text"))


def overlapping_entity(tokens: DataFrame, entities: DataFrame, bucket: int = 256) -> DataFrame:
    """tokens (doc_id, i, idx, len) to (doc_id, i, e): the first entity that overlaps each; joined by place bucket, then by range."""
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor((b - 1) / bucket)))
    t = tokens.filter("len > 0").select("doc_id", "i", "idx", (F.col("idx") + F.col("len")).alias("stop"), buckets(F.col("idx"), F.col("idx") + F.col("len")).alias("b"))
    e = entities.select(F.col("doc_id").alias("d"), F.col("ord"), F.col("text").alias("e_text"), F.col("start").alias("e_start"), F.col("end").alias("e_end"), buckets(F.col("start"), F.col("end")).alias("eb"))
    j = t.join(e, (F.col("doc_id") == F.col("d")) & (F.col("b") == F.col("eb")) & (F.col("idx") < F.col("e_end")) & (F.col("stop") > F.col("e_start")))
    return j.groupBy("doc_id", "i").agg(F.min_by(F.struct(F.col("e_text").alias("text"), F.col("e_start").alias("start"), F.col("e_end").alias("end")), "ord").alias("e"))


def relation_type(lemma: Column) -> Column:
    out = None
    for kind, verbs in VERBS.items():
        out = F.when(lemma.isin(*verbs), kind) if out is None else out.when(lemma.isin(*verbs), kind)
    return out.otherwise("RELATED_TO")


def relations(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """tokens (doc_id, i, text, lemma, pos, dep, head, idx) and entities to subject, predicate, object rows.

    Confidence is 0.7, 0.15 more where the verb hangs on a token tagged ROOT, 0.1 more where it has over
    two children. Sides without an entity give no row; tokens of a null head hang on nothing.
    """
    t = tokens.withColumn("len", F.length("text"))
    e = overlapping_entity(t.filter(F.col("dep").isin("nsubj", "nsubjpass", "dobj", "pobj", "attr")).select("doc_id", "i", "idx", "len"), valid_entities(entities))
    child = t.filter("head <> i")
    n = child.groupBy("doc_id", "head").agg(F.count("*").alias("n"))
    roots = t.filter("pos = 'ROOT'").select("doc_id", F.col("i").alias("v_head"), F.lit(True).alias("under_root")).distinct()
    verbs = t.filter("pos = 'VERB'").select("doc_id", F.col("i").alias("head"), "lemma", F.col("dep").alias("v_dep"), F.col("head").alias("v_head")).join(roots, ["doc_id", "v_head"], "left")
    part = lambda deps, name: child.filter(F.col("dep").isin(*deps)).join(e, ["doc_id", "i"]).select("doc_id", "head", F.col("i").alias(f"{name}_i"), F.col("dep").alias(f"{name}_dep"), F.col("e").alias(name))
    j = verbs.join(part(("nsubj", "nsubjpass"), "s"), ["doc_id", "head"]).join(part(("dobj", "pobj", "attr"), "o"), ["doc_id", "head"]).join(n, ["doc_id", "head"], "left")
    base = F.when(F.col("under_root"), 0.85).otherwise(0.7)
    confidence = F.least(F.lit(1.0), base + F.when(F.coalesce("n", F.lit(0)) > 2, 0.1).otherwise(0.0))
    return j.select(
        "doc_id", F.col("head").alias("verb_i"), relation_type(F.col("lemma")).alias("relation_type"), F.col("s.text").alias("subject"), F.col("s.start").alias("subject_start"), F.col("s.end").alias("subject_end"),
        F.col("o.text").alias("object"), F.col("o.start").alias("object_start"), F.col("o.end").alias("object_end"), F.col("lemma").alias("predicate"), confidence.alias("confidence"), F.concat_ws("-", "s_dep", "v_dep", "o_dep").alias("pattern"),
    )


def error_record(kind: Column, message: Column, module: str, model: str | None = None) -> Column:
    """What a failed extraction leaves: struct(error, error_type, module, model), null where kind is null."""
    return F.when(kind.isNotNull(), F.struct(message.alias("error"), kind.alias("error_type"), F.lit(module).alias("module"), F.lit(model).cast("string").alias("model")))


def parse_items(raw: DataFrame, col: str = "value", module: str = "items", model: str | None = None) -> DataFrame:
    """JSON lists of {id, text} to rows (id, text, error); what is no list is a row with an error record; a blank or null input gives no row."""
    raw = raw.filter(strip(F.coalesce(col, F.lit(""))) != "")
    v = F.try_parse_json(F.col(col))
    d = raw.withColumn("_list", F.from_json(col, "array<struct<id:string,text:string>>")).withColumn("_ok", F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)))
    record = error_record(F.when(~F.col("_ok"), F.when(v.isNull(), "InvalidJson").otherwise("InputNotAList")), F.lit("the input is no JSON list"), module, model)
    d = d.withColumn("error", record)
    good = d.filter("_ok").select(F.explode("_list").alias("x"), "error").select(strip(F.col("x.id")).alias("id"), strip(F.col("x.text")).alias("text"), "error").filter("id <> '' AND text <> ''")
    return good.unionByName(d.filter("NOT _ok").select(F.lit(None).cast("string").alias("id"), F.col(col).alias("text"), "error"))


def parse_relation_input(raw: DataFrame, col: str = "value", module: str = "relations", model: str | None = None) -> DataFrame:
    """JSON objects {text, entities[]} to (text, entities, error), error a record or null; a blank or null input gives no row."""
    raw = raw.filter(strip(F.coalesce(col, F.lit(""))) != "")
    v = F.try_parse_json(F.col(col))
    kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
    entities = F.try_variant_get(v, "$.entities", "variant")
    d = raw.select(F.from_json(col, "text string, entities array<struct<text:string,start:int,`end`:int,type:string>>").alias("x"), kind.alias("kind"), F.coalesce(F.schema_of_variant(entities), F.lit("")).alias("ekind"))
    error = F.when(F.col("kind") == "", "InvalidJson").when(~F.col("kind").startswith("OBJECT"), "InputNotAnObject").when(F.col("x.text").isNull(), "MissingText").when(~F.col("ekind").startswith("ARRAY"), "EntitiesNotAList")
    return d.select("x.text", "x.entities", error_record(error, F.lit("the input is no object with text and a list of entities"), module, model).alias("error"))


def export(candidates: DataFrame, *clamped: str) -> DataFrame:
    """Rows as JSON, keys in order, the named scores in [0, 1]."""
    d = candidates.withColumns({c: clamp(F.col(c)) for c in clamped}) if clamped else candidates
    return d.select(F.to_json(F.struct(*sorted(d.columns))).alias("value"))


def distinct_terms(terms: DataFrame, limit: int | None = None) -> DataFrame:
    """terms (term) to (id, term): distinct, in order, numbered term_0, ...; the first limit of them, if given.

    Numbers come from range partitions and their sizes, so that all terms of a corpus have theirs
    without one task for all. Nulls fall out.
    """
    from .links import dense_positions

    d = dense_positions(terms.select("term").filter("term IS NOT NULL").distinct(), "term")
    d = d.filter(F.col("doc_pos") < limit) if limit is not None else d
    return d.select("term", F.concat(F.lit("term_"), F.col("doc_pos").cast("string")).alias("id"))

"""SimHash near-dedup by tiled exact comparison.

Fingerprints are 64 majority bits over XXH64 values of word shingles. Different fingerprints are
dealt into tiles of like size by population count, since two that differ in r bits have counts at most
r apart: only tiles whose counts are that near are compared, each pair of tiles as one numpy exclusive-or
with bit counts. A tile is one row, so that pairs of tiles are rows, not copies of fingerprints. A pair of tiles reports a spanning forest of its links, so that a group of copies
costs one link a member; components are then joined by star contraction in Spark.

Defined results: null or empty text has fingerprint 0, linked like any other; rows with null ids
count for links but give no component id (null if a whole component has none); repeated rows share
their component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

WIDTH, RADIUS = 4, 4
#: Fingerprints in a tile, which is one row of 128 KB; a pair of tiles is work of 2^28 comparisons. Most tasks that pairs are dealt to.
TILE, TASKS = 1 << 14, 4096
#: Links, two numbers each, beyond which a round deals them out anew, about as many to a task.
AT_ONCE = 1 << 18


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Small helper for one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    ends = ends.tolist()
    w = min(width, len(words))
    of = xxhash.xxh64_intdigest
    h = np.array([of(line[a : b - 1], 42) for a, b in zip(starts, ends[w - 1 :], strict=False)], "<u8")
    ones = np.zeros(64, "i8")
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH, carry=()) -> DataFrame:
    """One row per row of docs: doc_id, fp (the bits as a long), and what carry names."""
    d = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).cast("string").alias("_text"))
    out = d.drop("_text").schema.add("fp", "long")

    def each(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), width) for x in b.column("_text")], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "_text"), pa.array(fp, pa.int64())], [*(c for c in b.schema.names if c != "_text"), "fp"])

    return d.mapInArrow(each, out)


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a with b (of a with itself for None) as a spanning forest: values and their roots."""
    values = a if b is None else np.concatenate([a, b])
    label = np.arange(len(values))
    step = max(1, (1 << 19) // max(1, len(a if b is None else b)))
    for k in range(0, len(a), step):
        other, shift = (a[k:], k) if b is None else (b, len(a))
        near = np.bitwise_count(a[k : k + step, None] ^ other[None, :]) <= radius
        rows, cols = np.nonzero(near)
        cut = np.searchsorted(rows, np.arange(len(near) + 1))
        for i in np.unique(rows):
            mine = cols[cut[i] : cut[i + 1]] + shift
            roots = np.unique(np.append(label[mine], label[k + i]))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    moved = np.nonzero(label != np.arange(len(values)))[0]
    return values[moved], values[label[moved]]


def links(nodes: DataFrame, radius=RADIUS, tile=TILE) -> DataFrame:
    """(u, v) links between the different fingerprints of nodes (fp) that connect all within radius."""
    n = {r["ones"]: r["n"] for r in nodes.groupBy(F.bit_count("fp").alias("ones")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    shelves: list[list[int]] = []  # counts that share tiles: lowest, highest, number of fingerprints
    for k in range(65):
        if shelves and shelves[-1][2] + n.get(k, 0) <= tile:
            shelves[-1][1:] = [k, shelves[-1][2] + n.get(k, 0)]
        else:
            shelves.append([k, k, n.get(k, 0)])
    parts = [max(1, -(-total // tile)) for _, _, total in shelves]
    first = np.cumsum([0, *parts]).tolist()
    of = [next(g for g, (_, high, _) in enumerate(shelves) if k <= high) for k in range(65)]
    at = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("ones"))
    d = nodes.select("fp", F.bit_count("fp").alias("ones"))
    d = d.select("fp", "ones", (at([first[g] for g in of]) + F.pmod(F.xxhash64("fp"), at([parts[g] for g in of])).cast("int")).alias("tile"))
    high = [first[of[min(64, shelves[g][1] + radius)] + 1] - 1 for g in of]
    # a tile is one row, which meets those of the tiles above it whose counts are near
    tiles = staged(d.select("fp", "tile", at(high).alias("high")).groupBy("tile").agg(F.collect_list("fp").alias("fps"), F.first("high").alias("high")), "tiles")
    pairs = tiles.select(F.col("tile").alias("a"), F.col("fps").alias("left"), F.explode(F.sequence("tile", "high")).alias("b"))
    pairs = pairs.join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("right")), "b")
    n_pairs = sum(high[k] - t + 1 for k in {s[0] for s in shelves} for t in range(first[of[k]], first[of[k] + 1]))

    def compare(batches):
        for batch in batches:
            for k in range(len(batch)):
                a, left, b, right = (batch.column(c)[k] for c in ("a", "left", "b", "right"))
                fps = [x.values.to_numpy().view("u8") for x in (left, right)]
                u, v = _forest(fps[0], None if a.as_py() == b.as_py() else fps[1], radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], ["u", "v"])

    return pairs.select("a", "left", "b", "right").repartition(max(1, min(TASKS, n_pairs)), "a", "b").mapInArrow(compare, "u long, v long")


def _met(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with m of least (u, m). Both are dealt out anew, not as least was summed up: so Spark may split a node of many links over tasks."""
    key = F.col("u").bitwiseXOR(F.lit(1))
    return links.withColumn("_k", key).join(least.select(key.alias("_l"), "m"), F.col("_k") == F.col("_l")).drop("_k", "_l")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root), the least node reachable, by alternating star contraction; roots and nodes without links are absent.

    Every link goes through the rounds, however few there are; many are dealt out to tasks of about AT_ONCE.
    """
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    seen = e.select(mark.alias("m")).first()
    while seen["m"][0]:
        if seen["m"][0] > AT_ONCE:
            e = e.repartition(min(TASKS, seen["m"][0] // max(1, AT_ONCE) + 1), "u", "v")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _met(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _met(large, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        if (now := e.select(mark.alias("m")).first()) == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(found: DataFrame, radius=RADIUS) -> DataFrame:
    """Fingerprinted rows (doc_id, fp) to one row per different fingerprint: fp, root, component_id."""
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(links(nodes, radius))
    n = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    ids = staged(n.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    return n.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH, radius=RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id."""
    found = staged(fingerprints(docs, id_col, text_col, width), "simhash")
    g = grouped(found, radius).select(F.col("fp").alias("_fp"), "component_id")
    return found.join(g, F.col("fp") == F.col("_fp"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH, radius=RADIUS) -> DataFrame:
    """The rows of docs, with their columns: of each component the one with the least id (nulls last)."""
    rows = docs.select(F.monotonically_increasing_id().alias("_n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.select("_n", "_row", F.col(f"_row.`{id_col}`").alias("doc_id"), F.col(f"_row.`{text_col}`").alias("text"))
    found = staged(fingerprints(rows, "doc_id", "text", width, carry=("_n", "_row")), "simhash")
    of = grouped(found, radius).select(F.col("fp").alias("_fp"), "root")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_n")
    per_print = found.groupBy("fp").agg(F.min(order).alias("first"))
    kept = per_print.join(of, F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._n").alias("_m"))
    return found.join(kept, F.col("_n") == F.col("_m"), "left_semi").select("_row.*")

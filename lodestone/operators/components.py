"""Connected components and minimum spanning forests of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import kept

#: Edges that one task may finish by itself, a few MB. More are worked off in rounds of joins; the result is the same.
AT_ONCE = 1 << 18


def _root(parent: dict, x):
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[p] if p in parent else p
    return x


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """edges (u, v) to (id, label): every end of an edge, labelled by the least id that it is joined with.

    Up to at_once edges are joined in one task. Beyond, each round gives a node the least label of its
    neighbours and then its label's own label, so that the rounds are few; the edges between labels that
    are left shrink from round to round and are finished in one task once they are few.
    """
    work = kept(edges.select("u", "v").filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    steps = []
    while work.count() > at_once:
        # each node points at its least neighbour, if that is smaller; paths of pointers end at local minima
        point = work.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("label"))
        ends = work.select(F.col("u").alias("id")).union(work.select("v")).distinct()
        point = kept(ends.join(point, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "pointers")
        while True:
            up = point.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
            jumped = point.join(up, F.col("label") == F.col("_i")).select("id", F.col("_l").alias("label"), (F.col("_l") != F.col("label")).alias("moved"))
            jumped = kept(jumped, "pointers")
            point, done = jumped.drop("moved"), jumped.filter("moved").isEmpty()
            if done:
                break
        steps.append(point)
        a, b = (point.select(F.col("id").alias(x), F.col("label").alias(y)) for x, y in (("u", "lu"), ("v", "lv")))
        work = work.join(a, "u").join(b, "v").filter("lu <> lv")
        work = kept(work.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "edges")
    kind = edges.schema["u"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, q = _root(parent, u), _root(parent, v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, work_type), pa.array([_root(parent, x) for x in ids], work_type)], ["id", "label"])

    from pyspark.sql.pandas.types import to_arrow_type

    work_type = to_arrow_type(edges.schema["u"].dataType)
    found = kept(work.repartition(1).mapInArrow(join, f"id {kind}, label {kind}"), "components")
    for point in reversed(steps):
        top = found.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        found = point.join(top, F.col("label") == F.col("_i"), "left").select("id", F.coalesce("_l", "label").alias("label"))
    return kept(found, "components") if steps else found


def spanning_forest(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """links (u, v, distance) to the edges of the minimum spanning forest, u < v, by Boruvka's rounds.

    Each round takes the least edge that leaves each component, of equal distances that of least ends,
    merges what these join and drops the edges inside. Once at_once edges are left, one task takes the
    least of them in order. Self-links fall out, of repeated links the shortest counts, null distances none.
    """
    e = links.filter("u <> v AND distance IS NOT NULL").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("distance").alias("distance"))
    work = kept(e.select("u", "v", "distance", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest")
    schema, taken = links.select("u", "v", "distance").schema, []
    while work.count() > at_once:
        edge = F.struct("distance", "u", "v", "cu", "cv")
        both = work.select(F.col("cu").alias("c"), edge.alias("e")).unionByName(work.select(F.col("cv").alias("c"), edge.alias("e")))
        least = kept(both.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "least-edges")
        taken.append(least.select("u", "v", "distance"))
        joined = components(least.select(F.col("cu").alias("u"), F.col("cv").alias("v")), at_once)
        for c in ("cu", "cv"):
            work = work.join(joined.select(F.col("id").alias("_i"), F.col("label").alias("_l")), F.col(c) == F.col("_i")).withColumn(c, F.col("_l")).drop("_i", "_l")
        # of the edges between two components only the least can be taken
        work = work.filter("cu <> cv").withColumns({"_a": F.least("cu", "cv"), "_b": F.greatest("cu", "cv")})
        least = work.groupBy("_a", "_b").agg(F.min(F.struct("distance", "u", "v")).alias("e"))
        work = kept(least.select("e.u", "e.v", "e.distance", F.col("_a").alias("cu"), F.col("_b").alias("cv")), "forest")

    def kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, u, v, cu, cv) for b in batches for u, v, d, cu, cv in zip(*(c.to_pylist() for c in b.columns), strict=True))
        parent, out = {}, []
        for d, u, v, cu, cv in rows:
            p, q = _root(parent, cu), _root(parent, cv)
            if p != q:
                parent[p] = q
                out.append((u, v, d))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["u", "v", "distance"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]
    found = work.repartition(1).mapInArrow(kruskal, schema)
    for t in taken:
        found = found.unionByName(t)
    return kept(found, "spanning-forest")

"""Embedding clusters: pooling, threshold clusters, summaries with representatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import kept as _kept
from ..functions.text import clamp
from .components import _root, components


def pool(tokens: DataFrame) -> DataFrame:
    """tokens (id, vector, mask) to (id, embedding): mean of unmasked vectors, per dimension."""
    d = tokens.select("id", "mask", F.posexplode("vector").alias("dim", "x"))
    m = d.groupBy("id", "dim").agg((F.sum(F.col("x").cast("double") * F.col("mask")) / F.greatest(F.lit(1.0), F.sum("mask").cast("double"))).alias("x"))
    return m.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select("id", F.transform("v", lambda p: p["x"]).alias("embedding"))


def members(items: DataFrame) -> DataFrame:
    """items (id, pos, embedding, label, ...) with cluster_id and d2, the squared distance to the cluster's centroid: a row per member, however large a cluster is. Noise (label < 0, null) falls out; an embedding that is null has d2 null."""
    d = items.filter("label >= 0").withColumn("embedding", F.col("embedding").cast("array<double>"))
    means = d.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    centre = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select(F.col("label").alias("cluster_id"), F.transform("v", lambda p: p["x"]).alias("centroid"))
    j = d.join(centre, F.col("label") == F.col("cluster_id"))
    return j.withColumn("d2", F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)).drop("centroid", "label")


def summarise(items: DataFrame, persistence: DataFrame | None = None, gather: bool = True) -> DataFrame:
    """items (id, pos, text, embedding, label, probability) to clusters with centroid distance and representative, and with all their members if gather; members() has those as rows.

    Noise falls out; of equally near items the one of the least pos represents; repeated rows count.
    """
    g = members(items).groupBy("cluster_id").agg(
        *([F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda m: m["id"]).alias("member_ids")] if gather else []), F.min_by(F.struct("id", "text"), F.struct("d2", "pos")).alias("r"),
        F.count("*").alias("size"), F.avg("probability").alias("mean_probability"), F.min("d2").alias("least_d2"),
    )
    if persistence is not None:
        g = g.join(persistence.select(F.col("label").alias("cluster_id"), F.col("value").alias("_p")), "cluster_id", "left")
    else:
        g = g.withColumn("_p", F.lit(0.0))
    return g.select("cluster_id", *(["member_ids"] if gather else []), F.col("r.id").alias("representative_id"), F.col("r.text").alias("representative_text"), "size", "mean_probability", "least_d2", clamp(F.coalesce("_p", F.lit(0.0))).alias("stability"))


#: Rows of a block, as a power of two, and pivots by which pairs of blocks are ruled out.
CELL_BITS, PIVOTS = 10, 6
#: Blocks that links_within() cuts a table into, so that a vector is copied that often at most, and rows of a block at most, as a power of two: beyond BLOCKS times as many there are more blocks.
BLOCKS, MOST_BITS = 32, 15
#: Most tasks that pairs of blocks are dealt to.
TASKS = 4096
#: Links of a pair of blocks that are held before they are thinned to a forest.
LINKS = 1 << 19


def _vectors(items: DataFrame) -> DataFrame:
    """(id, e) of items with an embedding that can be measured: not null or empty, and without null or NaN in it."""
    e = F.col("embedding").cast("array<double>")
    ok = (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x))
    return items.filter(ok & F.col("id").isNotNull()).select("id", e.alias("e"))


def _equal(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different vectors, each with the least of its ids, and links of distance 0 between that and the others."""
    first = _kept(vectors.groupBy("e").agg(F.min("id").alias("id")), "different-vectors")
    pairs = vectors.join(first.withColumnRenamed("id", "u"), "e").filter("u <> id")
    return first, pairs.select("u", F.col("id").alias("v"), F.lit(0.0).alias("distance")).distinct()


def _blocks(rows: DataFrame, *order: str, bits: int | None = None, ranges: tuple[int, ...] = ()) -> DataFrame:
    """rows with a block of at most 2**bits rows (CELL_BITS) that follow each other in the order, none of them in two of the ranges."""
    bits = CELL_BITS if bits is None else bits
    d = rows.repartitionByRange(*ranges, *order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    return _kept(d.withColumn("block", F.shiftright("_n", bits)).drop("_n"), "blocks")


def _near(at: DataFrame, pairs: DataFrame, eps: float, tasks: int | None = None) -> DataFrame:
    """at (bucket, block, id, e), pairs (bucket, x, y) of its blocks, x <= y, to links (u, v, distance) of at most eps: of each pair of blocks a minimum spanning forest, not all pairs.

    A block is one row, so that pairs of blocks are rows and not copies of vectors. An edge that no forest
    of a pair of blocks holds is the longest of a cycle and is in no minimum spanning forest of the
    whole, so components and forests of these links are those of all pairs. tasks: what pairs are dealt to.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    packed = _kept(at.groupBy("bucket", "block").agg(F.collect_list(F.struct("id", "e")).alias("rows")), "packed-blocks")
    side = lambda c, name: packed.select("bucket", F.col("block").alias(c), F.col("rows").alias(name))
    both = pairs.join(side("x", "left"), ["bucket", "x"]).join(side("y", "right"), ["bucket", "y"]).select((F.col("x") == F.col("y")).alias("same"), "left", "right", "x", "y")
    both = both.repartition(tasks, "x", "y") if tasks else both
    kind, arrow = at.schema["id"].dataType.simpleString(), to_arrow_type(at.schema["id"].dataType)

    def forest(left: pa.Array, right: pa.Array, same: bool) -> pa.RecordBatch:
        rows = left if same else pa.concat_arrays([left, right])
        e, other = rows.field("e"), np.arange(len(rows)) >= len(left)
        ids, size = rows.field("id"), np.diff(e.offsets.to_numpy())
        order = np.empty(len(rows), "i8")  # places of the rows in the order of their ids
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(rows))
        found = [np.zeros(0), np.zeros(0, "i8"), np.zeros(0, "i8")]
        for n in np.unique(size):  # vectors of different length are never near
            here = np.flatnonzero(size == n)
            v = e.take(pa.array(here)).flatten().to_numpy().reshape(len(here), n)
            p, q = (np.arange(len(here)),) * 2 if same else (np.flatnonzero(~other[here]), np.flatnonzero(other[here]))
            for d, a, b in _close(v, p, q, eps):
                found = [np.concatenate(c) for c in zip(found, (d, here[a], here[b]), strict=True)]
                if len(found[0]) > LINKS:
                    found = _thinned(*found, order)
        d, a, b = _thinned(*found, order)
        u, v = np.where(order[a] < order[b], a, b), np.where(order[a] < order[b], b, a)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(u)).cast(arrow), ids.take(pa.array(v)).cast(arrow), pa.array(d)], ["u", "v", "distance"])

    def compare(batches):
        for batch in batches:
            for k in range(len(batch)):
                yield forest(batch.column("left")[k].values, batch.column("right")[k].values, batch.column("same")[k].as_py())

    return both.select("same", "left", "right").mapInArrow(compare, f"u {kind}, v {kind}, distance double")


def _thinned(d: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """The minimum spanning forest of links (d, a, b) by Boruvka's rounds; of equal distances that of least ends in the order comes first."""
    low, high = np.minimum(order[a], order[b]), np.maximum(order[a], order[b])
    by = np.lexsort((high, low, d))
    d, a, b = d[by], a[by], b[by]
    label, stay, taken = np.arange(len(order)), np.arange(len(d)), []
    while len(stay):
        u, v = label[a[stay]], label[b[stay]]
        stay, u, v = stay[u != v], u[u != v], v[u != v]
        least = np.full(len(order), len(d))
        np.minimum.at(least, u, stay)
        np.minimum.at(least, v, stay)
        if not len(edge := np.unique(least[least < len(d)])):
            break
        taken.append(edge)
        point = np.arange(len(order))  # each component points over its least edge; of two that point at each other the lower is the root
        comp = np.flatnonzero(least < len(d))
        x, y = label[a[least[comp]]], label[b[least[comp]]]
        point[comp] = np.where(x == comp, y, x)
        mutual = (point[point] == np.arange(len(order))) & (np.arange(len(order)) < point)
        point[mutual] = np.flatnonzero(mutual)
        while (point[point] != point).any():
            point = point[point]
        label = point[label]
    edge = np.concatenate([np.zeros(0, "i8"), *taken])
    return [d[edge], a[edge], b[edge]]


def _close(v: np.ndarray, p: np.ndarray, q: np.ndarray, eps: float):
    """(distances, a, b) of a of p and b of q at most eps apart, different rows of v: first by products with a margin, then exactly."""
    squares = (v * v).sum(1)
    margin = 1e-9 * (1 + squares.max(initial=0))
    few = 1 << 10
    for at in range(0, len(p), few):
        for to in range(0, len(q), few):
            a, b = p[at : at + few], q[to : to + few]
            rough = squares[a][:, None] + squares[b][None, :] - 2 * (v[a] @ v[b].T)
            i, j = np.nonzero(rough <= eps * eps + margin)
            i, j = a[i], b[j]
            i, j = i[i != j], j[i != j]
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                d = np.sqrt(((v[x] - v[y]) ** 2).sum(1))
                yield d[d <= eps], x[d <= eps], y[d <= eps]


def links_within(items: DataFrame, eps: float) -> DataFrame:
    """items (id, embedding) to links (u, v, distance) of at most eps, enough of them that components and minimum spanning forests are those of all such pairs. Exact.

    Equal vectors are linked to the first of them and compared once. Blocks follow the distances to a few
    pivots, in steps of eps; a pair of blocks is compared unless a pivot's distances are more than eps
    apart. Pairs of blocks meet by steps of the first pivot's distance. Where distances do not differ by
    more than eps nothing is ruled out, and the work is quadratic in the number of different vectors;
    near_links() is the form for such tables.
    """
    first, equal = _equal(_vectors(items))
    pivots = [r.e for r in first.orderBy(F.xxhash64("e"), "e").limit(PIVOTS).collect()]
    if not pivots:
        return equal
    away = [F.sqrt(F.aggregate(F.zip_with("e", F.array(*[F.lit(x) for x in p]), lambda a, b: (F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) ** 2), F.lit(0.0), lambda s, x: s + x)) for p in pivots]
    names = [f"d{k}" for k in range(len(pivots))]
    d = first.select("id", "e", *[a.alias(n) for a, n in zip(away, names, strict=True)])
    d = d.select("*", F.lit(0).alias("bucket"), *[F.floor(F.col(n) / eps).alias(f"s{n}") for n in names], F.xxhash64("e").alias("_h"))
    # blocks grow with the table: as many pairs of them, and as many copies of a vector, whatever its size
    n = first.count()
    bits = max(CELL_BITS, min(MOST_BITS, (n // BLOCKS).bit_length()))
    at = _blocks(d, *[f"s{n}" for n in names], "_h", bits=bits, ranges=(max(1, -(-n // (1 << bits))),))
    spread = at.groupBy("block").agg(*[f(n).alias(f"{g}{n}") for n in names for f, g in ((F.min, "lo"), (F.max, "hi"))])
    spread = _kept(spread, "block-ranges")
    steps = lambda more: F.explode(F.sequence(F.floor(F.col("lod0") / eps).cast("int") - more, F.floor(F.col("hid0") / eps).cast("int") + more)).alias("_s")
    a, b = spread.select("*", steps(0)).alias("a"), spread.select("*", steps(1)).alias("b")
    apart = [F.greatest(F.col(f"a.lo{n}") - F.col(f"b.hi{n}"), F.col(f"b.lo{n}") - F.col(f"a.hi{n}")) <= eps * (1 + 1e-9) for n in names]
    on = (F.col("a._s") == F.col("b._s")) & (F.col("a.block") <= F.col("b.block"))
    for x in apart:
        on = on & x
    pairs = a.join(b, on).select(F.lit(0).alias("bucket"), F.col("a.block").alias("x"), F.col("b.block").alias("y")).distinct()
    pairs = _kept(pairs, "block-pairs")
    return _near(at.select("bucket", "block", "id", "e"), pairs, eps, max(1, min(TASKS, pairs.count()))).unionByName(equal)


def near_links(items: DataFrame, eps: float, tables: int = 12, projections: int = 6, width: float = 4.0, seed: int = 7) -> DataFrame:
    """Like links_within(), by an approximate index: of the pairs at most eps apart those that share a bucket in one of some tables.

    A bucket is the cell of the vector's projections on random directions, width * eps wide, moved by a
    random part of it. Every link is measured; a pair is missed if no table has it in one bucket. A bucket
    of many rows is dealt out in blocks and all its pairs of blocks are compared. Each table moves each
    different vector once, so rows moved grow as the table does.
    """
    first, equal = _equal(_vectors(items))

    def hashed(batches):
        for b in batches:
            e = b.column(1)
            out = []
            for v in e:
                v = v.values.to_numpy()
                g = np.random.default_rng([seed, len(v)])
                cells = np.floor((g.normal(size=(tables * projections, len(v))) @ v) / (width * eps) + g.random(tables * projections)).astype(np.int64)
                out += [f"{len(v)}:{k}:" + ",".join(map(str, c)) for k, c in enumerate(cells.reshape(tables, -1))]
            at = pa.array(np.repeat(np.arange(len(b)), tables))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), e.take(at), pa.array(out, pa.string())], ["id", "e", "bucket"])

    kind = first.schema["id"].dataType.simpleString()
    d = first.select("id", "e").mapInArrow(hashed, f"id {kind}, e array<double>, bucket string")
    d = _kept(d.withColumn("_h", F.xxhash64("e")), "buckets")
    full = d.groupBy("bucket").count().filter("count > 1").select("bucket")
    at = _blocks(d.join(full, "bucket", "left_semi"), "bucket", "_h")
    b = at.select("bucket", "block").distinct()
    b = _kept(b, "bucket-blocks")
    pairs = b.withColumnRenamed("block", "x").join(b.withColumnRenamed("block", "y"), "bucket").filter("x <= y")
    return _near(at.select("bucket", "block", "id", "e"), pairs, eps).unionByName(equal)


def threshold_clusters(items: DataFrame, eps: float, links=links_within) -> DataFrame:
    """(id, label) of each different id: single-linkage components within eps, labelled by their least id.

    Items near no other are noise, label -1, as are those whose embedding is null, empty or holds null or
    NaN. Rows with one id are one item, near to whatever one of them is near to. No rows of none.
    """
    c = components(links(items, eps))
    ids = items.select(F.col("id").alias("_i")).distinct()
    return ids.join(c, F.col("_i") == F.col("id"), "left").select(F.col("_i").alias("id"), F.coalesce("label", F.lit(-1)).alias("label"))


def hierarchy(forest: DataFrame, eps: float, levels: int = 8) -> tuple[DataFrame, DataFrame]:
    """A minimum spanning forest (u, v, distance) of links up to eps to (id, label) and (label, value, size): the clusters that persist, by excess of mass, and how much.

    Distances count as the next of the thresholds eps * k / levels, and 1/threshold is the density at
    which things part. Going up the thresholds, components join: two or more clusters that join end there
    and a new one begins, single items join the cluster as it is, single items alone begin one. A
    cluster's stability is the sum over its items of the density at which they leave it, above that at
    which it ends. It is taken unless the best of the clusters within it are worth more together. value
    is its share of the most its items could have at the densest threshold in use. A cluster at the top
    ends at 1/eps. Items of no taken cluster have no row; a label is the least id of a cluster.
    """
    density = lambda k: levels / (eps * k)
    step = F.least(F.greatest(F.ceil(F.col("distance") / eps * levels - 1e-9), F.lit(1)), F.lit(levels)).cast("int")
    work = _kept(forest.select("u", "v", step.alias("k")), "hierarchy")
    kind = forest.schema["u"].dataType.simpleString()
    spark = forest.sparkSession
    # open clusters by component: born at step k under the label c; what they weigh, and the best within
    state = spark.createDataFrame([], f"comp {kind}, k int, c {kind}, size long, mass double, within double")
    closed, homes, used = [], [], [r.k for r in work.select("k").distinct().orderBy("k").collect()]
    for k in used:
        label = components(work.filter(F.col("k") == k))
        j = _kept(label.join(state, F.col("id") == F.col("comp"), "left"), "joins")
        alone = F.col("comp").isNull()
        g = j.groupBy("label").agg(
            F.count_if(~alone).alias("n_open"), F.count_if(alone).alias("n_alone"), F.coalesce(F.sum("size"), F.lit(0)).alias("held"), F.sum("mass").alias("mass"), F.sum("within").alias("within"),
            F.first("k", True).alias("k"), F.first("c", True).alias("c"), F.sum(F.greatest(F.col("mass") - F.col("size") * density(k), "within")).alias("best"),
        )
        one, size = F.col("n_open") == 1, F.col("held") + F.col("n_alone")
        g = _kept(g.select(
            F.col("label").alias("comp"), F.when(one, F.col("k")).otherwise(F.lit(k)).alias("k"), F.when(one, F.col("c")).otherwise(F.col("label")).alias("c"), size.alias("size"),
            F.when(one, F.col("mass") + F.col("n_alone") * density(k)).otherwise(size * density(k)).alias("mass"), F.when(one, F.col("within")).otherwise(F.coalesce("best", F.lit(0.0))).alias("within"), (F.col("n_open") > 1).alias("ends"),
        ), "open")
        up = g.select(F.col("comp").alias("label"), F.col("k").alias("pk"), F.col("c").alias("pc"), "ends")
        closed.append(j.filter(~alone).join(up.filter("ends"), "label").select("k", "c", "size", (F.col("mass") - F.col("size") * density(k)).alias("stability"), "within", "pk", "pc"))
        homes.append(j.filter(alone).join(up, "label").select("id", F.col("pk").alias("k"), F.col("pc").alias("c")))
        rest = state.join(label, F.col("comp") == F.col("id"), "left_anti")
        state = _kept(rest.unionByName(g.drop("ends")), "open")
        moved = work.filter(F.col("k") > k)
        for end in ("u", "v"):
            moved = moved.join(label.select(F.col("id").alias("_i"), F.col("label").alias("_l")), F.col(end) == F.col("_i"), "left").withColumn(end, F.coalesce("_l", end)).drop("_i", "_l")
        work = _kept(moved, "hierarchy")
    if not used:
        return state.select(F.col("comp").alias("id"), F.col("c").alias("label")), state.select(F.col("c").alias("label"), F.col("mass").alias("value"), "size")
    none = [F.lit(None).cast("int").alias("pk"), F.lit(None).cast(kind).alias("pc")]
    tree = state.select("k", "c", "size", (F.col("mass") - F.col("size") * density(levels)).alias("stability"), "within", *none)
    for t in closed:
        tree = tree.unionByName(t)
    tree = _kept(tree.withColumn("own", F.col("stability") >= F.col("within")), "cluster-tree")
    taken = tree.limit(0).select("k", "c", F.col("k").alias("tk"), F.col("c").alias("tc"))
    for k in reversed(used):  # from the top: what a taken cluster holds belongs to it
        above = taken.select(F.col("k").alias("pk"), F.col("c").alias("pc"), "tk", "tc")
        t = tree.filter(F.col("k") == k).join(above, ["pk", "pc"], "left")
        t = t.select("k", "c", *[F.coalesce(a, F.when(F.col("own"), F.col(b))).alias(a) for a, b in (("tk", "k"), ("tc", "c"))])
        taken = _kept(taken.unionByName(t), "taken")
    home = homes[0]
    for h in homes[1:]:
        home = home.unionByName(h)
    of = home.join(taken.filter("tk IS NOT NULL"), ["k", "c"]).select("id", "tk", "tc")
    of = _kept(of, "labels")
    named = of.groupBy("tk", "tc").agg(F.min("id").alias("label"), F.count("*").alias("size"))
    named = named.join(tree.select(F.col("k").alias("tk"), F.col("c").alias("tc"), "stability"), ["tk", "tc"])
    named = _kept(named.select("tk", "tc", "label", (F.col("stability") / (F.col("size") * density(used[0]))).alias("value"), "size"), "persistence")
    return of.join(named, ["tk", "tc"]).select("id", "label"), named.select("label", "value", "size")

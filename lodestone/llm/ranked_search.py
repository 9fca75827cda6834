"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

Index. Each task cuts its documents into shards of bounded size and inverts them where they stand, so
no text and no posting is shuffled to build it. A shard has a row with its documents (ids and numbers
of terms) and a row per term: postings in blocks of BLOCK, each posting a gap and a frequency as
variable-length bytes, and beside each block its last document and its front: the pairs of frequency
and length that no other pair of the block beats. A front gives the block's highest score under any
corpus counts, so shards can be added without touching the old ones.

Search. Corpus counts are summed over shards, a term gets its weight, and the rows of the items' terms
meet by shard. There, lists are ordered by their highest score. Those whose highest scores add up to
less than the tenth best score so far are non-essential: documents in none of the others cannot enter.
Documents of essential lists are scored window by window; going through the non-essential lists, a
document falls out as soon as its score, the maximum of the one block that may hold it and what the
lists below can add stay under the tenth best. Only blocks of documents left are decompressed. The
shards' best ten meet by item, ten rows a shard.

Defined results: null and empty texts have no terms and are not counted in N; equal scores are
ordered by doc_id, nulls last; rows with equal ids are ranked each; items without terms, or whose
terms stand nowhere, give no rows; equal item ids are taken as one item, with the terms of all; an
empty table of documents or items gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import staged

#: Results of an item; postings of a block; most documents and, about, terms of a shard; documents scored at once.
TOP, BLOCK, SHARD_DOCS, SHARD_TERMS, WINDOW = 10, 128, 8192, 1 << 22, 1024
#: Bytes of the items' texts that are searched for at once: what the driver and each task hold of them.
ITEM_BYTES = 1 << 22
#: Terms are ASCII letters and digits, and all characters beyond ASCII: in UTF-8, these bytes.
TERMS = rb"[0-9a-z\x80-\xff]+"

_INDEX = "shard string, term binary, df long, doc_ids array<{id}>, lengths binary, last binary, ends binary, front binary, front_ends binary, data binary"


def terms_of(text: str | None) -> list[bytes]:
    return re.findall(TERMS, (text or "").encode(errors="replace").lower())  # bytes: only A-Z change


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes, seven bits each, low ones first, the last one with its high bit set; and each value's number of bytes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    out = np.empty(int(size.sum()), np.uint8)
    start = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[has] + k] = (values[has] >> (7 * k) & 127) | np.where(size[has] == k + 1, 128, 0)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    stop = np.flatnonzero(data & 128)
    start = np.concatenate([[0], stop[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(start, stop - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start)


def _slices(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each of ends, cut from parts without a copy."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(parts.tobytes())])


def _invert(shard: str, ids: pa.Array, lengths: list[int], codes: list[np.ndarray], vocabulary: list[bytes], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents, then its terms in the order of their codes."""
    n = len(lengths)
    length = np.array(lengths, np.int64)

    def rows(**columns):
        k = len(next(iter(columns.values())))
        columns["shard"] = pa.array([shard] * k)
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)

    whole = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
    yield rows(doc_ids=whole, lengths=pa.array([length.astype("<i4").tobytes()], pa.binary()))
    if not vocabulary:
        return
    key, tf = np.unique(np.concatenate(codes) * n + np.repeat(np.arange(n), length), return_counts=True)
    code, doc = np.divmod(key, n)
    place = np.arange(len(key))
    df = np.bincount(code, minlength=len(vocabulary))
    in_term = place - np.repeat(np.cumsum(df) - df, df)
    first = in_term % BLOCK == 0
    start = np.flatnonzero(first)
    block = np.cumsum(first) - 1
    data, size = pack(np.stack([np.where(first, doc, doc - np.concatenate([[0], doc[:-1]])), tf], 1).ravel())
    byte_end = np.cumsum(size.reshape(-1, 2).sum(1))
    last = np.concatenate([start[1:], [len(key)]]) - 1
    # front: of each block, by falling frequency, the pairs shorter than all before
    order = np.lexsort((length[doc], -tf, block))
    shorter = length[doc][order] - (block[order] << 32)
    least = np.minimum.accumulate(shorter)
    on_front = order[np.concatenate([[True], shorter[1:] < least[:-1]])]
    front = np.stack([tf[on_front], length[doc][on_front]], 1)
    front_end = np.cumsum(np.bincount(block[on_front], minlength=len(start)))
    # cut by term; places inside a term count from its own start
    blocks = -(-df // BLOCK)
    block_end = np.cumsum(blocks)
    term_of_block = np.repeat(np.arange(len(df)), blocks)
    byte_of_term, front_of_term = byte_end[last][block_end - 1], front_end[block_end - 1]
    before = lambda x: np.concatenate([[0], x[:-1]])[term_of_block]
    four = lambda x: x.astype("<i4").view(np.uint8)
    yield rows(
        term=pa.array(vocabulary, pa.binary()), df=pa.array(df), last=_slices(four(doc[last]), 4 * block_end), ends=_slices(four(byte_end[last] - before(byte_of_term)), 4 * block_end),
        front=_slices(four(front.ravel()), 8 * front_of_term), front_ends=_slices(four(front_end - before(front_of_term)), 4 * block_end), data=_slices(data, byte_of_term),
    )


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of all docs, written once to the shared folder."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    out = _INDEX.format(id=kind)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), count()
        new = lambda: (dict(), [], [], [], [0])
        vocabulary, ids, lengths, codes, held = new()

        def cut():
            at = pa.concat_arrays(ids) if ids else pa.array([])
            return _invert(f"{part}-{next(number)}", at, lengths, codes, list(vocabulary), schema)

        for batch in batches:
            of, texts = batch.column(0), batch.column(1)
            for k in range(len(batch)):
                found = terms_of(texts[k].as_py())
                codes.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in found), np.int64, len(found)))
                ids.append(of.slice(k, 1))
                lengths.append(len(found))
                held[0] += len(found)
                if len(lengths) >= shard_docs or held[0] >= shard_terms:
                    yield from cut()
                    vocabulary, ids, lengths, codes, held = new()
        if lengths:
            yield from cut()

    schema = to_arrow_schema(StructType.fromDDL(out))
    return staged(d.mapInArrow(invert, out), "search-index")


class Postings:
    """A term's list in one shard, with its highest possible scores by block; blocks are decompressed when asked for."""

    def __init__(self, row: dict, weight: int, share: np.ndarray, whole):
        ints = lambda c: np.frombuffer(row[c], "<i4").astype(np.int64)
        self.last, self.ends, self.data = ints("last"), ints("ends"), np.frombuffer(row["data"], np.uint8)
        tf, n = ints("front").reshape(-1, 2).T
        ends = ints("front_ends")
        self.most = weight * np.maximum.reduceat(impact(tf, whole(n)), np.concatenate([[0], ends[:-1]]))
        self.weight, self.share, self.open = weight, share, {}
        self.decompressed = 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block."""
        if b not in self.open:
            v = unpack(self.data[self.ends[b - 1] if b else 0 : self.ends[b]])
            docs = np.cumsum(v[::2])
            self.open[b] = docs, self.weight * impact(v[1::2], self.share[docs])
            self.decompressed += 1
        return self.open[b]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best(lists: list[tuple[Postings, int]], n_docs: int, top: int = TOP, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores that may be among the top of one shard: all of the top, with all that tie with the last. lists: (postings, times in the item)."""
    lists = sorted(((p, q, q * int(p.most.max())) for p, q in lists), key=lambda x: x[2])
    reach = np.cumsum([0] + [u for _, _, u in lists])  # what the lists before can add together
    docs, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 1
    for lo in range(0, n_docs, window):
        first = int(np.searchsorted(reach[1:], least, "left"))  # lists before it are non-essential
        if first == len(lists):
            break
        hi = min(lo + window, n_docs)
        sums = np.zeros(hi - lo, np.int64)
        for p, q, _ in lists[first:]:
            b, end = int(np.searchsorted(p.last, lo)), int(np.searchsorted(p.last, hi - 1))
            for k in range(b, min(end + 1, len(p.last))):
                d, s = p.block(k)
                i, j = (np.searchsorted(d, [lo, hi]) if d[0] < lo or d[-1] >= hi else (0, len(d)))
                sums[d[i:j] - lo] += q * s[i:j]
        at = np.flatnonzero(sums)
        got, at = sums[at], at + lo
        for k in range(first - 1, -1, -1):
            left = got + reach[k + 1] >= least
            at, got = at[left], got[left]
            if not len(at):
                break
            p, q, _ = lists[k]
            b = np.searchsorted(p.last, at)
            bound = np.where(b < len(p.last), q * p.most[np.minimum(b, len(p.last) - 1)], 0)
            left = got + bound + reach[k] >= least  # by the block's maximum, before it is decompressed
            at, got, b, bound = at[left], got[left], b[left], bound[left]
            for x in np.unique(b[bound > 0]):
                d, s = p.block(int(x))
                here = np.flatnonzero(b == x)
                place = np.minimum(np.searchsorted(d, at[here]), len(d) - 1)
                hit = d[place] == at[here]
                got[here[hit]] += q * s[place[hit]]
        left = got >= least
        docs, scores = np.concatenate([docs, at[left]]), np.concatenate([scores, got[left]])
        if len(scores) >= top:
            least = max(1, int(np.partition(scores, -top)[-top]))
            docs, scores = docs[scores >= least], scores[scores >= least]
    return docs, scores


def _search(index: DataFrame, items: dict, kind: str, n: int, total: int) -> DataFrame:
    """Best documents per shard and item; items: item_id to {term: times}."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(bytearray(t),) for t in sorted({t for q in items.values() for t in q})], "_t binary")
    rows = index.filter(F.col("term").isNotNull()).join(F.broadcast(wanted), F.col("term") == F.col("_t")).drop("_t")
    df = rows.groupBy("term").agg(F.sum("df").alias("_df"))
    weight = df.select(F.col("term").alias("_t"), F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("_df") + 1))).cast("long").alias("weight"))
    rows = rows.join(F.broadcast(weight), F.col("term") == F.col("_t")).drop("_t")  # as many rows as the items have terms
    docs = index.filter(F.col("term").isNull()).withColumn("weight", F.lit(None).cast("long"))
    order = list(items.items())

    def search(table: pa.Table) -> pa.Table:
        term = table.column("term")
        head = table.filter(term.is_null()).slice(0, 1)
        ids = head.column("doc_ids").combine_chunks().flatten()
        whole = lambda n_terms: 25 + 75 * n * n_terms // total
        share = whole(np.frombuffer(head.column("lengths")[0].as_py(), "<i4").astype(np.int64))
        got = {r["term"]: Postings(r, r["weight"], share, whole) for r in table.filter(term.is_valid()).drop_columns(["doc_ids"]).to_pylist()}
        out_item, out_doc, out_score = [], [], []
        for item, terms in order:
            lists = [(got[t], q) for t, q in terms.items() if t in got]
            if lists:
                at, score = best(lists, len(ids))
                out_item += [item] * len(at)
                out_doc.append(at)
                out_score.append(score)
        at = np.concatenate(out_doc) if out_doc else np.empty(0, np.int64)
        score = np.concatenate(out_score) if out_score else np.empty(0, np.int64)
        return pa.table({"item_id": pa.array(out_item, schema.field("item_id").type), "doc_id": ids.take(pa.array(at)), "score": score}, schema=schema)

    out = f"item_id {kind}, doc_id {index.schema['doc_ids'].dataType.elementType.simpleString()}, score long"
    schema = to_arrow_schema(StructType.fromDDL(out))
    return rows.unionByName(docs).groupBy("shard").applyInArrow(search, out)


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item, items taken in blocks of about item_bytes."""
    spark = index.sparkSession
    q = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    kind = q.schema["item_id"].dataType.simpleString()
    size = q.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / item_bytes))
    heads = index.filter(F.col("term").isNull()).select("lengths")

    @F.arrow_udf("struct<n:bigint,total:bigint>")
    def counted(lengths: pa.Array) -> pa.Array:
        at = [np.frombuffer(x.as_py(), "<i4") for x in lengths]
        return pa.StructArray.from_arrays([pa.array([int((x > 0).sum()) for x in at], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in at], pa.int64())], ["n", "total"])

    n, total = heads.select(counted("lengths").alias("c")).agg(F.coalesce(F.sum("c.n"), F.lit(0)), F.coalesce(F.sum("c.total"), F.lit(0))).first()
    found = spark.createDataFrame([], f"item_id {kind}, doc_id {index.schema['doc_ids'].dataType.elementType.simpleString()}, score long")
    for k in range(blocks if n else 0):
        asked: dict = {}
        for r in q.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():  # bounded by item_bytes and the longest item
            terms = asked.setdefault(r.item_id, {})
            for t in terms_of(r.text):
                terms[t] = terms.get(t, 0) + 1
        if any(asked.values()):
            found = found.unionByName(_search(index, asked, kind, n, total))
    best_first = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w)) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, len AS n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS len, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY t, c.n),
s AS (SELECT item_id, r, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * c.n) // c.l))))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

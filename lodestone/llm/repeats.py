"""Removal of repeated 200-byte strings by prefix-free parsing.

Rolling hashes trigger phrase borders: of the short grams in each 200-byte window the one with the
least hash is its trigger, so equal windows have equal triggers, at equal places, and consecutive
windows with one trigger form a phrase (with its context). No window is a proper prefix of another,
so phrases can be put in order by themselves: the parse is the table of phrases by hash, with the
texts they stand in, and the dictionary has each different phrase once.

A phrase that the parse has twice is repeated whole. Of the others only those matter whose half
window beside the trigger (which every window of that half contains) stands elsewhere too. Their
bytes form the dictionary, dealt out by that half: parts between which no two suffixes have 200 bytes
in common. A suffix array of each part puts its windows in corpus order; a window whose neighbour has
200 common bytes, or whose phrase the parse has twice, is repeated. A trigger with very many different
phrases is no part of bounded size: its windows are dealt out singly and counted by two hashes.

Phrases are counted by two 64-bit polynomial hashes, of the half window and of the whole; all other
comparisons are of bytes.

Defined results: null text is empty; texts below the width have nothing to remove; repeated rows
are texts of their own, and so are removed wholly; null ids are carried; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

WIDTH, GRAM = 200, 8
#: Bytes hashed together; bounds a task's memory.
CHUNK = 1 << 20
LOW = (1 << 26) - 1
#: Windows put in suffix order together, and contexts of a key beyond which its windows are dealt out singly instead.
PART, MOST_CONTEXTS = 1 << 16, 2048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any substrings of a buffer, by prefix sums of a polynomial modulo 2^64."""

    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    letters = _mix(np.arange(1, 257, dtype="u8") * np.uint64(0xD6E8FEB86659FD93))
    powers = inverses = np.ones(1, "u8")

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hasher.powers) < n:
            inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
            Hasher.powers = np.cumprod(np.append(np.uint64(1), np.full(n, self.base)), dtype="u8")
            Hasher.inverses = np.cumprod(np.append(np.uint64(1), np.full(n, inverse)), dtype="u8")
        self.sums = np.append(np.uint64(0), np.cumsum(self.letters[data] * self.powers[: n - 1], dtype="u8"))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverses[start])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours."""
    size = 1
    while 2 * size <= width:
        v, size = np.minimum(v[:-size], v[size:]), 2 * size
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def phrases(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH):
    """Halves of phrases in a buffer of texts (bounds: where each starts, and the end): first and last window, key, context."""
    h, half = Hasher(data), width // 2 - GRAM // 2
    grams = h.of(np.arange(len(data) - GRAM + 1), GRAM)
    v = (grams & ~np.uint64(LOW)) | (np.uint64(LOW) - np.arange(len(grams), dtype="u8"))
    at = LOW - (_least(v, width - GRAM + 1) & np.uint64(LOW)).astype("i8")  # trigger of the window at each place
    text = np.searchsorted(bounds, np.arange(len(at)), "right") - 1
    p = np.nonzero(np.arange(len(at)) + width <= bounds[text + 1])[0]
    if not len(p):
        return [np.empty(0, "i8")] * 2 + [np.empty(0, "u8")] * 2
    a = at[p]
    right = a - p < half
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1) | (right[1:] != right[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(p)) - 1
    p0, p1, a, right = p[first], p[last], a[first], right[first]
    reach = half + GRAM
    key = h.of(np.where(right, a, a - half), reach) ^ np.where(right, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    context = _mix(h.of(p0, p1 - p0 + width) + np.uint64(31) * (a - p0).astype("u8") + np.uint64(1000003) * (p1 - p0).astype("u8"))
    return p0, p1, key, context


def _chunks(texts: list[bytes], width: int):
    """Groups of (text number, offset, bytes); a long text comes in pieces that overlap by width - 1."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), CHUNK):
            piece = t[at : at + CHUNK + width - 1]
            if group and size + len(piece) > CHUNK:
                yield group
                group, size = [], 0
            group.append((k, at, piece))
            size += len(piece)
    if group:
        yield group


def _encoded(column) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in column]


def _phrase_rows(docs: DataFrame, width: int) -> DataFrame:
    """(key, context, n, at): halves of phrases; at packs first and last window and times (_packed). What a batch holds twice goes under keys of its own, and once more for others."""

    def each(batches):
        for b in batches:
            numbers, texts = b.column("n").to_numpy(), _encoded(b.column("text"))
            for group in _chunks(texts, width):
                data = np.frombuffer(b"".join(t for _, _, t in group), "u1")
                if len(data) < width:
                    continue
                bounds = np.cumsum([0, *(len(t) for _, _, t in group)])
                p0, p1, key, context = phrases(data, bounds, width)
                if not len(p0):
                    continue
                text = np.searchsorted(bounds, p0, "right") - 1
                shift = np.array([at for _, at, _ in group])[text] - bounds[text]
                n = numbers[np.array([k for k, _, _ in group])[text]]
                p0, p1 = p0 + shift, p1 + shift
                _, first, back, times = np.unique(np.stack([key, context]), axis=1, return_index=True, return_inverse=True, return_counts=True)
                again = times[back.ravel()] > 1
                rep = first[times > 1]
                key2 = np.where(again, _mix(n.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + p0.astype("u8")), key)
                at = p0 | (p1 - p0) << 32 | (1 + again) << 48
                cols = [np.append(key2, key[rep]).view("i8"), np.append(context, context[rep]).view("i8"), np.append(n, n[rep]), np.append(at, at[rep])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype("i8")) for c in cols], ["key", "context", "n", "at"])

    return docs.select("n", "text").mapInArrow(each, "key long, context long, n long, at long")


def _first() -> Column:
    return F.col("at").bitwiseAND(F.lit((1 << 32) - 1).cast("long")).cast("int")


def _last() -> Column:
    return _first() + F.shiftright("at", 32).bitwiseAND(F.lit((1 << 16) - 1).cast("long")).cast("int")


def _times() -> Column:
    return F.shiftright("at", 48).cast("int")


def _spans(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(n, text, spans) of the texts whose windows in spans (key, p0, p1, times) are looked at singly."""
    spans = opened.groupBy(F.col("n").alias("m")).agg(F.collect_list(F.struct("key", "p0", "p1", "times")).alias("spans"))
    return docs.join(spans, F.col("n") == F.col("m")).select("n", "text", "spans")


def _dictionary(spans: DataFrame, width: int) -> DataFrame:
    """(key, n, p0, times, phrase): the phrases with their contexts, each once."""

    def each(batches):
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.slice(k, 64)
                rows = [(s["key"], n, s["p0"], s["times"], text[s["p0"] : s["p1"] + width]) for n, text, spans in zip(part.column("n").to_pylist(), _encoded(part.column("text")), part.column("spans").to_pylist(), strict=True) for s in spans]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["key", "n", "p0", "times", "phrase"])

    return spans.mapInArrow(each, "key long, n long, p0 int, times int, phrase binary")


def suffix_order(phrases: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of phrases, cut at width bytes: of the suffixes that long, in order, the phrase, the place in it, and the first and last of those equal to it."""
    size = np.array([len(p) for p in phrases])
    n, data = size - width + 1, np.frombuffer(b"".join(phrases), "u1")
    of = np.repeat(np.arange(len(phrases)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(size) - size)[of] + place
    windows = np.lib.stride_tricks.sliding_window_view(data, width)[start].view(f"V{width}").ravel()
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    first = np.nonzero(new)[0]
    group = np.cumsum(new) - 1
    return of[order], place[order], first[group], np.append(first[1:], len(order))[group] - 1


def _neighbours(dictionary: DataFrame, width: int) -> DataFrame:
    """The dictionary (dealt by key and sorted by it) to (n, p0, p1): windows that have an equal neighbour in suffix order, or whose phrase stands elsewhere.

    Equal windows have equal keys, so the dictionary falls into parts between which no neighbour has
    width bytes in common; whole parts are put in order together.
    """

    def found(rows):
        _, n, p0, times, phrases = zip(*rows, strict=True)
        of, place, first, last = suffix_order(phrases, width)
        total = np.append(0, np.cumsum(np.array(times)[of]))
        again = total[last + 1] - total[first] > 1
        of, place = of[again], place[again]
        order = np.lexsort((place, of))
        of, place = of[order], place[order]
        if not len(of):
            return None
        new = np.append(True, (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1))
        head = np.nonzero(new)[0]
        tail = np.append(head[1:], len(of)) - 1
        base = np.array(p0)[of[head]]
        return pa.RecordBatch.from_arrays([pa.array(np.array(n)[of[head]]), pa.array((base + place[head]).astype("i4")), pa.array((base + place[tail]).astype("i4"))], ["n", "p0", "p1"])

    def each(batches):
        rows, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > PART and row[0] != rows[-1][0]:
                    if (out := found(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) - width + 1
        if rows and (out := found(rows)) is not None:
            yield out

    return dictionary.repartition("key").sortWithinPartitions("key").mapInArrow(each, "n long, p0 int, p1 int")


def _windows(spans: DataFrame, width: int) -> DataFrame:
    """(g, h, n, at): every window of the spans, by two hashes."""

    def each(batches):
        for b in batches:
            for n, text, spans in zip(b.column("n").to_pylist(), _encoded(b.column("text")), b.column("spans").to_pylist(), strict=True):
                for s in spans:
                    data, at = np.frombuffer(text[s["p0"] : s["p1"] + width], "u1"), np.arange(s["p1"] - s["p0"] + 1)
                    g, h = (Hasher(x).of(at, width).view("i8") for x in (data ^ np.uint8(0x5A), data))
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(h), pa.array(np.full(len(h), n)), pa.array((at + s["p0"]) | s["times"] << 48)], ["g", "h", "n", "at"])

    return spans.mapInArrow(each, "g long, h long, n long, at long")


def repeated_windows(docs: DataFrame, width=WIDTH, most=MOST_CONTEXTS) -> DataFrame:
    """docs (n, text) to (n, p0, p1): ranges of starts of windows that start elsewhere too."""
    w, wc = W.partitionBy("key"), W.partitionBy("key", "context")
    r = _phrase_rows(docs, width).withColumn("all", F.sum(_times()).over(w)).withColumn("mixed", F.min("context").over(w) != F.max("context").over(w))
    r = r.filter("all > 1").withColumn("whole", F.sum(_times()).over(wc)).withColumn("one", F.row_number().over(wc.orderBy("n", "at")) == 1)
    r = r.withColumn("open", F.col("mixed") & F.col("one"))
    r = r.withColumn("wide", F.sum(F.col("open").cast("int")).over(w) > most)
    r = staged(r.select("n", _first().alias("p0"), _last().alias("p1"), (F.col("whole") > 1).alias("again"), "open", "wide", F.when(F.col("open"), F.col("key")).alias("key"), F.least("whole", F.lit(2)).cast("int").alias("times")), "phrases", clean=True)
    narrow = _neighbours(_dictionary(_spans(docs, r.filter("open AND NOT wide")), width), width)
    singles = _windows(_spans(docs, r.filter("open AND wide")), width)
    singles = singles.withColumn("all", F.sum(_times()).over(W.partitionBy("g", "h"))).filter("all > 1").select("n", _first().alias("p0"), _last().alias("p1"))
    return r.filter("again").select("n", "p0", "p1").unionByName(narrow).unionByName(singles)


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", width=WIDTH, most=MOST_CONTEXTS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, kept (the remaining bytes), n_removed, n_spans, kept_sha256.

    Texts are read more than once and meet by row numbers, so the numbered texts are written once first. What a step
    shuffles goes before the next.
    """
    d = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = staged(d, "texts")
    found = staged(repeated_windows(d, width, most), "repeated", clean=True)  # few; the texts shuffled to find them go
    found = found.groupBy(F.col("n").alias("m")).agg(F.collect_list(F.struct("p0", "p1")).alias("spans"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def each(batches):
        for b in batches:
            out = []
            for text, spans in zip(_encoded(b.column("text")), b.column("spans"), strict=True):
                kept, removed, n = text, 0, 0
                if spans.is_valid and len(spans):
                    s = np.array([(x["p0"], x["p1"] + width) for x in spans.as_py()])
                    edge = np.zeros(len(text) + 1, "i8")
                    np.add.at(edge, s[:, 0], 1)
                    np.add.at(edge, s[:, 1], -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept, removed = np.frombuffer(text, "u1")[~gone].tobytes(), int(gone.sum())
                out.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = d.join(found, F.col("n") == F.col("m"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(each, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

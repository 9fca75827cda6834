"""Byte-level BPE: ranked merges folded over the distinct words of the corpus.

A piece of text is an array of hex strings, one per token. A merge looks up the concatenation of
each two neighbours in a literal rank map (an array of hash buckets, so that a look-up is one array
access), takes the least rank, leftmost first, and joins those two. Higher-order functions fold
this over the distinct pieces that are most frequent in the whole corpus, dictionary_size at most.
Documents then look their pieces up in that dictionary, distinct pieces of an Arrow batch at a time;
what it lacks is merged where it stands by the same rule, all lacking pieces at once (Merger). Both ways give the same ids, so
dictionary_size is a matter of speed alone. No text is shuffled, only counts of pieces are.

Texts are cut into pieces by the classes of their bytes, a batch at once. Words with an apostrophe
or with characters whose class is not plain from their first byte are cut by the pattern itself; a
word begins at a single space between characters that are not white space, which no match of the
pattern crosses.

Decoding takes each id's bytes and concatenates them.

Defined results: null text is empty and has no tokens; rows are independent of each other, so ids
may be null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import staged

# Unicode white space, and the splitting pattern with it spelled out.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Most entries of the dictionary, and most characters of one: together they bound what tasks receive.
DICTIONARY_SIZE, ENTRY_CHARS = 1 << 16, 48
#: Tasks that fold the dictionary: few, since each is sent the rank map.
FOLD_TASKS = 12
#: Bytes of text that a task handles at once (one text is never cut), and most pieces whose ids it keeps for the next.
AT_ONCE, REMEMBERED = 1 << 22, 1 << 17
# Bytes that are white space, and those that begin a character that may be.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MAYBE_WHITE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
# Class of a byte: white space, letter, digit, other. U+00C0 to U+024F, which begin with the bytes
# C3 to C9, are letters but for U+00D7 and U+00F7.
BYTE = np.arange(256)
KIND = np.select([WHITE, np.isin(BYTE | 32, np.arange(97, 123)) & (BYTE < 128) | (BYTE > 127), (BYTE > 47) & (BYTE < 58)], [0, 1, 2], 3).astype("u1")
# Bytes that leave a word to the pattern.
HARD = (BYTE == 39) | (BYTE == 0xC2) | (BYTE > 0xC9)
BUCKETS = 1 << 16
#: Above any rank.
NONE = 1 << 30
# Places of the merger's table of pairs, a power of two.
SLOTS = 1 << 19
# Separators inside a literal table.
ENTRY, VALUE, BUCKET = "\x01", "\x02", "\x03"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


class Lookup:
    """A literal hash table of strings: one string per bucket, in it entries between separators."""

    def __init__(self, buckets: list[str]):
        self.n = len(buckets)
        self.table = F.split(F.lit(BUCKET.join(buckets)), BUCKET)

    def get(self, table: Column, key: Column) -> Column:
        """The value of key, or an empty string. table: self.table, or a variable bound to it."""
        bucket = F.get(table, place(key, self.n))
        after = F.call_function("substring_index", bucket, F.concat(F.lit(ENTRY), key, F.lit(VALUE)), F.lit(-1))
        return F.call_function("substring_index", after, F.lit(ENTRY), F.lit(1))


def place(key: Column, n: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(n - 1).cast("long")).cast("int")


class Coder:
    """Ranks as literals, and the column expressions over them."""

    def __init__(self, ranks: dict[bytes, int], buckets: int = BUCKETS):
        import xxhash

        table = [ENTRY] * buckets
        for token, rank in ranks.items():
            key = token.hex().upper()
            table[xxhash.xxh64_intdigest(key.encode(), 42) & (buckets - 1)] += f"{key}{VALUE}{rank}{ENTRY}"
        self.ranks = Lookup(table)

    def bound(self, body) -> Column:
        """body(table) with the rank table bound once, so that the literal stands in the plan once."""
        return _let(self.ranks.table, body)

    def _rank(self, table: Column, left: Column, right: Column) -> Column:
        """The rank of two neighbours' concatenation, NONE where it has none or a neighbour is missing."""
        found = self.ranks.get(table, F.concat(left, right))
        return F.coalesce(F.when(found != "", found).cast("int"), F.lit(NONE))

    def _merge(self, table: Column, acc: Column) -> Column:
        """One merge of the leftmost two neighbours of least rank. acc: parts and, for each but the last, its rank with the next."""
        parts, ranks, nothing = acc["parts"], acc["ranks"], F.array().cast("array<int>")

        def at(k):  # ranks around place k (from 1) are looked up anew, the others kept
            joined = F.concat(F.get(parts, k - 1), F.get(parts, k))
            left = F.when(k > 1, F.concat(F.slice(ranks, F.lit(1), k - 2), F.array(self._rank(table, F.get(parts, k - 2), joined)))).otherwise(nothing)
            right = F.when(k < F.size(ranks), F.concat(F.array(self._rank(table, joined, F.get(parts, k + 1))), F.slice(ranks, k + 2, F.size(ranks)))).otherwise(nothing)
            new = F.concat(F.slice(parts, F.lit(1), k - 1), F.array(joined), F.slice(parts, k + 2, F.size(parts)))
            return F.struct(new.alias("parts"), F.concat(left, right).alias("ranks"))

        least = lambda m: F.when(m < NONE, _let(F.array_position(ranks, m).cast("int"), at)).otherwise(acc)
        return _let(F.array_min(ranks), least)

    def fold(self, table: Column, piece: Column) -> Column:
        """The ids of one piece of text, joined by spaces."""

        def folded(hexed):
            n = F.floor(F.length(hexed) / 2).cast("int")
            single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(hexed, 2 * i + 1, F.lit(2)))
            ranks = lambda p: F.transform(F.sequence(F.lit(0), n - 2), lambda i: self._rank(table, F.get(p, i), F.get(p, i + 1)))
            start = _let(single, lambda p: F.struct(p.alias("parts"), ranks(p).alias("ranks")))
            parts = F.aggregate(F.sequence(F.lit(2), n), start, lambda acc, _: F.when(F.size(acc["ranks"]) > 0, self._merge(table, acc)).otherwise(acc), lambda acc: acc["parts"])
            return F.array_join(F.transform(parts, lambda p: self.ranks.get(table, p)), " ")

        # a single byte has a rank, so that what is folded has two bytes or more
        whole = lambda k: _let(self.ranks.get(table, k), lambda r: F.when(r != "", r).otherwise(folded(k)))
        return _let(F.hex(F.encode(piece, "UTF-8")), whole)


def _word_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where words begin. at: where texts begin, and the end."""
    begins = np.zeros(len(data) + 1, bool)
    k = 3 + np.flatnonzero(data[3:-1] == 32)  # a space nearer to either end stays inside its word
    begins[k] = ~(WHITE[data[k - 1]] | WHITE[data[k + 1]] | MAYBE_WHITE[data[k + 1]] | (data[k - 2] == 0xC2) | MAYBE_WHITE[data[k - 3]])
    begins[at] = True
    begins[-1] = False
    return np.flatnonzero(begins)


def _cut_by_pattern(begins: np.ndarray, data: np.ndarray, at: np.ndarray, hard: np.ndarray) -> None:
    """Set where pieces begin in the words that have the bytes at places hard."""
    import regex

    split = regex.compile(PATTERN).findall
    starts = _word_starts(data, at)
    which = np.searchsorted(starts, hard, "right") - 1
    which = which[np.append(True, np.diff(which) > 0)]
    ends = np.append(starts, len(data))
    inside = np.zeros(len(data) + 1, "i1")
    np.add.at(inside, starts[which], 1)
    np.subtract.at(inside, ends[which + 1], 1)
    begins &= ~np.cumsum(inside, dtype="i1").astype(bool)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype("i4")), pa.py_buffer(data)).take(pa.array(which)).dictionary_encode()
    sizes = pa.array([[len(x.encode()) for x in split(w)] for w in words.dictionary.to_pylist()], pa.list_(pa.int32())).take(words.indices)
    size, n = sizes.flatten().to_numpy(), pc.list_value_length(sizes).to_numpy()
    before = np.cumsum(size) - size
    first = np.cumsum(n) - n
    begins[np.repeat(starts[which] - before[first], n) + before] = True


def _pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of all texts, and where each text's begin among them; nothing of the text is left out or copied."""
    at = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[at[0] : at[-1]]
    at = at - at[0]
    kind = KIND[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = kind[1:] != kind[:-1]
    begins[at] = True
    white = np.flatnonzero(kind[:-1] == 0)
    last = white[kind[white + 1] != 0]  # white space before another character of its text stands alone, or with it if a space
    text_starts = np.zeros(len(data) + 1, bool)
    text_starts[at] = True
    last = last[~text_starts[last + 1]]
    begins[last] = True
    begins[last[data[last] == 32] + 1] = False
    hard = HARD[data]
    hard[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    if len(hard := np.flatnonzero(hard)):
        _cut_by_pattern(begins, data, at, hard)
    begins[-1] = False
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(data)).astype("i4")
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(starts, at).astype("i4")


def piece_counts(docs: DataFrame, text_col="text") -> DataFrame:
    """(piece, n): what each slice of the texts holds; a piece has a row for every slice that has it."""

    def each(batches):
        for batch in batches:
            for b in _parts(batch, "_text"):
                values, counts = _pieces(b.column("_text"))[0].value_counts().flatten()
                short = pc.less_equal(pc.utf8_length(values), ENTRY_CHARS)
                yield pa.RecordBatch.from_arrays([values.filter(short), counts.filter(short)], ["piece", "n"])

    return docs.select(_text(text_col)).mapInArrow(each, "piece string, n long")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")


def dictionary(docs: DataFrame, coder: Coder, text_col="text", size=DICTIONARY_SIZE) -> DataFrame:
    """(piece, ids) of the most frequent distinct pieces: all that are above a level of frequency, size at most."""
    each = piece_counts(docs, text_col).groupBy("piece").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 8).cast("int")
    counted = staged(each.filter("n > 1").select("piece", level.alias("level")), "pieces")
    least, total = 1 << 10, 0
    for r in counted.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 8 levels a doubling: 504 rows at most
        total += r["n"]
        if total > size:
            break
        least = r["level"]
    frequent = counted.filter(F.col("level") >= least).repartition(FOLD_TASKS, "piece")
    return frequent.select("piece", coder.bound(lambda table: coder.fold(table, F.col("piece"))).alias("ids"))


@lru_cache(1)
def _merger_of(packed: bytes) -> Merger:
    return Merger(pickle.loads(packed))


class Merger:
    """The ids of pieces that the dictionary lacks, by numpy over all of them: one merge a round in each piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([k])] for k in range(256)], "i8")
        pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        # open addressing; a free place has key -1
        self.keys, self.to = np.full(SLOTS + len(pairs), -1, "i8"), np.full(SLOTS + len(pairs), NONE, "i8")
        for key, slot in zip(pairs, self._slot(np.array(list(pairs), "i8")).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.to[slot] = key, pairs[key]

    def __reduce__(self):
        """Only the ranks travel to the workers; each builds its table once."""
        return _merger_of, (pickle.dumps(self.ranks),)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype("i8")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = self._slot(key)
        found = self.keys[slot]
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            slot[on] += 1
            found = self.keys[slot[on]]
            on = on[(found != key[on]) & (found >= 0)]
        return np.where(self.keys[slot] == key, self.to[slot], NONE)

    def merge(self, pieces: list[bytes]) -> list[str]:
        long = [k for k, p in enumerate(pieces) if len(p) > 200]  # a round per merge would take n squared
        out = self._merge([p if len(p) <= 200 else b"." for p in pieces])
        for k in long:
            out[k] = " ".join(str(self.ranks[p]) for p in _merged_by_heap(self.ranks, [pieces[k][i : i + 1] for i in range(len(pieces[k]))]))
        for k, p in enumerate(pieces):
            if p in self.ranks:
                out[k] = str(self.ranks[p])
        return out

    def _merge(self, pieces: list[bytes]) -> list[str]:
        if not pieces:
            return []
        size, piece = np.array([len(p) for p in pieces]), np.arange(len(pieces))
        token, of = self.single[np.frombuffer(b"".join(pieces), "u1")], np.repeat(piece, size)
        rank = np.append(np.where(of[1:] == of[:-1], self._rank(token[:-1], token[1:]), NONE), NONE)
        ended = []
        while len(piece):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            each = np.repeat(least, size)
            if not (more := least < NONE).all():  # pieces that are through leave the arrays
                on = each < NONE
                ended.append((of[~on], token[~on]))
                piece, size, least, token, of, rank, each = piece[more], size[more], least[more], token[on], of[on], rank[on], each[on]
                if not len(piece):
                    break
            at = np.flatnonzero(rank == each)
            at = at[np.append(True, np.diff(of[at]) > 0)]  # the leftmost of each piece
            token[at] = rank[at]
            size -= 1
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            token, of, rank = token[stays], of[stays], rank[stays]
            at = at - np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(token) - 1)
                rank[left] = np.where((right > left) & (of[left] == of[right]), self._rank(token[left], token[right]), NONE)
        of, token = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(of, kind="stable")
        token, starts = token[order], np.searchsorted(of[order], np.arange(len(pieces)))
        offsets = np.append(starts, len(token)).astype("i4")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pa.array(token).cast(pa.string())), " ").to_numpy(zero_copy_only=False).tolist()


def _merged_by_heap(ranks: dict[bytes, int], part: list) -> list[bytes]:
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, t) for k in range(n - 1) if (r := ranks.get(t := part[k] + part[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, token = heapq.heappop(heap)
        j = after[k]
        if part[k] is None or j >= n or part[k] + part[j] != token:
            continue
        part[k], part[j], after[k] = token, None, after[j]
        if after[j] < n:
            before[after[j]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right < n and (r := ranks.get(t := part[left] + part[right])) is not None:
                heapq.heappush(heap, (r, left, t))
    return [p for p in part if p is not None]


def _parts(batch: pa.RecordBatch, column: str) -> list[pa.RecordBatch]:
    """The batch in slices of about AT_ONCE bytes of a column; one row is never cut."""
    cuts, held = [0], 0
    for k, w in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + w > AT_ONCE:
            cuts.append(k)
            held = 0
        held += w
    return [batch.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True) if b > a]


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col="doc_id", text_col="text", carry=(), size=DICTIONARY_SIZE) -> DataFrame:
    """One row per row of docs: doc_id, what carry names, and ids joined by spaces."""
    d = docs.select(F.col(id_col).alias("doc_id"), *carry, _text(text_col))
    each = _encoder(d, ranks, size)
    return d.mapInArrow(each, d.drop("_text").schema.add("ids", "string"))


def _encoder(d: DataFrame, ranks: dict[bytes, int], size: int):
    """What makes of batches with a column _text batches with ids in its place, as the last column."""
    found = dictionary(d, Coder(ranks), "_text", size).select("piece", "ids").toArrow()  # bounded by size and ENTRY_CHARS
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as stream:
        stream.write_table(found)
    packed, merger = sink.getvalue().to_pybytes(), Merger(ranks)
    names = [c for c in d.columns if c != "_text"]

    def each(batches):
        table, seen = pa.ipc.open_stream(packed).read_all(), {}
        known = dict(zip(table.column("piece").to_pylist(), table.column("ids").to_pylist(), strict=True))
        for batch in batches:
            for b in _parts(batch, "_text"):
                pieces, starts = _pieces(b.column("_text"))
                found = pieces.dictionary_encode()
                distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
                ids = [known.get(p) or seen.get(p) for p in distinct]
                lack = [k for k, of in enumerate(ids) if of is None]
                for k, of in zip(lack, merger.merge([distinct[k].encode() for k in lack]), strict=True):
                    ids[k] = of
                    if len(seen) < REMEMBERED and len(distinct[k]) <= ENTRY_CHARS:
                        seen[distinct[k]] = of
                line = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), pa.array(ids, pa.string()).take(found.indices)), " ")
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), line], [*names, "ids"])

    return each


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col="ids") -> DataFrame:
    """encoded with its column of ids, joined by spaces, and a further column decoded: their bytes."""
    return encoded.mapInArrow(_decoder(ranks, ids_col), StructType([*encoded.schema, StructField("decoded", BinaryType())]))


def _decoder(ranks: dict[bytes, int], ids_col: str):
    def each(batches):
        by_rank = {r: t for t, r in ranks.items()}
        tokens = pa.array([by_rank.get(k, b"") for k in range(max(by_rank) + 1)], pa.binary())
        for batch in batches:
            for b in _parts(batch, ids_col):
                split = pc.split_pattern(b.column(ids_col), " ")
                numbers = pc.if_else(pc.equal(split.flatten(), ""), None, split.flatten()).cast(pa.int32())
                found = pc.fill_null(tokens.take(numbers), b"")
                whole = pc.binary_join(pa.ListArray.from_arrays(pc.subtract(split.offsets, split.offsets[0]), found), b"")
                yield pa.RecordBatch.from_arrays([*b.columns, whole], [*b.schema.names, "decoded"])

    return each


def digests(docs: DataFrame, ranks: dict[bytes, int], id_col="doc_id", text_col="text", size=DICTIONARY_SIZE) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes decoded from the ids).

    Encodes, decodes and hashes in one pass, so that neither ids nor decoded bytes leave the task.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), _text(text_col))
    encoder, decoder = _encoder(d, ranks, size), _decoder(ranks, "ids")

    def each(batches):
        from hashlib import sha256

        for b in decoder(encoder(batches)):
            ids = b.column("ids")
            n = pc.if_else(pc.equal(ids, ""), 0, pc.add(pc.count_substring(ids, " "), 1)).cast(pa.int64())
            hashed = [pa.array([sha256(x.as_buffer()).hexdigest() for x in c], pa.string()) for c in (ids, b.column("decoded"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, *hashed], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return d.mapInArrow(each, d.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))

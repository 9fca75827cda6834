"""Token counts by heap-and-linked-list byte-pair merging, for a vocabulary of lower-cased words.

A text is cut at the strings of special tokens, each of which is one token. What lies between is
normalised (NFC, lower case) and cut into words, white space dropped. A word starts as one symbol a
byte, the last with the mark of a word's end. A heap holds each adjacent pair that has a merge, by
(rank, place); the least is popped, its two symbols become one in a linked list, and the pairs on
either side enter the heap. Pairs that changed since they entered are skipped. The word's tokens are
its symbols less the merges done; no identifiers are made.

One narrow stage: no text is shuffled. A worker remembers the counts of short words (REMEMBERED of
them, then it starts afresh), so a frequent word is merged once a worker; long words are merged where
they stand, in n log n.

Defined results: null text is empty and has no tokens; a row depends on no other, so ids may be null
or repeated; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most words, and most strings between white space, whose count a worker remembers, and most characters of one.
REMEMBERED, WORD_CHARS = 1 << 18, 48
#: Tokens that a document may have.
LIMIT = 2048
#: Words of the vocabulary's own splitting pattern; white space is what Unicode calls so.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Capital sigma, and letters whose lower case came after this Python's tables.
NEWER = {0x03A3: 0x03C3, 0xA7CB: 0x0264, 0xA7DC: 0x019B}
#: What str.split() takes for white space and Unicode does not.
SPLIT_MORE = frozenset("\x1c\x1d\x1e\x1f")


def read_merges(path: str) -> tuple[dict[int, int], list[int], list[int], list[str]]:
    """Of a tokenizer's JSON: (left << 32 | right) to (rank << 32 | merged); the symbol of each byte, and of each as a word's last; special strings."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    vocab, end = told["model"]["vocab"], told["model"].get("end_of_word_suffix") or ""
    pairs = (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"])
    # a merged symbol is written as its parts joined; the mark stands on the last only
    table = {vocab[a] << 32 | vocab[b]: rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
    # printable bytes stand for themselves, the others for characters from 256 on, in their order
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    char = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
    return table, [vocab[c] for c in char], [vocab[c + end] for c in char], [t["content"] for t in told["added_tokens"]]


def count_word(word: bytes, table: dict[int, int], symbol: list[int], last_symbol: list[int]) -> int:
    """Tokens of one word: its bytes less the merges that the heap allows."""
    n = len(word)
    if n < 2:
        return n
    ids = [symbol[b] for b in word[:-1]] + [last_symbol[word[-1]]]
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(m >> 32) << 32 | i for i in range(n - 1) if (m := table.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        at = heapq.heappop(heap)
        rank, i = at >> 32, at & 0xFFFFFFFF
        j = after[i]
        if ids[i] < 0 or j < 0:
            continue
        m = table.get(ids[i] << 32 | ids[j])
        if m is None or m >> 32 != rank:  # another pair stands here now
            continue
        ids[i], ids[j] = m & 0xFFFFFFFF, -1
        k = after[i] = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (m := table.get(ids[i] << 32 | ids[k])) is not None:
                heapq.heappush(heap, (m >> 32) << 32 | i)
        h = before[i]
        if h >= 0 and (m := table.get(ids[h] << 32 | ids[i])) is not None:
            heapq.heappush(heap, (m >> 32) << 32 | h)
    return left


class Counts(dict):
    """Counts of the keys met, short ones remembered; count gives the others."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(key) <= WORD_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = n
        return n


def _counting(merges) -> Counts:
    """Counts of strings without white space: each is normalised and cut into words, whose counts are added. Neither crosses white space."""
    import regex

    word = Counts(lambda w: count_word(w.encode(), *merges[:3])).__getitem__
    words = regex.compile(WORDS)
    return Counts(lambda part: sum(map(word, words.findall(_lower(part)))))


#: Of this worker, kept from task to task: the merges that came with the task, and counts under them.
_held: list = [None, None]


def _counts(merges) -> Counts:
    if _held[0] is not merges:
        _held[:] = merges, _counting(merges)
    return _held[1]


def _lower(part: str) -> str:
    """NFC, then lower case letter by letter: a sigma is never a final one."""
    if part.isascii():
        return part.lower()
    return unicodedata.normalize("NFC", part).translate(NEWER).lower()


def token_count(docs: DataFrame, text: str, merges) -> Column:
    """Column with the tokens of each text of docs."""
    import regex

    shared = docs.sparkSession.sparkContext.broadcast(merges)
    special = "|".join(map(regex.escape, sorted(merges[3], key=len, reverse=True))) or r"(?!)"

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _counts(shared.value).__getitem__
        marks, gaps = regex.compile(special), regex.compile(r"\p{White_Space}+")
        for batch in batches:
            out = []
            for t in batch:
                parts = marks.split(t.as_py() or "")
                n = len(parts) - 1
                for part in parts:
                    n += sum(map(known, part.split() if SPLIT_MORE.isdisjoint(part) else gaps.split(part)))
                out.append(n)
            yield pa.array(out, pa.int64())

    return count(F.col(text).cast("string"))


def count_tokens(docs: DataFrame, merges, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    d = d.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_count(d, "text", merges).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)

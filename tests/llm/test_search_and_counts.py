"""Ranked search against scores of all documents; token counts against the tokenizer library."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import ranked_search as R
from lodestone.llm import token_counts as T

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top=10):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for doc, w in held:
            m = 25 + (75 * len(w) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in terms(text) if t in w)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out)


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7)) % 300}" for _ in range(2000)] + ["Été", "naïve", "ÜBER", "Z"]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 40, 200])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "--- !"), (None, "w1 w2 w3"), (0, docs[0][1]), (n + 3, "w7 " * 5000)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.choice([1, 3, 12])))) for k in range(25)] + [(90, None), (91, "nowhere"), (92, "w1 w1 W1, z été ÉTÉ")]
    return docs, items


@pytest.mark.parametrize("shard", [dict(), dict(shard_docs=40), dict(shard_terms=700)])
def test_search_is_scoring_of_all(spark, shard):
    docs, items = corpus(600, 3)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = R.build_index(d.selectExpr("*", "1 AS shard", "2 AS term"), **shard)
    got = R.search(index, q.selectExpr("*", "1 AS score"), item_bytes=200 if shard else R.ITEM_BYTES)
    assert sorted(map(tuple, got.collect())) == ranked(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(5, 1)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert R.search(R.build_index(d.limit(0)), q).count() == 0
    assert R.search(R.build_index(d), q.limit(0)).count() == 0
    assert R.search(R.build_index(d.filter("text = ''")), q).count() == 0


def test_packing_and_fronts():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 5])
    data, size = R.pack(v)
    assert (R.unpack(data) == v).all() and size.tolist() == [1, 1, 1, 2, 2, 3, 5, 1]


def test_blocks_under_the_bound_stay_packed():
    """A common list beside a rare one: most of its blocks are never decompressed, with the same top."""
    n = 40_000
    draw = random.Random(2)
    length = np.array([draw.choice([5, 50]) for _ in range(n)], np.int64)
    schema = pa.schema([("shard", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("lengths", "last", "ends", "front", "front_ends", "data")]])
    codes = [np.array([0] * int(k - 1) + [1 if i % 1000 == 7 else 0]) for i, k in enumerate(length)]
    rows = [r for b in R._invert("0", pa.array(range(n)), length.tolist(), codes, [b"common", b"rare"], schema) for r in b.to_pylist()]
    whole = lambda x: 25 + 75 * n * x // int(length.sum())
    lists = [(R.Postings(r, {b"common": 3, b"rare": 9000}[r["term"]], whole(length), whole), 1) for r in rows[1:]]
    docs, scores = R.best(lists, n, top=3)
    common = 3 * R.impact(np.array([np.sum(c == 0) for c in codes]), whole(length))
    rare = 9000 * R.impact(np.array([np.sum(c == 1) for c in codes]), whole(length))
    want = np.sort(common + rare)[::-1][:3]
    assert np.sort(scores)[::-1][:3].tolist() == want.tolist()
    assert lists[0][0].decompressed < len(lists[0][0].last) / 5


TEXTS = [
    None, "", " \t\n", "Hello, World!", "don't WE'LL 'sun", "a" * 20_000, "<|endoftext|>x<|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ. İstanbul ß", "12345 ½ ٣٤", "é é ﬁ Å",
    "x\x1c\x1dy\x85z　", "日本語 のテキスト 🎉🎉👩‍👩‍👧", "}{" * 3000, "<|endof", "İ̇", "ￂﾡ", "ẞ Ɤ Ƛ",
]


def library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    return T.read_merges(path), lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


def test_counts_are_the_librarys(spark):
    merges, theirs = library()
    docs = TEXTS + [c for c in (f"ab{chr(c)}Cd {chr(c)}' 1{chr(c)}" for c in range(0, 0x30000, 37) if not 0xD800 <= c < 0xE000)]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(docs)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS n_bytes")
    got = T.count_tokens(d, merges).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((i, len((t or "").encode()), theirs(t), theirs(t) > 2048) for i, t in rows), key=key)
    assert T.count_tokens(d.limit(0), merges).count() == 0


def test_remembered_words_are_bounded(monkeypatch):
    merges, theirs = library()
    monkeypatch.setattr(T, "REMEMBERED", 3)
    known = T._counting(merges)
    words = [f"Word{i}.é" for i in range(20)] * 2
    assert [known[w] for w in words] == [theirs(w) for w in words]
    assert len(known) <= 3

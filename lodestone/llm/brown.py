"""Class-based bigram language model.

Exchange clustering: words move to the class that raises the likelihood of the class bigrams most.
First the most frequent words are exchanged one by one on a matrix of fixed size; then all others are
placed, and all are exchanged again, in blocks: rows of (word, class beside it, count) are dealt out
by word, tasks find each word's best class against the classes x classes matrix, and the classes of the
other blocks stand still meanwhile. A block's moves that would lower the likelihood are taken back.
Words past frequent_words are placed in the same way, as rows of a table that stays in Spark. The
driver holds the matrix and one class for each of the frequent words, however large the input.
A text's probability is the product of class transitions and word emissions, both smoothed.

Counts of all words come from a shuffle. The frequent_words most frequent ones are known to every
task; occurrences of the others are joined with the counts and classes.

Defined results: a null or empty text is its end token alone; the end token is the empty word and
stands before each text too; a null id counts as an empty one (held out); repeated rows are scored
one by one; a word that training never saw has a class of its own; further columns are not looked at;
an empty table gives no rows; without training texts all counts are 0.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

CLASSES, LEADING_WORDS, FREQUENT_WORDS, PASSES, BLOCKS, ADD, PRIOR = 64, 4096, 1 << 18, 3, 4, 0.1, 50.0
#: Rows or words that a task holds before it passes them on.
FLUSH, CHUNK, SHARE = 400_000, 256, 1e-5
#: Classes after the exchanged ones: words not placed yet, words that training never saw, the end.
WAITING, UNSEEN, END, MORE = 0, 1, 2, 3


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _bytes() -> Column:
    return F.col("text").cast("string").cast("binary").alias("text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word and the end (an empty word) stand in docs (text)."""

    def each(batches):
        found = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])
        for b in batches:
            for x in b.column(0):
                found.update(_words(x.as_py()))
                found[b""] += 1
                if len(found) > FLUSH:
                    yield table()
                    found.clear()
        yield table()

    return docs.select(_bytes()).mapInArrow(each, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _coded(docs: DataFrame, index, m: int) -> DataFrame:
    """Each text as int32 numbers: frequent words by rank, m for any other (listed in rare, in order), the end last."""

    def each(batches):
        known = index.value
        end = known.get(b"", m + 1)
        for b in batches:
            ids, rare = [], []
            for x in b.column("text"):
                words = _words(x.as_py())
                got = np.fromiter(map(known.get, words, repeat(m)), "<i4", len(words))
                rare.append([words[i] for i in np.flatnonzero(got == m).tolist()])
                ids.append(np.append(got, np.int32(end)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("n"), b.column("doc_id"), b.column("held_out"), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], ["n", "doc_id", "held_out", "ids", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("n", "doc_id", "held_out", _bytes()).mapInArrow(each, f"n long, doc_id {kind}, held_out boolean, ids binary, rare array<binary>")


def _joined(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a batch of texts one after the other, and where each text starts."""
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], "u1")[ends[0] : ends[-1]]
    return data.view("<i4"), (ends[:-1] - ends[0]).astype("i8") // 4


def _beside(c: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and after each place; the end stands around every text."""
    before, after = np.append(end, c[:-1]), np.append(c[1:], end)
    before[starts] = end
    after[starts[1:] - 1] = end
    return before, after


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, weights=np.concatenate(counts), minlength=len(k)).astype("i8")


def class_pairs(coded: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """How often a class follows another in the training texts; a matrix of fixed size. Where coded has them, classes of rare words are in the column placed."""
    a, end, wide = classes + MORE, classes + END, "placed" in coded.columns

    def each(batches):
        total = np.zeros(a * a, "i8")
        for b in batches:
            if not len(b):
                continue
            ids, starts = _joined(b.column(0))
            c = of[ids]
            if wide:
                c[ids == len(of) - 2] = b.column(1).flatten().to_numpy()
            before = np.append(end, c[:-1])
            before[starts] = end
            total += np.bincount(before * a + c, minlength=a * a)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = coded.filter("not held_out").select("ids", *["placed"] * wide).mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(a * a)
    total[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return total.reshape(a, a)


def neighbours(coded: DataFrame, of: np.ndarray, classes: int, block: int, blocks: int, leading: int = 0) -> DataFrame:
    """(word, at, n) over the training texts: how often class at (or, from classes + MORE on, after it) stands before word; of the words of a block, or of the leading ones only."""
    a, end, known = classes + MORE, classes + END, len(of) - 2

    def each(batches):
        keys, counts, held = [], [], 0
        rows = lambda k, n: pa.RecordBatch.from_arrays([pa.array((k // (2 * a)).astype("i4")), pa.array((k % (2 * a)).astype("i4")), pa.array(n)], ["word", "at", "n"])
        for b in batches:
            if not len(b):
                continue
            ids, starts = _joined(b.column(0))
            before, after = _beside(of[ids], starts, end)
            mine = ids < leading if leading else (ids < known) & (ids % blocks == block)
            w = ids[mine].astype("i8") * (2 * a)
            k, n = np.unique(np.concatenate([w + before[mine], w + a + after[mine]]), return_counts=True)
            keys, counts, held = [*keys, k], [*counts, n], held + len(k)
            if held > 10 * FLUSH:
                k, n = _added(keys, counts)
                keys, counts, held = [k], [n], len(k)
                if held > 5 * FLUSH:
                    yield rows(k, n)
                    keys, counts, held = [], [], 0
        if held:
            yield rows(*_added(keys, counts))

    return coded.filter("not held_out").select("ids").mapInArrow(each, "word int, at int, n long")


def rare_neighbours(coded: DataFrame, of: np.ndarray, classes: int) -> DataFrame:
    """The same for words that are not among the frequent ones: word binary. Counted in each batch, then dealt out by word; best_classes() adds up what batches have of a word, since few of these rows are alike."""
    a, end, known = classes + MORE, classes + END, len(of) - 2

    def each(batches):
        for b in batches:
            if not len(b):
                continue
            ids, starts = _joined(b.column(0))
            before, after = _beside(of[ids], starts, end)
            mine = ids == known
            words = b.column(1).flatten().dictionary_encode()
            w = words.indices.to_numpy().astype("i8") * (2 * a)
            k, n = np.unique(np.concatenate([w + before[mine], w + a + after[mine]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(k // (2 * a))), pa.array((k % (2 * a)).astype("i4")), pa.array(n)], ["word", "at", "n"])

    rows = coded.filter("not held_out and size(rare) > 0").select("ids", "rare").mapInArrow(each, "word binary, at int, n long")
    return rows.repartition("word")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """Of the class bigrams, up to what does not depend on classes."""
    return float(_f(pairs).sum() - _f(pairs.sum(0)).sum() - _f(pairs.sum(1)).sum())


def _twice(x: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    """What a class followed by itself adds where a word brings it neighbours on both sides."""
    return _f(x + l + r) - _f(x + l) - _f(x + r) + _f(x)


def gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, pairs: np.ndarray, classes: int) -> np.ndarray:
    """(words, classes): what the likelihood gains where a word, taken out of its own class, joins a class."""
    out, same = np.zeros((len(own), classes)), np.arange(classes)
    for k in range(0, len(own), CHUNK):
        l, r, o = left[k : k + CHUNK], right[k : k + CHUNK], own[k : k + CHUNK]  # noqa: E741
        p = np.repeat(pairs[None], len(o), 0)
        i = np.arange(len(o))
        p[i, :, o] -= l
        p[i, o, :] -= r
        p = np.maximum(p, 0)  # a word beside itself is counted on both sides
        cols, rows = p[:, :, :classes], p[:, :classes, :]
        came, went, n = cols.sum(1) + r[:, :classes], rows.sum(2) + l[:, :classes], l.sum(1)[:, None]  # the words beside it stay
        gain = (_f(cols + l[:, :, None]) - _f(cols)).sum(1) + (_f(rows + r[:, None, :]) - _f(rows)).sum(2)
        gain += _twice(p[:, same, same], l[:, :classes], r[:, :classes])
        out[k : k + CHUNK] = gain - (_f(came + n) - _f(came)) - (_f(went + n) - _f(went))
    return out


def best_classes(rows: DataFrame, of: np.ndarray | None, pairs: np.ndarray, classes: int) -> DataFrame:
    """rows (word, at, n; the same word and at more than once adds up), dealt out by word, to (word, c, class): each word's count and best class, its own (of, else none) where no other is better. A task holds few words at once.

    Gains are those of the first order, against the matrix as it is; of words that make up more than SHARE of
    all tokens, of which there are few at any size, the exact ones.
    """
    a, total = classes + MORE, pairs.sum()
    log = lambda x: np.log(np.maximum(x, 1))
    to_class, from_class = log(pairs[:, :classes]), log(pairs[:classes, :].T)
    alone = log(pairs.sum(0)[:classes]) + log(pairs.sum(1)[:classes])

    def found(word, at, n):
        code = word.dictionary_encode()
        place = code.indices.to_numpy().astype("i8") * (2 * a) + at
        count = np.bincount(place, weights=n, minlength=len(code.dictionary) * 2 * a).reshape(-1, 2 * a)
        own = of[code.dictionary.to_numpy()] if of is not None else np.full(len(count), classes + WAITING)
        left, right = count[:, :a], count[:, a:]
        g = (left @ to_class + right @ from_class) - left.sum(1)[:, None] * alone
        heavy = np.nonzero(left.sum(1) > SHARE * total)[0]
        g[heavy] = gains(left[heavy], right[heavy], own[heavy], pairs, classes)
        new = g.argmax(1)
        i = np.nonzero(own < classes)[0]
        stay = i[g[i, new[i]] <= g[i, own[i]] + 1e-9]
        new[stay] = own[stay]
        return pa.RecordBatch.from_arrays([code.dictionary, pa.array(left.sum(1).astype("i8")), pa.array(new.astype("i4"))], ["word", "c", "class"])

    def each(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([*([rest] if rest else []), b]).combine_chunks()
            if not len(t):
                continue
            word = t.column("word").combine_chunks()
            last = word.index(word[-1]).as_py() if len(word) else 0
            if last:
                yield found(word.slice(0, last), t.column("at").to_numpy()[:last], t.column("n").to_numpy()[:last])
            rest = t.slice(last).to_batches()[0]
        if rest is not None:
            yield found(rest.column("word"), rest.column("at").to_numpy(), rest.column("n").to_numpy())

    kind = rows.schema["word"].dataType.simpleString()
    return rows.sortWithinPartitions("word").mapInArrow(each, f"word {kind}, c long, class int")


def exchange(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, of: np.ndarray, movable: np.ndarray, classes: int) -> int:
    """Move each word to its best class, in order of frequency; changes of and pairs; returns the number of moves."""
    moves = 0
    for w in movable:
        l, r, n, old = left[w], right[w], left[w].sum(), of[w]  # noqa: E741
        if not n:
            continue
        pairs[:, old] -= l
        pairs[old, :] -= r
        cols, rows = pairs[:, :classes], pairs[:classes, :]
        gain = (_f(cols + l[:, None]) - _f(cols)).sum(0) + (_f(rows + r[None, :]) - _f(rows)).sum(1)
        gain += _twice(pairs.diagonal()[:classes], l[:classes], r[:classes])
        came, went = cols.sum(0) + r[:classes], rows.sum(1) + l[:classes]  # the words beside it stay
        gain -= _f(came + n) - _f(came) + _f(went + n) - _f(went)
        new = int(np.argmax(gain))
        if gain[new] <= gain[old] + 1e-9:
            new = old
        pairs[:, new] += l
        pairs[new, :] += r
        of[w], moves = new, moves + (new != old)
    return moves


def cluster(coded: DataFrame, m: int, stop: int, classes=CLASSES, leading=LEADING_WORDS, passes=PASSES, blocks=BLOCKS, told: list | None = None) -> np.ndarray:
    """The class of each of m frequent words; two more entries stand for words that are not among them and for an end that training lacks. stop: the end's place. told: gets the likelihood after each step."""
    return clustered(coded, m, stop, classes, leading, passes, blocks, told)[0]


def clustered(coded: DataFrame, m: int, stop: int, classes: int, leading: int, passes: int, blocks: int, told: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The classes of cluster() and the class bigrams under them. What a step shuffles goes before the next."""
    moving = min(leading, m)
    of = np.full(m + 2, classes + WAITING, "i8")
    of[:moving] = np.arange(moving) % classes
    of[[stop, m + 1]] = classes + END
    movable = np.array([i for i in range(moving) if i != stop], "i8")
    a = classes + MORE
    for _ in range(passes):
        rows = neighbours(coded, of, classes, 0, 1, moving).groupBy("word", "at").agg(F.sum("n").alias("n"))
        rows = staged(rows, "leading-words", clean=True).toArrow()  # of fixed size
        count = np.zeros((moving, 2 * a))
        count[rows.column("word").to_numpy(), rows.column("at").to_numpy()] = rows.column("n").to_numpy()
        pairs = class_pairs(coded, of, classes)
        if told is not None:
            told.append(likelihood(pairs))
        if not len(movable) or not exchange(count[:, :a], count[:, a:], pairs.copy(), of, movable, classes):
            break
    pairs = class_pairs(coded, of, classes)
    for block in range(blocks):
        r = best_classes(neighbours(coded, of, classes, block, blocks).repartition("word"), of, pairs, classes)
        r = staged(r, "block", clean=True).toArrow()  # a row for each frequent word of the block
        w, c = r.column("word").to_numpy(), r.column("class").to_numpy()
        new = of.copy()
        new[w[w != stop]] = c[w != stop]
        after = class_pairs(coded, new, classes)
        placing = (of[w] == classes + WAITING).any()  # before it is placed, a word belongs to a class that is none
        if placing or likelihood(after) >= likelihood(pairs):
            of, pairs = new, after
        if told is not None:
            told.append(likelihood(pairs))
    return of, pairs


def tables(pairs: np.ndarray, in_class: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the transitions between classes, and of what a word's count + ADD is divided by in its class."""
    chance = in_class + 1
    chance[len(in_class) - MORE + WAITING] = 0
    chance = chance / chance.sum()
    with np.errstate(divide="ignore"):
        moves = np.log10((pairs + PRIOR * chance[None, :]) / (pairs.sum(1) + PRIOR)[:, None])
        below = np.log10(in_class + ADD * kinds)
    return moves, below


def score(docs: DataFrame, id_col="doc_id", text_col="text", classes=CLASSES, leading_words=LEADING_WORDS, frequent_words=FREQUENT_WORDS, passes=PASSES, blocks=BLOCKS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    d = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = staged(word_counts(d.filter("not held_out")), "words", clean=True)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    is_end = F.length("word") == 0
    top = counts.filter(~is_end).orderBy(F.desc("c"), "word").limit(frequent_words).toArrow()  # of bounded size
    words, c = [bytes(x) for x in top.column("word").to_pylist()], top.column("c").to_numpy().astype(float)
    for r in counts.filter(is_end).collect():  # the end is always among the known words
        words, c = [*words, b""], np.append(c, r["c"])
    m, a = len(words), classes + MORE
    stop = m - 1 if m and words[-1] == b"" else m + 1
    index = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    coded = staged(_coded(d, index, m), "coded")
    del words, top
    of, pairs = clustered(coded, m, stop, classes, leading_words, passes, blocks)

    kinds, in_class = np.bincount(of[:m], minlength=a).astype(float), np.bincount(of[:m], weights=c, minlength=a)
    if total["v"] > m:
        rare = staged(best_classes(rare_neighbours(coded, of, classes), None, pairs, classes), "rare-words", clean=True)
        for r in rare.groupBy("class").agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect():  # a row a class
            kinds[r["class"]] += r["v"]
            in_class[r["class"]] += r["c"]
        at = coded.select("n", F.posexplode("rare").alias("k", "word")).join(rare.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
        at = at.groupBy(F.col("n").alias("_n")).agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("class", F.lit(classes + UNSEEN)).alias("class"), F.coalesce("c", F.lit(0)).alias("c")))).alias("at"))
        at = at.select("_n", F.col("at.class").alias("placed"), F.col("at.c").alias("counted"))
        coded = coded.drop("rare").join(at, F.col("n") == F.col("_n"), "left")
    else:
        each_rare = lambda x, kind: F.transform("rare", lambda w: F.lit(x).cast(kind))
        coded = coded.select("*", each_rare(classes + UNSEEN, "int").alias("placed"), each_rare(0, "long").alias("counted"))
    kind = d.schema["doc_id"].dataType.simpleString()
    coded = staged(coded.select("doc_id", "held_out", "ids", "placed", "counted"), "placed", clean=True)
    moves, below = tables(class_pairs(coded, of, classes), in_class, kinds)
    base_below = float(np.log10(total["n"] + ADD * (total["v"] + 1)))
    c = np.append(c, [0, 0])
    unseen, end = classes + UNSEEN, classes + END

    def each(batches):
        for b in batches:
            out = []
            for x, p, q in zip(b.column("ids"), b.column("placed"), b.column("counted"), strict=True):
                ids = np.frombuffer(x.as_py(), "<i4")
                k, n, other = of[ids], c[ids], ids == m
                if p.is_valid:
                    k[other], n[other] = p.values.to_numpy(), q.values.to_numpy()
                own = np.log10(n + ADD)
                emitted = np.where(n > 0, own - below[k], 0)  # what training never saw is all of its class
                before = np.append(end, k[:-1])
                out.append((len(ids), int((n > 0).sum()), own.sum() - len(ids) * base_below, moves[before, k].sum() + emitted.sum()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *(pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = coded.mapInArrow(each, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total["n"])).cast("long").alias("train_tokens"), "base_score", "score")

"""Cropped or edited copies of images by local descriptors.

Corners are found at several scales; around each one the direction of its intensity centroid is
taken, and binary tests turned by it make a 192-bit descriptor. Descriptors are joined in a Hamming
table: cut into six words, two that differ in at most five bits agree in one of them. Matched
descriptors vote for the place, scale and turn of one image in the other; where enough different
corners agree, one is a copy of the other.

Images with equal pixels are one class. Classes that nearly equal an earlier one (most corners of both at
the same places with like descriptors) are members of its group, which is found through it first, so
that neither copies nor near copies cost pairs: each descriptor meets one leader, not its bucket. All
members are searched too, each by those queries only that have not found its group by then, so that
no group is lost of which only a member matches.
Images searched for are described at more scales and turns than stored ones, so that an edit between
the stored scales is found too; that costs rows for queries only.

Pairs of descriptors within EXACT bits are all found; those up to RADIUS bits wherever a word agrees.

Defined results: a null or empty image has no corners and matches nothing (all of them are one
class); an image too small for a patch has none either; repeated rows share their class; null ids
are carried, and are no queries; further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Scales of stored images in octaves, and of searched ones: their differences are an eighth apart.
STORED, SEARCHED = (0.0, 0.375), tuple(k / 8 for k in range(-4, 5))
#: Turns in radians that searched descriptors are taken at besides their own direction.
OFFSETS = (-0.08, 0.0, 0.08)
PATCH, BITS, EXACT, RADIUS, MIN_VOTES = 18, 192, 5, 12, 3
THRESHOLD, APART = 0.025, 2
#: Share of the corners of each of two images that the other has too, if one is to stand for both.
ALIKE = 0.5
#: Rounds in which classes that only members are like find leaders among themselves.
ROUNDS = 4
#: Words of a descriptor whose table is joined at once: each row is shuffled once for each word.
WORD_ROUNDS = ((0, 1), (2, 3), (4, 5))
#: Members of a group whose descriptors of one word are a row.
SHARE = 1024
#: Images described together; bounds a task's memory.
STACK = 16
#: A corner's place in one long: x and y from the image's middle in eighths of a pixel, number of the scale, direction in parts of FINE.
X, Y, SCALE, FINE, MIDDLE = 40, 20, 12, 4096, 1 << 16


def _tests() -> np.ndarray:
    """Pairs of points (BITS, 2, 2) within the patch, at least half its radius apart, from a fixed seed."""
    p = np.random.default_rng(7).normal(0, PATCH / 2, (40 * BITS, 2, 2))
    good = (np.hypot(p[..., 0], p[..., 1]) <= PATCH).all(1) & (np.hypot(*(p[:, 0] - p[:, 1]).T) >= PATCH / 2)
    return p[good][:BITS].astype("f4")


TESTS = _tests()
_DISC = np.array([(a, b) for a in range(-PATCH, PATCH + 1, 2) for b in range(-PATCH, PATCH + 1, 2) if a * a + b * b <= PATCH * PATCH])


def _smooth(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, ((0, 0), (2, 2), (2, 2)), mode="edge")
    p = (p[:, :, :-4] + 4 * p[:, :, 1:-3] + 6 * p[:, :, 2:-2] + 4 * p[:, :, 3:-1] + p[:, :, 4:]) / 16
    return (p[:, :-4] + 4 * p[:, 1:-3] + 6 * p[:, 2:-2] + 4 * p[:, 3:-1] + p[:, 4:]) / 16


@lru_cache(256)
def _weights(new: int, old: int) -> np.ndarray:
    """Bilinear weights (new, old) of one side."""
    at = np.linspace(0, old - 1, new)
    return np.maximum(0, 1 - abs(at[:, None] - np.arange(old)[None, :])).astype("f4")


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, of one image or a stack."""
    return _weights(h, x.shape[-2]) @ x.astype("f4") @ _weights(w, x.shape[-1]).T


def _highest(r: np.ndarray, n: int) -> np.ndarray:
    """Greatest of the square of 2n + 1 pixels around each inner pixel."""
    h, w = r.shape[1] - 2 * n, r.shape[2] - 2 * n
    rows = np.maximum.reduce([r[:, k : k + h] for k in range(2 * n + 1)])
    return np.maximum.reduce([rows[:, :, k : k + w] for k in range(2 * n + 1)])


def _sample(x: np.ndarray, n: np.ndarray, y: np.ndarray, q: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The binary tests at corners (y, q) of images n, turned; values between pixels are bilinear."""
    h, w = x.shape[1:]
    a, b = np.cos(turn).astype("f4")[:, None, None], np.sin(turn).astype("f4")[:, None, None]
    px, py = a * TESTS[:, :, 0] - b * TESTS[:, :, 1] + q[:, None, None].astype("f4"), b * TESTS[:, :, 0] + a * TESTS[:, :, 1] + y[:, None, None].astype("f4")
    ix, iy = np.minimum(px.astype("i4"), w - 2), np.minimum(py.astype("i4"), h - 2)
    fx, fy, flat = px - ix, py - iy, x.ravel()
    at = (n[:, None, None] * h + iy) * w + ix
    v = (flat[at] * (1 - fx) + flat[at + 1] * fx) * (1 - fy) + (flat[at + w] * (1 - fx) + flat[at + w + 1] * fx) * fy
    return np.packbits(v[:, :, 0] < v[:, :, 1], axis=1).view("<i8")


def describe(stack: np.ndarray, octaves=STORED, offsets=(0.0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners of a stack of images of one shape: number of the image, place, and (n, 3) longs of the descriptor."""
    out = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros((0, BITS // 64), "i8"))]
    for number, octave in enumerate(octaves):
        scale = 2.0**octave
        h, w = int(stack.shape[1] / scale), int(stack.shape[2] / scale)
        if min(h, w) < 2 * PATCH + 5:
            continue
        x = _smooth(_smooth(stack.astype("f4") if octave == 0 else resize(stack, h, w)))
        spread = x.std((1, 2), keepdims=True)
        gy, gx = np.gradient(x / np.where(spread > 0, spread, 1), axis=(1, 2))
        a, b, c = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        r = a * b - c * c - 0.04 * (a + b) ** 2
        m = PATCH + 1
        core = r[:, m : h - m, m : w - m]
        peak = (core == _highest(r[:, m - APART : h - m + APART, m - APART : w - m + APART], APART)) & (core > THRESHOLD * np.maximum(r.max((1, 2), keepdims=True), 1e-9))
        n, y, q = np.nonzero(peak)
        if not len(n):
            continue
        y, q = y + m, q + m
        block = x[n[:, None], y[:, None] + _DISC[:, 0], q[:, None] + _DISC[:, 1]]
        turn = np.arctan2((block * _DISC[:, 0]).sum(1), (block * _DISC[:, 1]).sum(1))
        at = [np.rint(8 * ((v - (side - 1) / 2) * scale + MIDDLE)).astype("i8") for v, side in ((q, w), (y, h))]
        for offset in offsets:
            fine = np.rint((turn + offset) / (2 * np.pi) * FINE).astype("i8") % FINE
            out.append((n, at[0] << X | at[1] << Y | number << SCALE | fine, _sample(x, n, y, q, turn + offset)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def descriptors(images: DataFrame, draw, edit=None, octaves=STORED, offsets=(0.0,)) -> DataFrame:
    """images (class, stored) to (class, place, w0 to w2). draw: stored values to an image, in the task; edit: a function of image and class applied after it."""
    names = ["class", "place", *(f"w{k}" for k in range(BITS // 64))]

    def each(batches):
        for whole in batches:
            for k in range(0, len(whole), STACK):
                b, shapes = whole.slice(k, STACK), {}
                for key, stored in zip(b.column("class").to_pylist(), b.column("stored"), strict=True):
                    if stored.is_valid and len(stored.values):
                        image = draw(np.nan_to_num(np.asarray(stored.values.to_numpy(zero_copy_only=False), "f4")))
                        image = edit(image, key) if edit else image
                        shapes.setdefault(image.shape, []).append((key, image))
                for same in shapes.values():
                    n, place, w = describe(np.stack([image for _, image in same]), octaves, offsets)
                    key = np.array([key for key, _ in same], "i8")[n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (key, place, *w.T)], names)

    return images.select("class", "stored").mapInArrow(each, ", ".join(f"{n} long" for n in names))


def _placed(place: Column, octaves) -> tuple[Column, Column, Column, Column]:
    """x, y in full-size pixels from the middle, scale, direction in radians."""
    bits = lambda at, n: F.shiftright(place, at).bitwiseAND(F.lit((1 << n) - 1))
    scale = F.get(F.array(*[F.lit(2.0**s) for s in octaves]), bits(SCALE, Y - SCALE).cast("int"))
    return bits(X, 20) / 8 - MIDDLE, bits(Y, 20) / 8 - MIDDLE, scale, bits(0, SCALE) * (2 * np.pi / FINE)


_LONGS = [f"w{k}" for k in range(BITS // 64)]


def _words(of=lambda n: F.col(n)) -> list[Column]:
    low = F.lit((1 << 32) - 1)
    return [w for n in _LONGS for w in (of(n).bitwiseAND(low), F.shiftrightunsigned(of(n), 32))]


def _apart(a: str, b: str) -> Column:
    """Bits in which the descriptors of two prefixes differ."""
    return sum((F.bit_count(F.col(a + n).bitwiseXOR(F.col(b + n))) for n in _LONGS[1:]), F.bit_count(F.col(a + "w0").bitwiseXOR(F.col(b + "w0"))))


def _table(d: DataFrame, words) -> DataFrame:
    return d.select("*", F.explode(F.array(*[w.bitwiseOR(F.lit(k << 32)) for k, w in enumerate(_words()) if k in words])).alias("key"))


def _asked(queries: DataFrame, words) -> DataFrame:
    return _table(queries, words).select("key", *[F.col(c).alias(f"q_{c}") for c in queries.columns])


def _first(of) -> Column:
    """The first word in which a descriptor, whose longs of() gives, agrees with that of the query."""
    xor = _words(lambda n: of(n).bitwiseXOR(F.col(f"q_{n}")))
    return F.coalesce(*[F.when(w == 0, k) for k, w in enumerate(xor)])


def near(queries: DataFrame, index: DataFrame, radius=RADIUS, words=range(BITS // 32)) -> DataFrame:
    """Pairs of descriptors within radius bits that agree in a word, each once: the columns of queries with q_ before them, and those of index. words: only pairs whose first word that agrees is one of these."""
    return _asked(queries, words).join(_table(index, words), "key").filter((_apart("", "q_") <= radius) & (F.shiftright("key", 32) == _first(F.col))).drop("key")


def near_members(queries: DataFrame, index: DataFrame, follow: DataFrame, found: DataFrame, radius=RADIUS, words=range(BITS // 32)) -> DataFrame:
    """What near() gives of the members that follow (class, leader) has, without pairs of a query and a group that found (query, leader) has: (q_class, q_place, class, place).

    A group's members of one word travel as rows of about SHARE of them, so that a query that has found it meets these rows instead of each member.
    """
    known = found.groupBy("query").agg(F.collect_set("leader").alias("known"))
    q = _asked(queries.join(known, F.col("class") == F.col("query"), "left").drop("query"), words)
    large = follow.groupBy("leader").agg(F.ceil(F.count("*") / SHARE).alias("_shares")).filter("_shares > 1")  # a row for SHARE classes at most
    of = follow.join(F.broadcast(large), "leader", "left").select("class", "leader", F.coalesce(F.pmod(F.xxhash64("class"), F.col("_shares")), F.lit(0)).alias("_share"))
    m = _table(index.join(of, "class"), words)
    m = m.groupBy("key", "leader", "_share").agg(F.collect_list(F.struct("class", "place", *_LONGS)).alias("all"))

    def like(x):
        apart = sum((F.bit_count(x[n].bitwiseXOR(F.col(f"q_{n}"))) for n in _LONGS[1:]), F.bit_count(x["w0"].bitwiseXOR(F.col("q_w0"))))
        return (apart <= radius) & (F.shiftright("key", 32) == _first(lambda n: x[n]))

    new = ~F.array_contains(F.coalesce("q_known", F.array().cast("array<long>")), F.col("leader"))
    met = q.join(m.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & F.when(new, F.exists("all", like)).otherwise(False))
    return met.select("q_class", "q_place", F.explode(F.filter("all", like)).alias("x")).select("q_class", "q_place", "x.class", "x.place")


def _same(a: str, b: str) -> Column:
    """Whether the corners of two prefixes stand at the same place, scale and direction."""
    (x, y, s, t), (lx, ly, ls, lt) = _placed(F.col(f"{a}place"), STORED), _placed(F.col(f"{b}place"), STORED)
    return (s == ls) & (F.abs(x - lx) <= 2) & (F.abs(y - ly) <= 2) & (F.cos(t - lt) > 0.95)


def _alike(pairs: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """Of pairs (class, leader) those of which ALIKE of each one's corners find a partner in the other."""
    # corners of one image meet those of the other by cells of its leader's picture; a corner near a border is in two cells a side
    cell = lambda v, d: F.floor((v + d) / 8)
    scale = lambda p: F.shiftright(p, SCALE).bitwiseAND(F.lit(0xFF)).alias("scale")
    x, y, _, _ = _placed(F.col("place"), STORED)
    a = pairs.join(index, "class").select("class", "leader", "place", *_LONGS, cell(x, 0).alias("cx"), cell(y, 0).alias("cy"), scale(F.col("place")))
    b = index.select(F.col("class").alias("leader"), *[F.col(c).alias(f"l_{c}") for c in ("place", *_LONGS)]).join(pairs.select("leader").distinct(), "leader", "left_semi")
    lx, ly, _, _ = _placed(F.col("l_place"), STORED)
    b = b.select("*", *[F.array_distinct(F.array(cell(v, -2), cell(v, 2))).alias(n) for n, v in (("cx", lx), ("cy", ly))], scale(F.col("l_place")))
    b = b.withColumn("cx", F.explode("cx")).withColumn("cy", F.explode("cy"))
    both = a.join(b, ["leader", "scale", "cx", "cy"]).filter(_same("", "l_") & (_apart("", "l_") <= 2 * radius))
    met = both.groupBy("class", "leader").agg(F.count_distinct("place").alias("mine"), F.count_distinct("l_place").alias("theirs"))
    corners = index.groupBy("class").agg(F.count_distinct("place").alias("n"))
    met = met.join(corners, "class").join(corners.select(F.col("class").alias("leader"), F.col("n").alias("l_n")), "leader")
    return met.filter((F.col("mine") >= ALIKE * F.col("n")) & (F.col("theirs") >= ALIKE * F.col("l_n"))).select("class", "leader")


def members(index: DataFrame, min_votes=MIN_VOTES, radius=RADIUS, rounds=ROUNDS) -> DataFrame:
    """(class, leader): classes that nearly equal another one, as it is: most corners of both at the same places with like descriptors.

    In each bucket of the first word all meet its least class only; those with enough votes may be a class's
    leaders. The corners of the two are then compared all: only if ALIKE of each finds a partner in the
    other can the class be a member, so that a mark, a frame or a caption in common makes none. Its leader
    is the least of them that has none itself. A class of which all such are members of others is compared
    with their leaders in the same way. Those that these are not like either are dealt with among themselves,
    in rounds; what is left after them stays by itself, and so do classes that are like none.
    """
    k = index.select("*", _words()[0].alias("key"))
    one = k.groupBy("key").agg(F.min(F.struct(*index.columns)).alias("l"), F.max("class").alias("last")).filter(F.col("last") > F.col("l.class"))
    one = one.select("key", *[F.col(f"l.{c}").alias(f"l_{c}") for c in index.columns])
    votes = k.join(one, "key").filter((F.col("class") > F.col("l_class")) & _same("", "l_") & (_apart("", "l_") <= radius))
    votes = votes.groupBy("class", F.col("l_class").alias("leader")).agg(F.count_distinct("place").alias("votes")).filter(F.col("votes") >= min_votes)
    met = staged(_alike(staged(votes.select("class", "leader"), "leaders", clean=True), index, radius), "leaders", clean=True)
    least = lambda d: d.groupBy("class").agg(F.min("leader").alias("leader"))
    follow, open_ = None, met
    for _ in range(rounds):
        some = staged(least(open_.join(open_.select(F.col("class").alias("leader")), "leader", "left_anti")), "leaders", clean=True)
        left = open_.join(some, "class", "left_anti")
        up = some.select(F.col("class").alias("_c"), F.col("leader").alias("_l"))
        further = left.join(up, F.col("leader") == F.col("_c")).select("class", F.col("_l").alias("leader")).distinct()
        some = staged(some.unionByName(least(_alike(staged(further, "leaders", clean=True), index, radius))), "leaders", clean=True)
        follow = some if follow is None else follow.unionByName(some)
        # of those left, the ones that are like the same member are compared with the least of them
        left = staged(left.join(some, "class", "left_anti"), "leaders", clean=True)
        kin = left.join(left.groupBy("leader").agg(F.min("class").alias("_l")), "leader").filter(F.col("_l") < F.col("class")).select("class", F.col("_l").alias("leader")).distinct()
        among = left.join(some.select(F.col("class").alias("leader")), "leader", "left_anti").select("class", "leader")
        open_ = staged(among.unionByName(_alike(staged(kin, "leaders", clean=True), index, radius)).distinct(), "leaders", clean=True)
        if open_.isEmpty():
            break
    return follow


def consensus(pairs: DataFrame, min_votes=MIN_VOTES) -> DataFrame:
    """Matched descriptors (class, place, q_class, q_place) to (query, class, votes): the most different corners that agree on where one image lies in the other, how large and how turned."""
    x, y, s, t = _placed(F.col("place"), STORED)
    q_x, q_y, q_s, q_t = _placed(F.col("q_place"), SEARCHED)
    zoom, turn = q_s / s, q_t - t
    dx, dy = q_x - zoom * (F.cos(turn) * x - F.sin(turn) * y), q_y - zoom * (F.sin(turn) * x + F.cos(turn) * y)
    corner = F.floor(x / 4) * 100_000 + F.floor(y / 4)
    votes = pairs.select(F.col("q_class").alias("query"), "class", corner.alias("corner"), (F.log2(zoom) * 2).alias("zoom"), F.pmod(turn * (8 / (2 * np.pi)), F.lit(8.0)).alias("turn"), (dx / 12).alias("dx"), (dy / 12).alias("dy"))
    for n in ("zoom", "turn", "dx", "dy"):  # two offset grids each, so that no border splits a vote
        far = lambda v: F.pmod(F.floor(v + 0.5), F.lit(8)) if n == "turn" else F.floor(v + 0.5)  # noqa: B023, E731
        votes = votes.withColumn(n, F.explode(F.array(F.floor(n) * 2, far(F.col(n)) * 2 + 1)))
    votes = votes.groupBy("query", "class", "zoom", "turn", "dx", "dy").agg(F.count_distinct("corner").alias("votes"))
    return votes.groupBy("query", "class").agg(F.max("votes").alias("votes")).filter(F.col("votes") >= min_votes)


def find_copies(images: DataFrame, id_col: str, stored_col: str, draw, query, edit=None, min_votes=MIN_VOTES) -> DataFrame:
    """One row per row of images: id, class_id (of equal stored images, by 64-bit hash: their least id), group_id (of nearly equal ones: that of their leader), n_copies and copies (group_id, votes) for queries, else null.

    Every image is searched, leaders first. votes: the leader's, or the most of any member where the leader has too few.
    draw: stored values to pixels, in the task, so that pixels never move. query: a condition on the
    id. edit: what is done to query images before the search, to measure recall.
    """
    stored = F.col(stored_col).cast("array<float>")
    d = images.select(F.col(id_col).alias("id"), stored.alias("stored"), F.xxhash64(stored).alias("class"))
    ids = staged(d.select("id", "class"), "image-ids")
    once = staged(d.groupBy("class").agg(F.first("stored").alias("stored")), "images")
    wanted = ids.filter(query(F.col("id"))).select("class").distinct()
    index = staged(descriptors(once, draw), "descriptors")
    asked = staged(descriptors(once.join(wanted, "class", "left_semi"), draw, edit, SEARCHED, OFFSETS), "descriptors")
    follow = staged(members(index, min_votes), "members")
    leaders = index.join(follow, "class", "left_anti")

    def search(near_of) -> DataFrame:
        found = None
        for words in WORD_ROUNDS:  # what a round has shuffled goes before the next
            pairs = staged(near_of(words).select("q_class", "q_place", "class", "place"), "pairs", clean=True)
            found = pairs if found is None else found.unionByName(pairs)
        return consensus(found, min_votes)

    found = staged(search(lambda words: near(asked, leaders, words=words)).withColumnRenamed("class", "leader"), "found", clean=True)
    further = search(lambda words: near_members(asked, index, follow, found, words=words)).join(follow, "class").groupBy("query", "leader").agg(F.max("votes").alias("votes"))
    found = found.unionByName(further)
    of = ids.groupBy("class").agg(F.min("id").alias("class_id"))
    of = of.join(follow, "class", "left").select("class", "class_id", F.coalesce("leader", "class").alias("head"))
    heads = of.filter(F.col("head") == F.col("class")).select(F.col("class").alias("_head"), F.col("class_id").alias("group_id"))
    m = found.join(heads, F.col("leader") == F.col("_head"))
    m = m.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("group_id", "votes"))).alias("copies"))
    full = ids.join(of, "class").join(heads, F.col("head") == F.col("_head"), "left").join(m, F.col("class") == F.col("query"), "left")
    yes = F.coalesce(query(F.col("id")), F.lit(False))
    none = F.array().cast("array<struct<group_id:bigint,votes:bigint>>")
    return full.select("id", "class_id", "group_id", F.when(yes, F.size(F.coalesce("copies", none))).cast("long").alias("n_copies"), F.when(yes, F.coalesce("copies", none)).alias("copies"))


def _turned(x: np.ndarray, degrees: float, keep=0.72) -> np.ndarray:
    a, n = np.deg2rad(degrees), int(min(x.shape) * keep)
    g = np.arange(n) - (n - 1) / 2
    v, u = np.meshgrid(g, g, indexing="ij")
    py, px = (x.shape[0] - 1) / 2 + np.cos(a) * v + np.sin(a) * u, (x.shape[1] - 1) / 2 - np.sin(a) * v + np.cos(a) * u
    iy, ix = np.clip(py.astype(int), 0, x.shape[0] - 2), np.clip(px.astype(int), 0, x.shape[1] - 2)
    fy, fx = py - iy, px - ix
    return (x[iy, ix] * (1 - fx) + x[iy, ix + 1] * fx) * (1 - fy) + (x[iy + 1, ix] * (1 - fx) + x[iy + 1, ix + 1] * fx) * fy


def _cropped(x: np.ndarray) -> np.ndarray:
    h, w = x.shape
    return x[h // 16 : h - h // 8, w // 8 : w - w // 16] * 1.3 + 0.1


def _noisy(x: np.ndarray) -> np.ndarray:
    return x + np.random.default_rng(1).normal(0, 0.06, x.shape) * x.std()


#: Edits that queries' images go through before the search.
EDITS = {"crop and tone": _cropped, "turn": lambda x: _turned(x, 33), "smaller": lambda x: resize(x, int(x.shape[0] * 0.78), int(x.shape[1] * 0.78)), "noise": _noisy}


def one_of_the_edits(image: np.ndarray, key: int) -> np.ndarray:
    return list(EDITS.values())[key % len(EDITS)](image)


@lru_cache(16)
def _projection(n: int, grid: int) -> np.ndarray:
    return np.random.default_rng(3).normal(size=(grid * grid, n)).astype("f4")


def draw_vector(values: np.ndarray, grid=12, cell=8) -> np.ndarray:
    """A stand-in for decoding: a vector of any length as an image of (grid x cell) squared pixels, a fixed linear map to grid x grid cells, smoothly joined."""
    x = (_projection(len(values), grid) @ values).reshape(grid, grid)
    return resize(np.pad(x, 1, mode="edge"), grid * cell, grid * cell)

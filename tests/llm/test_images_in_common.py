"""A mark that two images share makes neither stand for the other; near copies still do."""

import numpy as np

from lodestone.llm import images

SIDE = 176


def drawn(seed):
    g = np.random.default_rng(seed)
    return images.resize(g.normal(size=(SIDE // 8, SIDE // 8)), SIDE, SIDE)


def as_image(values):
    return values.reshape(SIDE, SIDE)


def test_a_mark_in_common_loses_no_image(spark):
    """Crops of five images with one mark, taken outside of it, find each image as itself."""
    pictures = []
    for k in range(5):
        x = drawn(k)
        x[:72, :72] = drawn(99)[:72, :72]
        pictures.append(x)
    near = pictures[0] + np.random.default_rng(5).normal(0, 0.01, pictures[0].shape)  # a near copy of the first
    rows = [(k, x.ravel().tolist()) for k, x in enumerate([*pictures, near])]
    d = spark.createDataFrame(rows, "id long, stored array<float>")
    index = images.descriptors(d.selectExpr("id AS class", "stored"), as_image)
    member = {r["class"]: r.leader for r in images.members(index).collect()}
    assert member == {5: 0}
    crop = lambda x, _: x[SIDE - 112 :, SIDE - 112 :]  # noqa: E731  nothing of the mark, whose corners see 18 pixels far
    got = {r.id: r for r in images.find_copies(d, "id", "stored", as_image, lambda i: i < 5, crop).collect()}
    for k in range(5):
        votes = {c.group_id: c.votes for c in got[k].copies}
        own = got[k].group_id
        assert votes.get(own, 0) >= 5 and all(v < votes[own] for g, v in votes.items() if g != own), (k, votes)
    assert got[5].group_id == got[0].group_id and len({got[k].group_id for k in range(5)}) == 5


def of_all(spark, asked, index):
    """What the votes of all pairs of descriptors within the radius find: (query, class)."""
    q, d = np.array([tuple(r) for r in asked.collect()], "i8"), np.array([tuple(r) for r in index.collect()], "i8")
    out = []
    for k in range(0, len(q), 256):
        apart = sum(np.bitwise_count((q[k : k + 256, None, c] ^ d[None, :, c]).view("u8")).astype("i4") for c in (2, 3, 4))
        i, j = np.nonzero(apart <= images.RADIUS)
        out += [tuple(map(int, (q[k + a, 0], q[k + a, 1], d[b, 0], d[b, 1]))) for a, b in zip(i, j)]
    pairs = spark.createDataFrame(out, "q_class long, q_place long, class long, place long")
    return {(r["query"], r["class"]) for r in images.consensus(pairs).collect()}


def test_recall_of_copies_with_partners(spark):
    """Images with nearly equal partners, edited: of what all pairs of descriptors would find, own images and partners, nine tenths or more are found."""
    g = np.random.default_rng(11)
    base = [g.normal(size=64) for _ in range(40)]
    rows = [(2 * k + j, (v / np.linalg.norm(v) + (0 if not j else 0.01) * g.normal(size=64)).tolist()) for k, v in enumerate(base) for j in (0, 1)]
    d = spark.createDataFrame(rows, "class long, stored array<float>")
    index = images.descriptors(d, images.draw_vector).persist()
    full = spark.createDataFrame(rows, "id long, stored array<float>")
    for name, edit in images.EDITS.items():
        asked = images.descriptors(d.filter("class % 2 = 0"), images.draw_vector, lambda x, _, edit=edit: edit(x), images.SEARCHED, images.OFFSETS)
        want = of_all(spark, asked, index)
        got = {r.id: r for r in images.find_copies(full, "id", "stored", images.draw_vector, lambda i: i % 2 == 0, lambda x, _, edit=edit: edit(x)).collect()}
        hit = [got[c].group_id in {x.group_id for x in got[q].copies} for q, c in want]
        assert len(want) >= 60 and np.mean(hit) >= 0.9, (name, len(want), np.mean(hit))

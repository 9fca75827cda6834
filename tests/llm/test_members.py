"""Near copies that meet only members of a group find its leader, and others among themselves."""

import random

from lodestone.llm import images


def test_classes_that_are_like_members_only(spark):
    draw = random.Random(2)
    word = lambda: draw.getrandbits(63)
    base = [[word(), word(), word()] for _ in range(10)]
    far = lambda w, low, bits: [w[0] ^ low, w[1] ^ ((1 << bits) - 1), w[2]]
    second = [far(w, 1, 15) if k > 4 else w for k, w in enumerate(base)]  # 16 bits from the first in half of its corners
    drifted = [[w[0], w[1], w[2] ^ 0xFFF] for w in second[5:]]  # 12 bits from the second, 28 from the first
    classes = {
        1: base,
        2: second,
        3: [far(w, 2, 0) if k <= 4 else second[k] for k, w in enumerate(base)],  # shares no first word with 1, but is like it
        4: [[word(), word(), word()] for _ in range(5)] + drifted,  # like 2, not like 1
        5: [[word(), word(), word()] for _ in range(5)] + drifted,
        6: [[word(), word(), word()] for _ in range(10)],
    }
    place = lambda k: 8 * (images.MIDDLE + 20 * k) << images.X | 8 * images.MIDDLE << images.Y
    rows = [(c, place(k), *w) for c, ws in classes.items() for k, w in enumerate(ws)]
    index = spark.createDataFrame(rows, "class long, place long, w0 long, w1 long, w2 long")
    assert {r["class"]: r.leader for r in images.members(index).collect()} == {2: 1, 3: 1, 5: 4}
    assert {r["class"]: r.leader for r in images.members(index, rounds=1).collect()} == {2: 1, 3: 1}  # what is left stays by itself

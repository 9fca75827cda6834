"""A group is found where only a member of it matches, not its leader."""

import numpy as np

from lodestone.llm import images

from .test_images_in_common import SIDE, as_image, drawn

LOWER = 60


def test_a_member_is_found_by_what_its_leader_lacks(spark):
    """Images that share all but their lower part are a group; the lower part of each finds it."""
    leader, other = drawn(0), drawn(1)
    pictures = [leader, *[np.vstack([leader[: SIDE - LOWER], drawn(k)[SIDE - LOWER :]]) for k in (2, 3)], other]
    d = spark.createDataFrame([(k, x.ravel().tolist()) for k, x in enumerate(pictures)], "id long, stored array<float>")
    index = images.descriptors(d.selectExpr("id AS class", "stored"), as_image)
    assert {r["class"]: r.leader for r in images.members(index).collect()} == {1: 0, 2: 0}
    got = {r.id: r for r in images.find_copies(d, "id", "stored", as_image, lambda i: i >= 0, lambda x, _: x[SIDE - LOWER :]).collect()}
    assert len({got[k].group_id for k in (0, 1, 2)}) == 1 and got[3].group_id != got[0].group_id
    for k in range(4):
        assert [c.group_id for c in got[k].copies] == [got[k].group_id] and got[k].copies[0].votes >= 5, (k, got[k].copies)

"""Blocks of vectors grow with the table; their links are thinned to forests without losing an edge of the whole one."""

import numpy as np

from lodestone.operators import clusters
from lodestone.operators.components import spanning_forest

from .test_hierarchy import frame, kruskal, vectors


def test_pairs_of_blocks_do_not_grow_with_the_square(spark, monkeypatch):
    """Whatever the table's size, there are about as many blocks."""
    monkeypatch.setattr(clusters, "CELL_BITS", 3)
    monkeypatch.setattr(clusters, "BLOCKS", 4)
    seen, near = [], clusters._near

    def count(at, *rest):
        seen.append(at.select("block").distinct().count())
        return near(at, *rest)

    monkeypatch.setattr(clusters, "_near", count)
    for n in (100, 400):
        rows = vectors(n)
        got = spanning_forest(clusters.links_within(frame(spark, rows), 1.0)).collect()
        assert [(r.u, r.v) for r in sorted(got, key=lambda r: (r.distance, r.u, r.v))] == [(u, v) for u, v, _ in kruskal(rows, 1.0)[0]]
    assert max(seen) <= 10


def test_thinned_is_kruskal():
    g = np.random.default_rng(2)
    for n, m in ((30, 200), (50, 30), (5, 0)):
        a, b, d = g.integers(0, n, m), g.integers(0, n, m), g.integers(0, 5, m).astype("f8")
        order, keep = g.permutation(n), a != b
        label, want = list(range(n)), []
        for x, _, _, u, v in sorted((x, min(order[u], order[v]), max(order[u], order[v]), u, v) for x, u, v in zip(d[keep], a[keep], b[keep])):
            if label[u] != label[v]:
                want.append((x, *sorted((order[u], order[v]))))
                label = [label[u] if y == label[v] else y for y in label]
        got = clusters._thinned(d[keep], a[keep], b[keep], order)
        assert sorted(want) == sorted((x, *sorted((order[u], order[v]))) for x, u, v in zip(*got))

"""Threshold clusters, spanning forests and persistence against plain forms over whole tables."""

import math

import numpy as np
import pytest

from lodestone.operators import clusters
from lodestone.operators.components import components, spanning_forest


def vectors(n, dims=3, seed=1):
    g = np.random.default_rng(seed)
    at = g.normal(size=(8, dims)) * 3
    return [(i * 7 % 1009, (at[i % 8] + g.normal(size=dims) * (0.1 + 0.15 * (i % 3))).tolist()) for i in range(n)]


def kruskal(rows, eps):
    e = sorted((math.dist(a, b), min(i, j), max(i, j)) for k, (i, a) in enumerate(rows) for j, b in rows[:k] if i != j and len(a) == len(b) and math.dist(a, b) <= eps)
    label, out = {i: i for i, _ in rows}, []
    for d, u, v in e:
        p, q = label[u], label[v]
        if p != q:
            out.append((u, v, d))
            label = {i: min(p, q) if x in (p, q) else x for i, x in label.items()}
    return out, label


def persistent(rows, eps, levels):
    """Excess of mass by recursion from the top: clusters as sets, split where the threshold below no longer holds them together."""
    thresholds = [eps * k / levels for k in range(levels + 1)]
    forest, _ = kruskal(rows, eps)
    step = {(u, v): max(1, math.ceil(d / eps * levels - 1e-9)) for u, v, d in forest}
    used = sorted(set(step.values()))

    def parts(members, k):
        """Components of members by edges of steps up to k."""
        label = {m: m for m in members}
        for (u, v), s in step.items():
            if s <= k and u in label and v in label and label[u] != label[v]:
                old, new = max(label[u], label[v]), min(label[u], label[v])
                label = {m: new if x == old else x for m, x in label.items()}
        out = {}
        for m, x in label.items():
            out.setdefault(x, set()).add(m)
        return list(out.values())

    def solve(members, born):
        """(stability, best within, taken clusters of the best) of the cluster that is members below the density born."""
        mass, now = 0.0, set(members)
        for k in range(levels, 0, -1):
            pieces = parts(now, k - 1)
            if len(pieces) == 1:
                continue
            density = 1 / thresholds[k]
            big = [p for p in pieces if len(p) > 1]
            if len(big) == 1:
                mass += density * (len(now) - len(big[0]))
                now = big[0]
                continue
            mass += density * len(now)
            inner = [solve(p, density) for p in big]
            best = sum(max(s, w) for s, w, _ in inner)
            stability = mass - born * len(members)
            return stability, best, [(set(members), stability)] if stability >= best else [x for _, _, taken in inner for x in taken]

    found = []
    for p in parts({i for i, _ in rows}, levels):
        if len(p) > 1:
            found += solve(p, 1 / eps)[2]
    top = 1 / thresholds[used[0]] if used else 1
    return {min(m): (m, s / (len(m) * top)) for m, s in found}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("at_once", [1 << 18, 20])
def test_forest_is_kruskals(spark, at_once):
    rows = vectors(260)
    want, label = kruskal(rows, 1.2)
    links = clusters.links_within(frame(spark, rows), 1.2)
    got = sorted(map(tuple, spanning_forest(links, at_once).collect()))
    assert [g[:2] for g in got] == sorted(w[:2] for w in want) and abs(sum(g[2] for g in got) - sum(w[2] for w in want)) < 1e-9
    c = dict(map(tuple, components(links, at_once).collect()))
    assert c == {i: x for i, x in label.items() if list(label.values()).count(x) > 1}


def test_components_of_long_chains_in_rounds(spark):
    import random

    order = list(range(300))
    random.Random(3).shuffle(order)
    e = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "u long, v long"), 10).collect()))
    assert got == {i: 0 for i in order} | {1000: 1000, 1001: 1000}


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = vectors(200)
    monkeypatch.setattr(clusters, "CELL_BITS", 4)
    want, _ = kruskal(rows, 1.0)
    got = spanning_forest(clusters.links_within(frame(spark, rows), 1.0)).collect()
    assert sorted(g[:2] for g in map(tuple, got)) == sorted(w[:2] for w in want)


def test_null_repeated_and_equal_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, None), (4, []), (5, [math.nan, 0.0]), (6, [None, 1.0]), (7, [5.0, 5.0]), (7, [0.2, 0.0]), (8, [5.1, 5.0]), (9, [0.0]), (10, [9.0, 9.0]), (11, [9.0, 9.0]), (11, [9.0, 9.0])]
    for links in (clusters.links_within, clusters.near_links):
        got = dict(map(tuple, clusters.threshold_clusters(frame(spark, rows).selectExpr("*", "1 AS e", "2 AS block", "3 AS bucket"), 0.3, links).collect()))
        assert got == {1: 1, 2: 1, 7: 1, 8: 1, 3: -1, 4: -1, 5: -1, 6: -1, 9: -1, 10: 10, 11: 10}, links
    assert clusters.threshold_clusters(frame(spark, []), 0.3).count() == 0
    assert spanning_forest(clusters.links_within(frame(spark, []), 0.3)).count() == 0


@pytest.mark.parametrize("seed, levels", [(1, 8), (2, 5), (3, 12)])
def test_persistence_is_excess_of_mass(spark, seed, levels):
    rows = vectors(90, 2, seed)
    forest = spanning_forest(clusters.links_within(frame(spark, rows), 1.5))
    labels, value = clusters.hierarchy(forest, 1.5, levels)
    want = persistent(rows, 1.5, levels)
    members = {}
    for i, x in map(tuple, labels.collect()):
        members.setdefault(x, set()).add(i)
    assert members == {x: m for x, (m, _) in want.items()} and len(want) > 2
    assert {r.label: round(r.value, 9) for r in value.collect()} == {x: round(v, 9) for x, (_, v) in want.items()}


def test_hierarchy_of_nothing(spark):
    labels, value = clusters.hierarchy(spark.createDataFrame([], "u long, v long, distance double"), 1.0)
    assert labels.count() == 0 and value.count() == 0


def test_recall_of_the_index(spark):
    """Of pairs within eps among vectors of 64 dimensions the index finds nine tenths or more."""
    g = np.random.default_rng(5)
    base = g.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = g.normal(size=(400, 64))
    near = base + step / np.linalg.norm(step, axis=1)[:, None] * g.uniform(0.05, 0.3, size=400)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    want, _ = kruskal(rows, 0.3)
    got = {r[:2] for r in map(tuple, clusters.near_links(frame(spark, rows), 0.3).collect())}
    assert len(want) >= 395 and len({w[:2] for w in want} & got) >= 0.9 * len(want)

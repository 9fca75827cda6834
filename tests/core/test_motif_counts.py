"""motif_counts over the whole graph E, chains to their end."""

from lodestone import queries


def test_chains_and_contradictions_are_counted(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["hypothesis_type"]: r["n"] for r in queries.motif_counts(spark, sf).collect()}
    e = queries.graph_e(spark, sf).edges.collect()
    kinds = {}
    for r in e:
        kinds.setdefault(frozenset((r["source_id"], r["target_id"])), set()).add(r["edge_type"])
    assert got["contradiction"] == sum({"supports", "contradicts"} <= k for k in kinds.values())
    assert got["chain"] > 0 and got["cluster"] > 0 and got["hub"] > 0

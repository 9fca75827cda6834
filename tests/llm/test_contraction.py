"""Components of links come from rounds of star contraction, few links too."""

from lodestone.llm import simhash


def test_few_links_go_through_the_rounds(spark, monkeypatch):
    met, seen = simhash._met, []
    monkeypatch.setattr(simhash, "_met", lambda *a: seen.append(1) or met(*a))
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(40, 30), (30, 30)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {**{k: 1 for k in range(2, 21)}, 40: 30}
    assert len(seen) >= 2

"""Components of a few links are found in the driver, as those of many are by contraction."""

from __future__ import annotations

import random

from fleetnet.llm import graphs


def test_few_links_as_many(spark, monkeypatch):
    rng = random.Random(3)
    links = [(rng.randrange(-300, 300) << 40, rng.randrange(-300, 300) << 40) for _ in range(250)] + [(7, 7), (8, 9), (9, 8), (None, 8)]
    links = spark.createDataFrame(links, "a bigint, b bigint")
    rounds = []
    monkeypatch.setattr(graphs, "cut", lambda df, cut=graphs.cut: rounds.append(1) or cut(df))
    few = sorted(map(tuple, graphs.components(links, "a", "b").collect()))
    assert len(rounds) == 1  # contraction takes some more
    monkeypatch.setattr(graphs, "FEW_LINKS", 0)
    assert few == sorted(map(tuple, graphs.components(links, "a", "b").collect())) and len(rounds) > 2
    assert (8, 8) in few and (9, 8) in few and not any(n == 7 for n, _ in few)


def test_no_links(spark):
    assert not graphs.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint"), "a", "b").collect()

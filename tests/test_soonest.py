"""Soonest partners without whole searches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetnet.operators import meetings, paths
from fleetnet.plans import answers, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("first", [1_000, 300_000])
def test_the_soonest_partner_is_that_of_whole_searches(spark, monkeypatch, first):
    fleet = views.fleet(spark, SF)
    pairs = fleet.filter("s_suppkey % 3 = 1").select(F.col("id").alias("a")).join(fleet.select(F.col("id").alias("b")), F.col("a") != F.col("b"))
    prepared, edges, nodes = answers._prepared(spark, SF), views.net_edge(spark, SF), views.net_node(spark, SF)
    order = fleet.select("id", F.col("s_suppkey").alias("ord"))
    whole = sorted(map(tuple, meetings.best_partner(meetings.meetings(pairs, prepared, edges, nodes), order).collect()))
    horizons = []
    fields = paths.time_fields
    monkeypatch.setattr(paths, "time_fields", lambda s, a: horizons.append(s.agg(F.max("horizon_ms")).first()[0]) or fields(s, a))
    monkeypatch.setattr(meetings, "FIRST_LOOK_MS", first)
    assert sorted(map(tuple, meetings.soonest(pairs, prepared, edges, nodes, order).collect())) == whole and whole
    assert horizons == sorted(horizons) and horizons[0] < 2_000_000  # no look goes over a vehicle's whole reach at once

"""The focal vehicles' soonest partners among all vehicles."""

from __future__ import annotations

from fleetnet.plans import answers, views

SF = "/root/testdata/sf0.001"


def test_best_focal_is_over_all_vehicles(spark):
    fleet = {r.id: r for r in views.fleet(spark, SF).collect()}
    pairs = {(r.a, r.b) for r in answers._focal_pairs(spark, SF).collect()}
    assert pairs == {(a, b) for a, v in fleet.items() if v.s_suppkey % 100 == 1 for b in fleet if a != b}
    ms = {i: r.ts_unix for i, r in fleet.items()}
    lead = [r for r in answers.meet_lead_ranked(spark, SF).collect() if r.found]  # against its SQL twin in test_oracle
    first = min(lead, key=lambda r: (round(max(ms[r.a], ms[r.b]) + r.meet_s, 6), fleet[r.b].s_suppkey))
    got = {r.a: r for r in answers.meet_best_focal(spark, SF).collect()}
    assert (got[first.a].b, got[first.a].meet_s) == (first.b, first.meet_s)

"""The fit of few cells in the driver."""

from __future__ import annotations

import pytest

from fleetnet.llm import mixing

SCHEMA = "_source string, _lang string, _topic string, _tokens bigint"
CELLS = [(s, g, t, (7 * i * i + 5) % 311 if i % 9 else 0) for i, (s, g, t) in enumerate((s, g, t) for s in "abcd" for g in ("en", "de", "") for t in "pqr")]


@pytest.mark.parametrize("cells", [CELLS, CELLS[:1], [("a", "en", "p", 0)], []])
def test_the_fit_in_the_driver_is_the_fit_over_tables(spark, monkeypatch, cells):
    """A round over tables was a dozen jobs, of which the driver kept something: it went beyond 1,500 MB in the pipeline."""
    table = spark.createDataFrame(cells, SCHEMA)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    here, asked = mixing.fit(table)
    assert jobs() - before <= 2
    monkeypatch.setattr(mixing, "FIT_HERE", -1)
    there, wanted = mixing.fit(table)
    numbers = lambda df, n: {tuple(r)[:n]: tuple(r)[n:] for r in df.collect()}
    assert here.schema == there.schema or [f.dataType for f in here.schema] == [f.dataType for f in there.schema]
    for a, b, n in [(here, there, 4), *[(asked[d], wanted[d], 1) for d in mixing.DIMS]]:
        a, b = numbers(a, n), numbers(b, n)
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)

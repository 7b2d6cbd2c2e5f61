"""Rounds for near copies end when no key is left that two components have."""

from __future__ import annotations

from fleetnet.llm import nearcopies


def test_no_round_without_open_keys(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]]), "one of its own kind and no other", None, ""]
    calls = []
    monkeypatch.setattr(nearcopies, "verified", lambda *a, verified=nearcopies.verified: calls.append(1) or verified(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    assert len(calls) == 1  # was 4, one for each round and the rest

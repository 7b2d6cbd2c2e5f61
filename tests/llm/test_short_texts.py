"""Texts too short for a certain syncmer."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetnet.llm import syncmers


def test_every_text_with_tokens_has_an_anchor(spark):
    texts = [" ".join(f"w{i}n{n}k{k}" for k in range(n)) for n in (1, 4, 5, 6, 7) for i in range(40)] + ["漢" * n for n in range(65, 97)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    prints = [got[i].fingerprint for i in range(len(texts))]
    assert all(prints) and len(set(prints[:200])) == 200
    assert not got[len(texts)].fingerprint and not got[len(texts) + 1].fingerprint


def test_runs_without_spaces_are_context_free(spark):
    rng = random.Random(12)
    run = "".join(chr(0x4E00 + rng.randrange(3_000)) for _ in range(500))
    texts = {1: run, 2: "前" + run, 3: run[:250] + "入" + run[250:], 4: "".join(rng.sample(run, len(run)))}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    marks = {}
    for r in syncmers.document_anchors(df).collect():
        marks.setdefault(r.doc_id, {})[r.pos] = r.hash
    own = set(marks[1].values())
    assert len(own & set(marks[2].values())) / len(own) > 0.97 and len(own & set(marks[3].values())) / len(own) > 0.97 and not own & set(marks[4].values())
    got = {(r.a, r.b, r.shift): r for r in syncmers.matched_passages(spark.createDataFrame([(2, 1), (3, 1), (4, 1), (9, 1)], "a bigint, b bigint"), syncmers.document_anchors(df)).collect()}
    assert set(got) == {(2, 1, 1), (3, 1, 0), (3, 1, 1)}
    assert got[3, 1, 0].a_to < 250 <= got[3, 1, 1].a_from and got[2, 1, 1].n_anchors > 200


def test_tokens(spark):
    texts = ["a bc  def\n" + "x" * 16 + " " + "y" * 17 + "\tz", "", " \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.h for r in df.select(syncmers.token_hashes(F.col("t")).alias("h")).collect()]
    want = [["a", "bc", "def", "x" * 16, *["y"] * 17, "z"], [], []]
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {x for ws in want for x in ws}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert [list(h) for h in got] == [[hashes[w] for w in ws] for ws in want]

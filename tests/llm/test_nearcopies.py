"""The pipeline's near copies against brute-force Jaccard likeness over five-word shingles."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from fleetnet.llm import nearcopies

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """The least id of each one's component over all pairs of likeness 4/5 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    texts = {1: None, 2: "", 3: "one", 4: "ONE", 5: "a b c d", 6: "a b c d e", 7: "a b c d e f"}
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 150, 300]))]
        for k in range(12):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts[100 * (g + 1) + k] = " ".join(words)
    hot = [f"h{i}" for i in range(60)]
    for k in range(80):  # one large group, whose ends differ by more than a fifth
        texts[5_000 + k] = " ".join([f"n{k}{i}" if i % 60 == k % 60 else w for i, w in enumerate(hot)])
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in texts.items()], DOC)
    want = plain_groups(texts)
    got = {r.doc_id: r.component_id for r in nearcopies.near_duplicates(df).collect()}
    assert got == want and len(set(want.values())) < len(texts) - 100
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()) == sorted(set(want.values()))


def test_repeated_and_null_ids(spark):
    rows = [(7, "same words again and again"), (7, "same words again and again"), (None, "no id here at all, none"), (8, "Same words again and again"), (9, None)]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOC)
    assert sorted(str(r.doc_id) for r in nearcopies.deduplicated(df).collect()) == ["7", "9", "None"]


def test_texts_of_many_rows_are_found_without_a_broadcast_table(spark, monkeypatch):
    """A hash table of up to 500,000 rows was made in the driver and sent to all executors."""
    rows = [(k if k else None, f"words of text {k % 40}") for k in range(60)] + [(7, "words of text 7"), (8, None)]
    df = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id bigint, text string")
    wanted = df.filter("doc_id % 2 = 1 or doc_id is null").selectExpr("xxhash64(doc_id, text) as node", "doc_id", "xxhash64(text) as text_hash").distinct()
    got = lambda: sorted((r.node, bytes(r.packed)) for r in nearcopies.packed_texts(df, wanted).collect())
    joined = got()
    monkeypatch.setattr(nearcopies, "FEW_ROWS", 0)
    assert "Join" not in nearcopies.packed_texts(df, wanted)._jdf.queryExecution().sparkPlan().toString()
    assert got() == joined and len(joined) > 30

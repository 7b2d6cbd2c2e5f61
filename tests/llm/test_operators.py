"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetnet.llm import graphs, language, licences, mixing, passages, pieces, quality, queries, rules, sharding, simhash, suffixes, syncmers
from fleetnet.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (4, long, "en", "a", len(long)), (5, long, "de", "b", len(long)), (6, "x" * 20_000, "en", "a", 20_000),
        (7, "same words again " * 60, "en", "a", 1), (7, "same words again " * 60, "en", "a", 1), (None, "no id here", None, "c", 1), (8, "▁ é漢字🙂 \n\t", "fr", "c", 1), (9, " \n \t ", "fr", None, 1),
    ]
    return spark.createDataFrame([(*r, 5, "z", 1.0) for r in rows], DOC + ", _n int, g string, rank double")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 ------------------------------------------------------------------------------------------------------------------


def test_syncmer_texts_and_likeness(spark, docs, texts):
    got = rows(syncmers.fingerprints(docs))
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        a, b = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = defaultdict(set)
    for i, t in texts.items():
        prints[t].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got.values() if r.n_chars > 600]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_syncmers_are_closed_and_context_free(spark):
    rng = random.Random(3)
    words = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["head"] * 9 + words[30:90] + ["tail"] * 4))], "doc_id bigint, text string")
    found = defaultdict(dict)
    for r in syncmers.document_anchors(df).collect():
        found[r.doc_id][r.pos] = r.hash
    hashes = df.select("doc_id", syncmers.token_hashes(F.col("text")).alias("h")).collect()[0].h
    pair = [r.g for r in spark.createDataFrame([(i, hashes[i], hashes[i + 1]) for i in range(len(hashes) - 1)], "i int, a bigint, b bigint").select("i", F.xxhash64("a", "b").alias("g")).orderBy("i").collect()]
    want = {i for i in range(len(hashes) - 4) if min(pair[i], pair[i + 3]) <= min(pair[i + 1 : i + 3])}
    assert set(found[1]) == want
    # The same passage, 30 to 90 in the one and 9 to 69 in the other: the same anchors, moved by 21.
    assert {p + 21: h for p, h in found[2].items() if 9 <= p <= 64} == {p: h for p, h in found[1].items() if 30 <= p <= 85}


# 2 ------------------------------------------------------------------------------------------------------------------


def test_raking_meets_all_marginals(spark):
    cells = spark.createDataFrame([(s, g, t, n) for s, g, t, n in [("a", "en", "p", 100), ("a", "de", "p", 50), ("b", "en", "q", 30), ("b", "de", "q", 70), ("a", "en", "q", 20), ("b", "en", "p", 10)]], "_source string, _lang string, _topic string, _tokens bigint")
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "_source string, _t double"), "lang": spark.createDataFrame([("en", 0.6), ("de", 0.4)], "_lang string, _t double"), "topic": spark.createDataFrame([("p", 0.55), ("q", 0.45)], "_topic string, _t double")}
    fitted = mixing.rake(cells, targets)
    for dim, want in (("_source", {"a": 0.5, "b": 0.5}), ("_lang", {"en": 0.6, "de": 0.4}), ("_topic", {"p": 0.55, "q": 0.45})):
        got = {r[0]: r[1] for r in fitted.groupBy(dim).agg(F.sum("_w")).collect()}
        assert got == pytest.approx(want, abs=1e-5)
    spent = mixing.calibrate(fitted, 0.4)
    assert spent.agg(F.sum(F.col("_p") * F.col("_tokens"))).first()[0] == pytest.approx(0.4 * 280)
    assert spent.filter("_p > 1").count() == 0


def test_mixing_covers_all_and_is_calibrated(spark, docs, texts):
    got = rows(mixing.mixture(docs))
    assert set(got) == set(texts) and all(got[i].tokens == len(WORD.findall(t)) for i, t in texts.items())
    total = sum(r.tokens for r in got.values())
    assert sum(r.probability * r.tokens for r in got.values()) == pytest.approx(mixing.BUDGET * total)
    kept = {r.doc_id for r in mixing.sample(docs).collect()}
    assert kept == {i for i, r in got.items() if r.sampled}


def test_expected_marginals_meet_what_is_feasible(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    got = mixing.marginals(docs).collect()
    assert {r.dim for r in got} == set(mixing.DIMS) and all(abs(r.expected / r.feasible - 1) <= 0.01 for r in got)
    for d in mixing.DIMS:
        own = [r for r in got if r.dim == d]
        assert sum(r.feasible for r in own) == pytest.approx(1) and sum(r.wanted for r in own) == pytest.approx(1)


def plain_raking(cells, targets, budget, rounds=3_000):
    """The weights by the same factors in plain loops, from (source, lang, topic, tokens)."""
    total = sum(c[3] for c in cells)
    u, cap = [c[3] / total for c in cells], [c[3] / (budget * total) for c in cells]
    for _ in range(rounds):
        for d in range(3):
            for value, t in targets[d].items():
                own = [i for i, c in enumerate(cells) if c[d] == value]
                full = sum(cap[i] for i in own if u[i] >= cap[i])
                open_ = sum(u[i] for i in own if u[i] < cap[i])
                f = (t - full) / open_ if open_ and t > full else 1.0 if t >= full + open_ else t / (full + open_)
                for i in own:
                    u[i] *= f
    return {c[:3]: min(x, y) for c, x, y in zip(cells, u, cap, strict=True)}


def test_bounded_raking_against_plain_loops(spark):
    rng = random.Random(8)
    cells = [(s, g, t, rng.choice([5, 20, 100, 900])) for s in "abc" for g in ("en", "de") for t in "pq"]
    schema = "_source string, _lang string, _topic string, _tokens bigint"
    total = sum(c[3] for c in cells)
    share = lambda d, v: sum(c[3] for c in cells if c[d] == v) / total
    wanted = [{v: share(d, v) ** 0.1 for v in sorted({c[d] for c in cells})} for d in range(3)]
    frames = {n: spark.createDataFrame([(v, w) for v, w in wanted[d].items()], f"_{n} string, _t double") for d, n in enumerate(mixing.DIMS)}
    fitted, asked = mixing.fit(spark.createDataFrame(cells, schema), 0.6, frames)
    feasible = [{r[0]: r["_t"] for r in asked[n].collect()} for n in mixing.DIMS]
    for d in range(3):
        z = sum(wanted[d].values())
        assert all(feasible[d][v] <= 0.95 * share(d, v) / 0.6 + 1e-9 for v in wanted[d])
        open_ = [v for v in wanted[d] if feasible[d][v] < 0.95 * share(d, v) / 0.6 - 1e-9]
        assert len({round(feasible[d][v] / wanted[d][v] * z, 9) for v in open_}) <= 1
    plain = plain_raking(cells, feasible, 0.6)
    got = {(r._source, r._lang, r._topic): r._weight for r in fitted.collect()}
    assert got == pytest.approx(plain, abs=2e-4) and any(abs(plain[c[:3]] - c[3] / (0.6 * total)) < 1e-9 for c in cells)


def test_topics(spark):
    texts = {"prose": "plain words that run on and on " * 9, "legal": "copyright 2020, licence, no warranty and no liability", "contact": "write to a.b@c.org or call +44 20 7946 0958", "tabular": "a | b | c | d | e", "numeric": "12 13.5 99% 4,000 7 8 9", "code": "if (a == b) { run(); } else { stop(); }", "promotion": "BUY NOW!! subscribe!! free!!"}
    df = spark.createDataFrame(list(texts.items()), "t string, text string")
    assert {r.t: r.x for r in df.select("t", mixing.topic_of(F.col("text"), F.regexp_count("text", F.lit(mixing.WORD))).alias("x")).collect()} == {t: t for t in texts}


# 3 ------------------------------------------------------------------------------------------------------------------


def test_language_of_pages_and_held_out_texts(spark):
    sf = SF.replace("0.001", "0.01")
    docs = table(spark, sf, "documents")
    train, test = docs.filter("crc32(cast(doc_id as string)) % 3 <> 1"), docs.filter("crc32(cast(doc_id as string)) % 3 = 1")
    model = language.train(train)
    got = language.identify(language.corpus_items(table(spark, sf, "pages"), test), model)
    said = got.filter("is_page").select(F.avg((F.col("lang") == F.col("declared")).cast("double"))).first()[0]
    own = got.filter("not is_page").join(test.select(F.col("doc_id").alias("id"), F.col("lang").alias("true")), "id").select(F.avg((F.col("lang") == F.col("true")).cast("double"))).first()[0]
    assert said > 0.98 and own > 0.95


def test_language_evidence_decides_where_text_does_not(spark, docs):
    model = language.train(docs)
    item = "id bigint, content string, url string, declared string, is_page boolean"
    fr = [(i, "Le la les des une que est dans pour pas", "http://h.example.fr/x", "fr", True) for i in range(40)]
    rows_ = [(100, "", "http://h.example.fr/y", "", True), (101, "", None, "de", True), (102, None, None, "", True), (103, "?", "http://h.example.fr/z", "xx", True)]
    got = rows(language.identify(spark.createDataFrame(fr + rows_, item), model), "id")
    assert got[100].lang == "fr" and got[102].posterior < got[100].posterior and got[103].lang == "fr"
    assert abs(sum(got[101].evidence) - 1) < 1e-9
    nothing = language.identify(spark.createDataFrame(fr[:1], item), language.train(docs.limit(0))).first()
    assert nothing.lang is None


def test_fused_posterior_against_plain_loops(spark):
    model = language.TextModel(["de", "en", "fr"], np.random.default_rng(3).integers(0, 9, (3, language.BUCKETS)).astype(float))
    rng = random.Random(9)
    hosts = ["a.x.de", "b.x.de", "c.y.de", "d.z.com", "e.z.com", None]
    items = [(i, " ".join(rng.choice(["foo", "bar", "der", "the", "les"]) for _ in range(rng.randrange(0, 6))), rng.choice(hosts), rng.choice(["", "de", "en", "xx", None]), True) for i in range(60)] + [(99, None, None, "", False)]
    df = spark.createDataFrame([(i, t, f"http://{h}/p{i}" if h else None, d, p, 1, "z", 2.0) for i, t, h, d, p in items], "id bigint, content string, url string, declared string, is_page boolean, _text int, _host string, lang double")
    got = rows(language.identify(df, model), "id")

    def soft(v):
        e = np.exp(v - np.max(v))
        return e / e.sum()

    logs = {i: model.loglik(language.visible_text(t or "") if p else t or "") for i, t, _, _, p in items}
    post = {i: soft(v) for i, v in logs.items()}
    said = {i: "" if d in (None, "") else d if d in model.languages else "other" for i, _, _, d, _ in items}
    table_ = np.array([sum((post[i] for i in post if said[i] == x), np.zeros(3)) for x in [*model.languages, "other"]]) + 0.5
    chance = dict(zip([*model.languages, "other"], np.log(table_ / table_.sum(axis=0)), strict=True)) | {"": np.zeros(3)}
    base = sum(post.values()) + 1.0
    at = {i: h or "" for i, _, h, _, _ in items}
    level = lambda f: {k: sum(post[i] for i in post if at[i] and f(at[i]) == k) for k in {f(h) for h in at.values() if h}}
    own, domain, suffix = level(str), level(lambda h: ".".join(h.split(".")[-2:])), level(lambda h: h.split(".")[-1])
    for i in post:
        prior = base / base.sum()
        if at[i]:
            for sums in (suffix[at[i].split(".")[-1]], domain[".".join(at[i].split(".")[-2:])], own[at[i]]):
                prior = np.maximum(sums - post[i], 0) + language.SMOOTHING * prior
                prior /= prior.sum()
        want = soft(logs[i] + chance[said[i]] + np.log(prior + 1e-12))
        assert list(got[i].evidence) == pytest.approx(list(want), abs=1e-9) and got[i].lang == model.languages[int(np.argmax(want))]


def test_rare_and_surplus_languages(spark):
    sets = {"aa": "alpha beta gamma", "bb": "xylo quux zork", "cc": "mi tu su", "dd": "ning nong nang"}
    n = {"aa": 900, "bb": 300, "cc": 6, "dd": 5}
    df = spark.createDataFrame([(k, f"{t} {k % 7}", g) for g, t in sets.items() for k in range(n[g])], "doc_id bigint, text string, lang string")
    model = language.train(df, rows=100)
    assert model.languages == ["aa", "bb", "cc", "dd"] and all(model.languages[int(np.argmax(model.loglik(t)))] == g for g, t in sets.items())
    few = language.train(df, rows=100, most=2)
    assert few.languages == ["aa", "bb", "other"] and few.languages[int(np.argmax(few.loglik(sets["dd"])))] == "other"
    one = language.identify(spark.createDataFrame([(1, sets["cc"], None, "cc", True)], "id bigint, content string, url string, declared string, is_page boolean"), few).first()
    assert one.lang == "other"


# 4 ------------------------------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = rows(queries.op4_quality_knn(spark, sf))
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    out = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in out) / len(out) > 0.95


def test_quality_votes_are_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, quality.N_TERMS)).astype(np.float16)
    y = (rng.random(300) > 0.5).astype(float)
    model = quality.Model.fit(x, y)
    q = rng.random((20, quality.N_TERMS)).astype(np.float32)
    v = (q * model.idf) @ model.project
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i, s in enumerate(model.score(q)):
        cos = sorted(((float(v[i] @ w), k) for k, w in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** 8 + 1e-6 for c, _ in cos]
        assert s == pytest.approx(sum(w * model.labels[k] for w, (_, k) in zip(weights, cos, strict=True)) / sum(weights), rel=1e-3)
    assert list(quality.Model.fit(x[:0], y[:0]).score(q)) == [0.5] * 20


# 5 ------------------------------------------------------------------------------------------------------------------


def test_pieces_round_trip_and_reproduce(spark, docs, texts, odd):
    got = pieces.encoded(docs).cache()
    assert got.filter("lossless").count() == len(texts)
    back = rows(pieces.decoded(got))
    assert all(back[i].text == t for i, t in texts.items())
    again = {r.doc_id: r.ids for r in pieces.encoded(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.ids for r in got.collect()}
    assert again != {r.doc_id: r.ids for r in pieces.encoded(docs, seed=9).collect()}
    strange = pieces.encoded(odd).collect()
    assert all(r.lossless for r in strange) and len(strange) == 11
    assert [r.ids for r in strange if r.doc_id == 1] == [None] and [list(r.ids) for r in strange if r.doc_id == 2] == [[]]
    same = [list(r.ids) for r in strange if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]
    assert list(pieces.row_keys([None, None, 4], 1, ["a", "b", "a"])) != list(pieces.row_keys([None, None, 4], 1, ["b", "b", "a"]))


def test_pieces_are_drawn_by_the_lattice():
    p = pieces.Pieces(pieces.MODEL)
    number = {b: i for i, b in enumerate(p.bytes) if i > 258}
    text, total, paths = " then", 0.0, {}

    def walk(at, weight, path):
        nonlocal total
        if at == len(text):
            paths[tuple(path)] = weight
            total += weight
            return
        for n in range(1, len(text) - at + 1):
            i = number.get(text[at : at + n].encode())
            if i:
                walk(at + n, weight * p.weight[i], [*path, i])

    walk(0, 1.0, [])
    n = 40_000
    drawn = Counter(tuple(x.tolist()) for x in pieces.encode(p, ["then"] * n, np.arange(n).astype(np.uint64) * np.uint64(7_919_977)))
    assert set(drawn) <= set(paths)
    assert max(abs(drawn[k] / n - w / total) for k, w in paths.items()) < 0.01


def test_expected_pieces_against_all_paths():
    p = pieces.Pieces(pieces.MODEL)
    number = {b: i for i, b in enumerate(p.bytes) if i > 258}
    blocks, times = [" then", " a", " others", "x", " then"], np.array([3, 5, 2, 7, 1])
    want = Counter()
    for text, n in zip(blocks, times.tolist(), strict=True):
        paths = []

        def walk(at, weight, path, text=text, paths=paths):
            if at == len(text):
                paths.append((weight, path))
            for k in range(1, len(text) - at + 1):
                i = number.get(text[at : at + k].encode())
                if i:
                    walk(at + k, weight * p.weight[i], [*path, i])

        walk(0, 1.0, [])
        total = sum(w for w, _ in paths)
        for w, path in paths:
            for i in path:
                want[i] += n * w / total
    got = pieces.Lattices(p, blocks).expected(times) / pieces.FINE
    assert {i: got[i] for i in want} == pytest.approx(dict(want), abs=0.01) and got.sum() == pytest.approx(sum(want.values()), abs=0.05)


def test_block_counts_and_estimate(spark, docs, texts):
    want = Counter(b for t in texts.values() if t for b in pieces._BLOCK.findall(f" {t}"))
    assert max(map(len, want)) <= pieces.COUNTED_CHARS and {r.block: r.n for r in pieces.block_counts(docs).collect()} == dict(want)
    assert pieces.blocks_of(" a  b ") == ["  a", "  b", " "] and pieces.blocks_of("a\nb c") == [" a\nb", " c"]
    long = spark.createDataFrame([("y" * 1_000,), (None,), ("",)], "text string")
    assert sum(len(r.block) * r.n for r in pieces.block_counts(long).collect()) == 1_001
    blob = open(pieces.MODEL, "rb").read()
    logs = [pieces.estimated(d, blob) for d in (docs, docs.repartition(5))]
    assert (logs[0] == logs[1]).all() and np.exp(logs[0]).sum() == pytest.approx(1)
    p = pieces.Pieces(blob)
    score = lambda lw: sum(n * np.log(paths_weight(pieces.Pieces(blob, log_weights=lw), b)) for b, n in list(want.items())[:300])
    start = np.log(p.weight[p.named] / p.weight[p.named].sum())
    assert score(logs[0]) > score(start)  # likelier than by rank


def paths_weight(p, block):
    """The weight of all paths of a block."""
    number = {b: i for i, b in enumerate(p.bytes) if i > 258}
    ways = [1.0] + [0.0] * len(block)
    for z in range(1, len(block) + 1):
        for a in range(max(0, z - p.longest), z):
            i = number.get(block[a:z].encode())
            ways[z] += ways[a] * (p.weight[i] if i else p.weight[pieces._FALLBACK] if z - a == 1 else 0.0)
    return ways[-1]


# 6 ------------------------------------------------------------------------------------------------------------------


def brute_spans(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\x01" * length
        kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
        out.append((len(t), sum(mask), len(re.findall(rb"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


def test_difference_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("letters,length", [(2, 130), (20, 200), (2, 400)])
def test_block_sort_against_counts(letters, length):
    rng = np.random.default_rng(letters + length)
    base = rng.integers(97, 97 + letters, 4_000).astype(np.uint8)
    parts = []
    for _ in range(10):
        a, n = int(rng.integers(0, 3_000)), int(rng.integers(length, length + 400))
        x = base[a : a + n].copy()
        if rng.random() < 0.7:
            x[rng.integers(0, len(x))] ^= 1
        parts.append(x)
    data = np.concatenate(parts)
    ends = np.cumsum([len(x) for x in parts])
    at = rng.permutation(np.concatenate([np.arange(e - len(x), e - length + 1) for x, e in zip(parts, ends, strict=True)]))
    raw = data.tobytes()
    count = Counter(raw[i : i + length] for i in at.tolist())
    want = np.array([count[raw[i : i + length]] > 1 for i in at.tolist()])
    assert (suffixes.repeated(data, at, np.zeros(len(at), dtype=np.int64), length) == want).all()


@pytest.mark.parametrize("most", [2_000, 6, 1])
def test_passages_against_brute_force(spark, docs, texts, monkeypatch, most):
    monkeypatch.setattr(passages, "MOST", most)  # so few, and every bucket with different fragments is cut finer
    shared = "".join(chr(97 + random.Random(5).randrange(26) * (i * i % 7 + 1) % 26) for i in range(700))
    more = [(1000 + i, f"start {i} " + shared + f" end {i}") for i in range(5)] + [(1010, "line again\n" * 200), (1011, shared[:399]), (1012, "é" * 400), (1013, None)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = rows(passages.removed(df))
    every = {**texts, **dict(more)}
    ids = sorted(every)
    want = brute_spans([(every[i] or "").encode() for i in ids], 400)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in ids] == want


def test_a_bucket_of_thousands_of_kinds(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = word(640)  # in every text, between different ends: its anchors' buckets hold a kind for each text
    texts_ = [word(rng.randrange(40, 200)) + shared[: rng.randrange(420, 641)] + word(rng.randrange(40, 200)) for _ in range(2_600)]
    got = rows(passages.removed(spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")))
    want = brute_spans([t.encode() for t in texts_], 400)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts_))] == want
    for i, t in enumerate(texts_):
        assert got[i].n_removed >= 420 and got[i].text == "".join(t[a:z] for a, z in zip([0, *[s.stop for s in got[i].spans]], [*[s.start for s in got[i].spans], len(t)], strict=True))


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    part = word(3_000)
    texts_ = [word(9_000) + part + word(4_000), part[500:] + word(100), word(5_000), part + part]
    monkeypatch.setattr(passages, "SLICE", 1_024)
    data = np.frombuffer(texts_[0].encode(), dtype=np.uint8)
    cut = [(int(c[0]), int(c[-1]), b) for _, c, b in passages._slices(np.array([0, len(data)]), 400)]
    starts = [i for a, z, _ in cut for i in range(a, z - 399)]
    assert starts == list(range(len(data) - 399)) and len(cut) > 10
    frags = []
    for a, z, begin in cut:  # the fragments' windows, put together, are those of the whole text
        _, g, lo, hi, m = passages.window_anchors(data[a:z], np.array([0, z - a]), 400, 64)
        frags += [(int(x) + k + begin, int(h), int(y) + begin) for h, x, last, y in zip(g, lo, hi, m, strict=True) for k in range(int(last - x) + 1)]
    _, g, lo, hi, m = passages.window_anchors(data, np.array([0, len(data)]), 400, 64)
    assert frags == [(int(x) + k, int(h), int(y)) for h, x, last, y in zip(g, lo, hi, m, strict=True) for k in range(int(last - x) + 1)]


# 7 ------------------------------------------------------------------------------------------------------------------


def test_rule_measures_against_plain_loops(spark, docs, texts):
    got = rows(queries.op7_quality_rules(spark, SF))
    for i, t in texts.items():
        words = WORD.findall(t)
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_em_recovers_rule_accuracies():
    rng = np.random.default_rng(7)
    good = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(20_000) < 0.1, 1, np.where(good, np.where(rng.random(20_000) < 0.98, 2, 0), np.where(rng.random(20_000) < bad, 0, 2))) for bad in (0.9, 0.5, 0.7, 0.8)], axis=1)
    codes, counts = np.unique((votes * 3 ** np.arange(4)).sum(axis=1), return_counts=True)
    post, chance, prior = rules.fit(codes, counts.astype(float), 4)
    assert prior == pytest.approx(0.8, abs=0.03)
    assert chance[0, :, 0] / (chance[0, :, 0] + chance[0, :, 2]) == pytest.approx([0.9, 0.5, 0.7, 0.8], abs=0.05)


def test_classes_keep_their_places():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < np.where(good, 0.35, 0.9), 0, 2) for _ in range(5)], axis=1)  # most patterns hold a reject
    codes, counts = np.unique((votes * 3 ** np.arange(5)).sum(axis=1), return_counts=True)
    post, chance, prior = rules.fit(codes, counts.astype(float), 5)
    assert (chance[1, :, 0] < chance[0, :, 0]).all() and prior == pytest.approx(0.7, abs=0.08)
    assert post[np.flatnonzero(codes == (2 * 3 ** np.arange(5)).sum())[0]] > 0.9 and post[np.flatnonzero(codes == 0)[0]] < 0.1


def test_rules_find_junk(spark):
    sf = SF.replace("0.001", "0.01")
    got, bad, kept = rows(queries.op7_quality_rules(spark, sf)), 0, 0
    marks = [r for r in table(spark, sf, "labels").collect()]
    bad = sum(got[r.doc_id].kept for r in marks if r.quality == 0)
    good = [got[r.doc_id].kept for r in marks if r.quality == 1 and not got[r.doc_id].base_failed]
    kept = sum(good) / len(good)
    assert bad <= 1 and kept > 0.97


# 8 ------------------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text)]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, docs, texts):
    rng = random.Random(11)
    base = [f"word{rng.randrange(10**6)}" for _ in range(400)]
    more = {}
    for k in range(12):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(400)] = f"other{k}"
        more[2_000 + k] = " ".join(words)
    more |= {3_000: "", 3_001: "...", 3_002: "A b C", 3_003: "a B c"}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id bigint, text string"))
    got = rows(simhash.near_duplicates(df).withColumn("hex", simhash.hex_fingerprint(F.col("fp"))))
    every = {**texts, **more}
    fps = {i: plain_simhash(t) for i, t in every.items()}
    assert {i: r.hex for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_groups(fps)


def test_links_are_complete_and_come_once(spark):
    rng = random.Random(2)
    start = [rng.getrandbits(64) for _ in range(30)]
    fps = {v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in start for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(4)}
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    got = [(r.fp_a, r.fp_b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "u int, v int"), "u", "v").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 9 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3)])
def test_hilbert_is_a_bijection_of_neighbours(spark, n, bits):
    side = 1 << bits
    df = spark.range(side**n).select(*[((F.col("id") / side**k).cast("bigint") % side).alias(f"c{k}") for k in range(n)])
    got = sorted((r[-1], *r[:-1]) for r in df.withColumn("h", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).collect())
    assert [g[0] for g in got] == list(range(side**n))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:], strict=True)) == 1 for a, b in zip(got, got[1:], strict=False))


def test_shards(spark, docs, texts, odd):
    got = sharding.shard_documents(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in order)
    assert sharding.shard_documents(odd).count() == 11 and sharding.shard_documents(odd.limit(0)).count() == 0


def test_shards_are_written(spark, docs, odd, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8
    sharding.write_shards(odd, str(tmp_path / "odd"), n_shards=3)  # repeated and null ids, clashing names
    own = lambda df: sorted((tuple(r) for r in df.select(odd.columns).collect()), key=repr)
    assert own(spark.read.parquet(str(tmp_path / "odd"))) == own(odd)


def test_copies_are_neighbours(spark, docs):
    rows_ = [(i, "the same text", "en", "a", 1) for i in range(700)] + [(None, "the same text", "en", "a", 1)] * 200 + [(10_000 + i, f"text {i % 37}", "en", "a", 1) for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows_, DOC)).collect()
    assert len(got) == 1_300 and Counter(Counter(r.shard for r in got).values()) == {163: 4, 162: 4}
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    runs = [(r.curve, r.text_crc32) for k, r in enumerate(order) if not k or (r.curve, r.text_crc32) != (order[k - 1].curve, order[k - 1].text_crc32)]
    assert len(runs) == len(set(runs)) == 38
    assert [r.slot for r in order if r.shard == 3] == list(range(sum(r.shard == 3 for r in order)))


def test_names_keep_their_own_coordinate(spark):
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(100)] + [(None,)] * 50 + [("n001",)] * 50, "s string")
    for bits, most in ((5, 32), (7, 101)):
        cuts = sharding.name_cuts(names, "s", bits)
        got = names.distinct().select("s", sharding.name_coordinate(F.col("s"), cuts).alias("c")).orderBy(F.col("s").asc_nulls_first()).collect()
        assert [r.c for r in got] == sorted(r.c for r in got) and len({r.c for r in got}) == most == len(cuts)


# 10 -----------------------------------------------------------------------------------------------------------------


def test_licences(spark, docs, texts):
    mit = "\n".join(["Some heading", "MIT License", "", licences.SENTENCES["mit-grant"].replace(" to deal", "\nto deal"), "", licences.SENTENCES["mit-condition"], "", licences.SENTENCES["mit-warranty"].replace(" WARRANTY", "\nWARRANTY"), "code()"])
    swapped = "\n".join([licences.SENTENCES["mit-condition"], licences.SENTENCES["mit-grant"]])
    cases = {1: mit, 2: "text before.\nReleased under the MIT License.\nafter", 3: "we licensed under the moon", 4: swapped, 5: None, 6: "", 7: "Licensed under CC BY-NC 4.0. All rights reserved."}
    got = rows(licences.scan(spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")))
    assert [(m.licence, m.kind) for m in got[1].matches] == [("MIT", "title"), ("MIT", "text")]
    m = got[1].matches[1]
    assert mit[m.start : m.stop].startswith("Permission is") and mit[m.start : m.stop].endswith("NONINFRINGEMENT")
    assert [m.licence for m in got[2].matches] == ["MIT"] and not got[3].matches and not got[4].matches
    assert list(got[4].sentences) == ["mit-condition", "mit-grant"]
    assert not got[5].matches and not got[6].matches and [m.licence for m in got[7].matches] == ["CC-BY-NC-4.0", "proprietary"]
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    for r in licences.scan(docs).collect():
        assert {m.licence for m in r.matches} >= {k for k, v in notices.items() if v in texts[r.doc_id].split("\n")}


def plain_scan(text):
    """Every known sentence tried at every fragment, the longest first; then every rule at every sentence."""
    known = sorted(((licences.normalise(v), k) for k, v in licences.known_sentences().items()), key=lambda x: -len(x[0]))
    parts = [licences.normalise(x) for x in re.split(r"\n|[.!?;:]+(?=\s|\Z)", text or "")]
    raw = [x for x in re.split(r"\n|[.!?;:]+(?=\s|\Z)", text or "")]
    parts = [p for p, r in zip(parts, raw, strict=True) if r]
    found, at = [], 0
    while at < len(parts):
        step = 1
        for sentence, name in known if parts[at] else ():
            said, upto = parts[at], at
            while upto + 1 < len(parts) and len(said) < len(sentence):
                upto += 1
                said = f"{said} {parts[upto]}".strip()
            if said == sentence:
                while not parts[upto]:
                    upto -= 1
                found.append((at, name, upto))
                step = upto - at + 1
                break
        at += step
    used, out = set(), []
    for i, (_, name, _) in enumerate(found):
        for rule in sorted(licences.RULES, key=lambda r: -len(r.order)) if i not in used else ():
            chain = [i] if rule.order[0] == name else []
            for want in rule.order[1:] if chain else ():
                later = [j for j in range(chain[-1] + 1, len(found)) if j not in used and found[j][1] == want and found[j][0] - found[chain[-1]][2] <= rule.gap + 1]
                if not later:
                    chain = []
                    break
                chain.append(later[0])
            if chain:
                used.update(chain)
                out.append((rule.licence, rule.kind))
                break
    return [n for _, n, _ in found], out


def test_licences_against_plain_search(spark, docs, texts):
    rng = random.Random(21)
    pool = list(licences.known_sentences().values()) + ["Some other words here.", "def run(): return 1", "", "MIT", "This program is free"]

    def wrapped(t):
        words = t.split(" ")
        return " ".join(w + ("\n#" if rng.random() < 0.08 else "") for w in words)

    cases = {i: "\n".join(wrapped(rng.choice(pool)) for _ in range(rng.randrange(1, 25))) for i in range(150)}
    for k, rule in enumerate(licences.RULES):
        cases[1_000 + k] = "\n\n".join(["Heading", *[wrapped(licences.known_sentences()[n]) for n in rule.order], "end"])
    every = {**{-1 - i: t for i, t in cases.items()}, **texts}
    got = rows(licences.scan(spark.createDataFrame(list(every.items()), "doc_id bigint, text string")))
    for i, t in every.items():
        names, matches = plain_scan(t)
        assert list(got[i].sentences) == names and [(m.licence, m.kind) for m in got[i].matches] == matches, t
    for k, rule in enumerate(licences.RULES):
        assert rule.licence in {m.licence for m in got[-1_001 - k].matches}


def test_recognition_is_linear():
    import time

    took = []
    for n in (4_000, 16_000):
        found = [(2 * i, "mit-grant", i, i, 2 * i) for i in range(n)]
        began = time.perf_counter()
        assert not licences.recognise(found)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.05


# All ----------------------------------------------------------------------------------------------------------------

RUNS = {
    "syncmers": syncmers.fingerprints, "mixing": mixing.mixture, "pieces": pieces.encoded, "passages": passages.removed, "rules": rules.judged, "simhash": simhash.near_duplicates,
    "sharding": sharding.shard_documents, "licences": licences.scan,
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_awkward_rows_and_empty_tables(spark, odd, name):
    got = RUNS[name](odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "2", "3", "4", "5", "6", "7", "7", "None", "8", "9"])
    assert RUNS[name](odd.limit(0)).count() == 0
    one = {r.doc_id: r for r in got}
    sevens = [r for r in got if r.doc_id == 7]
    same = lambda f, *ids: len({f(one[i]) for i in ids}) == 1
    if name == "syncmers":
        assert one[1].n_chars == 0 and same(lambda r: r.fingerprint, 1, 2, 9) and one[1].fingerprint == "" and same(lambda r: r.fingerprint, 4, 5) and sevens[0].fingerprint == sevens[1].fingerprint
        order = [one[9], one[8], *sevens, one[6], one[5], one[4], one[3], one[2], one[1], one[None]]
        assert sevens[0].near_next == 1.0 or sevens[1].near_next == 1.0
        assert one[5].near_next == 1.0 and one[2].near_next == 1.0 and len(order) == 11  # 5 is followed by its copy 4, 2 by 1
    elif name == "mixing":
        assert one[1].tokens == one[2].tokens == one[9].tokens == 0 and not any(one[i].sampled or one[i].probability for i in (1, 2, 9)) and one[1].source == "" and one[None].tokens == 3
        assert sevens[0] == sevens[1] and all(0 <= r.probability <= 1 for r in got)
    elif name == "passages":
        assert one[1].n_bytes == 0 and one[1].text == "" and not one[1].spans and sevens[0].n_removed == sevens[1].n_removed == sevens[0].n_bytes and one[8].text == "▁ é漢字🙂 \n\t"
    elif name == "rules":
        assert one[1].n_words == one[2].n_words == one[9].n_words == 0 and one[1].base_failed and not one[1].kept and sevens[0] == sevens[1] and one[7].n_repeat_words == 180
    elif name == "simhash":
        assert one[1].fp == one[2].fp == one[9].fp == 0 and same(lambda r: r.component_id, 1, 2, 9) and same(lambda r: r.component_id, 4, 5)
    elif name == "sharding":
        assert one[1]["size"] == 1 and one[1].text_crc32 == 0 and max(Counter(r.shard for r in got).values()) == 2 and same(lambda r: r.text_crc32, 4, 5)
    elif name == "licences":
        assert not any(r.matches for r in got)
    elif name == "pieces":
        assert one[1].ids is None and one[1].n_pieces == 0 and list(one[2].ids) == [] and sevens[0] == sevens[1] and all(r.lossless for r in got)


def test_awkward_rows_of_fitted_operators(spark, odd):
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 0), (None, 1, 0), (7, None, None), (7, 1, 1), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(odd, labels)
    assert quality.scored(odd, model).filter("score between 0 and 1").count() == 11
    assert quality.fit(odd, labels.limit(0)).score(np.zeros((1, quality.N_TERMS), dtype=np.float32))[0] == 0.5
    assert quality.scored(odd.limit(0), model).count() == 0
    assert set(quality.kept(odd, model).columns) == set(odd.columns)
    out = language.identify(language.corpus_items(spark.createDataFrame([(1, None, None)], "page_id bigint, url string, html string"), odd), language.train(odd))
    assert out.count() == 12


def test_odd_copies_are_removed_and_grouped(spark, odd):
    cut = {(r.doc_id, r.n_removed): r for r in passages.removed(odd).collect()}
    long = len(" ".join(f"w{i % 977}" for i in range(60_000)))
    assert (4, long) in cut and (5, long) in cut and (6, 20_000) in cut and (1, 0) in cut
    groups = defaultdict(list)
    for r in simhash.near_duplicates(odd).collect():
        groups[r.component_id].append(r.doc_id)
    assert sorted(groups[4]) == [4, 5] and groups[7] == [7, 7] and sorted(groups[1]) == [1, 2, 9]
    kept = [r.doc_id for r in simhash.deduplicated(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 4, 6, 7, 8] and None in kept


def test_range_numbers(spark):
    cuts = [-5, 0, 3, 3, 10, 11, 40]
    got = [r.n for r in spark.range(-8, 45).select(F.col("id"), syncmers.range_number(F.col("id"), cuts).alias("n")).orderBy("id").collect()]
    assert got == [sum(c < i for c in cuts) for i in range(-8, 45)]
    assert spark.range(1).select(syncmers.range_number(F.col("id"), []).alias("n")).first().n == 0

"""Suffix-array removal of repeated passages.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else. Blockwise suffix sorting finds them:

1. Every window of LENGTH bytes is put in the bucket of its anchor, the least-hashed GRAM-byte string inside it (the
   leftmost of equals) and its distance to it; equal windows have equal anchors, wherever they stand. Windows with one
   anchor are neighbours, so a fragment of text stands for them, and only its hashes and offsets travel.
2. Anchors that occur once can't hold repeats. Fragments that are equal as a whole are repeats as a whole, so however
   many copies there are, one of them goes on.
3. Buckets that still hold different fragments get their text, and tasks sort them, one block of buckets at a time, by
   suffix with a difference-cover sample (see ``suffixes``). Equal windows are then neighbours, compared byte by byte.
4. A bucket of more than MOST different fragments is too large for a block. Equal windows agree in more than the
   anchor, so such a bucket is cut finer before it is sorted: FINER neighbouring windows of a fragment go to the bucket of
   the bytes that all of them share, as a fragment of their own, and steps 2 and 3 are taken again; what is still too
   large, at FINEST, a window at a time. So a passage that very many texts share costs each of them a few narrow rows,
   and every bucket that holds different fragments is sorted, whatever its size.

Whole texts travel compressed, twice: to where fragments are cut out, and to where spans are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetnet.llm.common import map_batches, partitions, stored
from fleetnet.llm.suffixes import repeated

LENGTH, GRAM = 400, 64
#: Bytes of text that are hashed, or sorted, at a time; a longer text is hashed in pieces that overlap by a window.
SLICE, BLOCK = 1 << 20, 1 << 20
POSITION_BITS = 24
#: Different fragments of a bucket that are sorted together, and neighbouring windows of a fragment in a finer bucket.
MOST, FINER, FINEST = 2000, 16, 1

_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit polynomial hash of the ``gram`` bytes (a power of two) at each position."""
    h, base, width = b.astype(np.uint64) + np.uint64(1), 0x100000001B3, 1
    while width < gram:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), 2 * width
    return h


def window_anchors(b: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor hash, first window, last window, anchor position) of each run of windows with one anchor,
    in texts that lie one after the other in ``b``; positions in ``b``."""
    none = np.zeros(0, dtype=np.int64)
    sizes = np.diff(offsets)
    whole = np.flatnonzero(sizes >= length)
    if not len(whole):
        return none, none.astype(np.uint64), none, none, none
    h = gram_hashes(b, gram)
    bits = np.uint64(POSITION_BITS)
    if len(h) > 1 << POSITION_BITS:
        raise ValueError("passages: a slice is too long to number its positions")
    key = h * _ODD
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key = (key >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span = length - gram + 1
    pad = -len(key) % span
    key = np.concatenate([key, np.full(pad + span, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1]).ravel()
    n = len(b) - length + 1
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    del key, ahead, behind
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.append(True, anchor[1:] != anchor[:-1])
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[offsets[whole]] += 1
    np.add.at(inside, offsets[whole] + sizes[whole] - length + 1, -1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    new[offsets[whole]] = True
    first = np.flatnonzero(new & inside)
    stops = offsets[np.searchsorted(offsets, first, side="right")] - length  # the last window of the text
    last = np.minimum(np.append(first[1:] - 1, n), stops)
    return np.searchsorted(offsets, first, side="right") - 1, h[anchor[first]], first, last, anchor[first]


def _slices(offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first text, offsets of its texts, place in the first text) of runs of texts of about SLICE bytes each; a text that
    is longer comes alone, in pieces that overlap so that every window lies in just one."""
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        begin, end = int(offsets[at]), int(offsets[stop])
        if end - begin <= 2 * SLICE:
            yield at, offsets[at : stop + 1], 0
        else:
            for k in range(begin, end - length + 1, SLICE):
                yield at, np.array([k, min(k + SLICE + length - 1, end)], dtype=np.int64), k - begin
        at = stop


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the texts' offsets in them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, dtype=np.uint8), offsets - offsets[0]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row's key: _id, its id (or a hash of one that is no integer), and _tag, its text's hash, which
    tells rows apart whose ids repeat or are null."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    own = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)) if whole else F.xxhash64("doc_id")
    return docs.withColumns({"_id": own, "_tag": F.xxhash64("text")})


def _place(lo: np.ndarray, m: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A fragment's windows and anchor in one number; m - lo and hi - lo are below 1024."""
    return (lo << 20) | ((m - lo) << 10) | (hi - lo)


def _own_repeats(text: np.ndarray, g: np.ndarray, d: np.ndarray, lo: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(first, times, spans): the first of each text's equal fragments, how often it occurs there, and merged spans
    (text, lo, stop) of those that occur again in their own text, as lines that are repeated over and over do."""
    order = np.lexsort((lo, d, g, text))
    new = np.append(True, (text[order][1:] != text[order][:-1]) | (g[order][1:] != g[order][:-1]) | (d[order][1:] != d[order][:-1])) if len(order) else np.zeros(0, dtype=bool)
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(order)))
    again = np.sort(order[np.repeat(times > 1, times)])  # in order of text and place, as fragments are
    spans: list[tuple[int, int, int]] = []
    for t, a, z in zip(text[again].tolist(), lo[again].tolist(), stop[again].tolist(), strict=True):
        if spans and spans[-1][0] == t and spans[-1][2] >= a:
            spans[-1] = (t, spans[-1][1], max(z, spans[-1][2]))
        else:
            spans.append((t, a, z))
    return order[heads], times, spans


def fragments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(_id, _tag, g, d, at, n): of each text the different fragments, runs of windows with one anchor. g is the
    anchor's hash, d a digest of the fragment's bytes, at its first place, n how often the text has it. g and d together
    are 128 bits. Where n is 0, the row is a span from at to d of fragments that the text itself repeats."""
    if not 0 <= length - gram < 1024:
        raise ValueError("passages: length must be from gram to gram + 1023")
    names = ["_id", "_tag", "g", "d", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(2))
            for a, cuts, begin in _slices(offsets, length):
                part = data[cuts[0] : cuts[-1]]
                text, g, lo, hi, m = window_anchors(part, cuts - cuts[0], length, gram)
                raw, digest = part.tobytes(), xxhash.xxh3_64_intdigest
                d = np.array([digest(raw[s:e]) for s, e in zip(lo.tolist(), (hi + length).tolist(), strict=True)], dtype=np.uint64)
                base = cuts[:-1] - cuts[0] - begin
                first, times, spans = _own_repeats(text, g, d, lo, hi + length)
                t = text[first]
                extra = np.array(spans, dtype=np.int64).reshape(-1, 3)
                own = pa.array(np.concatenate([t, extra[:, 0]]) + a)
                place = _place(lo[first] - base[t], m[first] - base[t], hi[first] - base[t])
                cols = [(g[first].view(np.int64), np.zeros(len(extra), dtype=np.int64)), (d[first].view(np.int64), extra[:, 2] - base[extra[:, 0]]), (place, extra[:, 1] - base[extra[:, 0]]), (times, np.zeros(len(extra), dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(np.concatenate(c)) for c in cols)], names=names)

    return map_batches(rows.select("_id", "_tag", "text"), run, "_id bigint, _tag bigint, g bigint, d bigint, at bigint, n bigint")


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` compressed to binary; null stays null."""
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([None if t is None else press(t) for t in cols[at].cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_batches(rows, run, ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema))


def unpack(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _sorted_spans(wanted: DataFrame, length: int) -> DataFrame:
    """(_id, _tag, lo, stop) of the repeated windows of fragments (_id, _tag, g, at, own, bytes) of like ``g``.

    Runs in a task over the rows of whole buckets, in order of g; ``own`` says whether a fragment's windows are asked for.
    """

    def block(g: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes]) -> list[tuple[int, int, int]]:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        per = hi - lo + 1
        frag = np.repeat(np.arange(len(per)), per)
        start = np.arange(len(frag)) - np.repeat(np.cumsum(per) - per, per)
        kind = np.cumsum(np.append(0, g[1:] != g[:-1]))
        bucket = kind[frag] * np.int64(length + 1) + (m[frag] - lo[frag] - start)
        hit = repeated(np.frombuffer(b"".join(texts), dtype=np.uint8), base[frag] + start, bucket, length)
        at = np.flatnonzero(hit)
        runs = np.append(True, (np.diff(at) > 1) | (frag[at][1:] != frag[at][:-1])) if len(at) else np.zeros(0, dtype=bool)
        heads = at[runs]
        tails = at[np.append(runs[1:], True)] if len(at) else at
        return list(zip(frag[heads].tolist(), (lo[frag[heads]] + start[heads]).tolist(), (lo[frag[heads]] + start[tails] + length).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            g, at = (np.array(cols[k], dtype=np.int64) for k in (2, 3))
            lo = at >> 20
            out = [(cols[0][f], cols[1][f], s, e) for f, s, e in block(g, lo + (at >> 10 & 1023), lo, lo + (at & 1023), cols[5]) if cols[4][f]]
            got = list(zip(*out, strict=True)) if out else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["_id", "_tag", "lo", "stop"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= BLOCK and row[2] != held[-1][2]:  # a block ends with a bucket
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    return map_batches(wanted.select("_id", "_tag", "g", "at", "own", "bytes"), run, "_id bigint, _tag bigint, lo bigint, stop bigint")


def _cores(wanted: DataFrame, length: int, width: int) -> DataFrame:
    """(_id, _tag, g, at, own, k, w): of each fragment its runs of ``width`` neighbouring windows, numbered by their
    distance to the anchor, which equal windows have in common, and a digest of the bytes that all windows of a run share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for f, (at, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                far, windows = at >> 10 & 1023, at & 1023
                out += [(f, k, digest(_core(text, far, k, width, length))) for k in range((far - windows) // width, far // width + 1)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            own = pa.array(cols[0], pa.int64())
            w = pa.array(np.array(cols[2], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in range(5)), pa.array(cols[1], pa.int64()), w], names=["_id", "_tag", "g", "at", "own", "k", "w"])

    return map_batches(wanted.select("_id", "_tag", "g", "at", "own", "bytes"), run, "_id bigint, _tag bigint, g bigint, at bigint, own boolean, k bigint, w bigint")


def _core(text: bytes, far: int, k: int, width: int, length: int) -> bytes:
    """The bytes from the last start to the first end of the windows that start k * width to (k + 1) * width - 1 before the
    anchor; a fragment that has only some of these windows has these bytes all the same."""
    return text[far - k * width : far - (k + 1) * width + 1 + length]


def _finer(wanted: DataFrame, length: int, width: int) -> DataFrame:
    """Fragments (_id, _tag, g, at, own, bytes) of the buckets of ``width`` neighbouring windows with one core: of those
    cores only that occur again; a fragment that isn't asked for stands for two."""
    cores = stored(_cores(wanted, length, width))
    again = cores.groupBy("g", "k", "w").agg(F.sum(F.when(F.col("own"), 1).otherwise(2)).alias("_n")).filter("_n > 1").select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.col("w").alias("_w"))
    kept = cores.join(again, (F.col("g") == F.col("_g")) & (F.col("k") == F.col("_k")) & (F.col("w") == F.col("_w")), "left_semi")
    runs = kept.groupBy(F.col("_id").alias("_i"), F.col("_tag").alias("_t"), F.col("at").alias("_a"), F.col("g").alias("_g")).agg(F.collect_set(F.struct("k", F.xxhash64("g", "k", "w").alias("f"))).alias("runs"))  # no more than a fragment has
    both = wanted.join(runs, (F.col("_id") == F.col("_i")) & (F.col("_tag") == F.col("_t")) & (F.col("at") == F.col("_a")) & (F.col("g") == F.col("_g")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, (at, text, asked) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                lo, far, windows = at >> 20, at >> 10 & 1023, at & 1023
                for r in asked:
                    first, last = max(0, far - (r["k"] + 1) * width + 1), min(windows, far - r["k"] * width)
                    out.append((f, r["f"], (lo + first) << 20 | (far - first) << 10 | (last - first), text[first : last + length]))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            own = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), batch.column(3).take(own), pa.array(cols[3], pa.binary())], names=["_id", "_tag", "g", "at", "own", "bytes"])

    return map_batches(both.select("_id", "_tag", "at", "own", "bytes", "runs"), run, "_id bigint, _tag bigint, g bigint, at bigint, own boolean, bytes binary")


def _settled(cut_out: DataFrame, length: int) -> DataFrame:
    """(_id, _tag, lo, stop) of the repeated windows of fragments (_id, _tag, g, at, own, kinds, bytes), which are different
    in each bucket and stored. Buckets of up to MOST are sorted; larger ones are cut finer, and again, and then sorted."""
    spans = None
    for width in (FINER, FINEST):
        hot, cold = cut_out.filter(F.col("kinds") > MOST), cut_out.filter(F.col("kinds") <= MOST)
        if not hot.limit(1).count():
            break
        found = _sorted_spans(_in_buckets(cold), length)
        spans = found if spans is None else spans.unionByName(found)
        parts = stored(_finer(hot, length, width).withColumn("d", F.xxhash64("bytes")))
        kinds = stored(parts.groupBy("g", "d").agg(F.sum(F.when(F.col("own"), 1).otherwise(2)).alias("c"), F.min(F.struct("_id", "_tag", "at", "bytes")).alias("one")))
        twice = kinds.filter("c > 1").select(F.col("g").alias("_g"), F.col("d").alias("_d"))
        whole = parts.filter("own").join(twice, (F.col("g") == F.col("_g")) & (F.col("d") == F.col("_d")), "left_semi")
        spans = spans.unionByName(_whole_spans(whole, length))
        cut_out = stored(kinds.join(_mixed_buckets(kinds), F.col("g") == F.col("_g")).select("one._id", "one._tag", "g", "one.at", (F.col("c") == 1).alias("own"), "kinds", "one.bytes"))
    rest = _sorted_spans(_in_buckets(cut_out), length)
    return rest if spans is None else spans.unionByName(rest)


def _in_buckets(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g")


def _mixed_buckets(kinds: DataFrame) -> DataFrame:
    """(_g, kinds) of the buckets with different fragments."""
    return kinds.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("kinds")).filter("kinds > 1")


def _whole_spans(rows: DataFrame, length: int) -> DataFrame:
    lo = F.shiftright("at", 20)
    return rows.select("_id", "_tag", lo.alias("lo"), (lo + F.col("at").bitwiseAND(F.lit(1023)) + length).alias("stop"))


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` fragments (_id, _tag, g, at, own, kinds) with their bytes."""
    lists = wanted.groupBy(F.col("_id").alias("_wid"), F.col("_tag").alias("_wtag")).agg(F.collect_list(F.struct("g", "at", "own", "kinds")).alias("f"))  # no more than a text has
    joined = packed(keyed(docs).select("_id", "_tag", "text")).join(lists, (F.col("_id") == F.col("_wid")) & (F.col("_tag") == F.col("_wtag")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = []
                for r, (z, want) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    data = unpack(z.as_py())
                    out += [(r, f["g"], f["at"], f["own"], f["kinds"], data[f["at"] >> 20 : (f["at"] >> 20) + (f["at"] & 1023) + length]) for f in want.as_py()]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                own = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary())], names=["_id", "_tag", "g", "at", "own", "kinds", "bytes"])

    return map_batches(joined.select("_id", "_tag", "text", "f"), run, "_id bigint, _tag bigint, g bigint, at bigint, own boolean, kinds bigint, bytes binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(_id, _tag, lo, stop): byte spans of the texts that are covered by repeated windows; spans may overlap or repeat."""
    rows = stored(fragments(keyed(docs), length, gram))
    inner, found = rows.filter("n = 0").select("_id", "_tag", F.col("at").alias("lo"), F.col("d").alias("stop")), rows.filter("n > 0")
    # Stored, so the join below reads it by an exchange of its own and Spark can split the partition of a frequent anchor.
    often = stored(found.groupBy("g").agg(F.sum("n").alias("_n")).filter("_n > 1").select(F.col("g").alias("_g")))
    live = stored(found.join(often, F.col("g") == F.col("_g"), "left_semi"))

    # Fragments equal as a whole: all repeated if there are two or more; the first of them goes on for its kind.
    kinds = stored(live.groupBy("g", "d").agg(F.sum("n").alias("c"), F.min(F.struct("_id", "_tag", "at")).alias("one")))
    twice = kinds.filter("c > 1").select(F.col("g").alias("_g"), F.col("d").alias("_d"))
    whole = live.join(twice, (F.col("g") == F.col("_g")) & (F.col("d") == F.col("_d")), "left_semi")
    spans = inner.unionByName(_whole_spans(whole, length))
    mixed = kinds.join(_mixed_buckets(kinds), F.col("g") == F.col("_g")).select("one._id", "one._tag", "g", "one.at", (F.col("c") == 1).alias("own"), "kinds")
    mixed = stored(mixed)
    cut_out = _with_bytes(docs, mixed, length)
    if mixed.filter(F.col("kinds") > MOST).limit(1).count():
        return spans.unionByName(_settled(stored(cut_out), length))
    return spans.unionByName(_sorted_spans(_in_buckets(cut_out), length))  # each is read once: no need to store them


def _pass(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of ``docs``, text packed, with _spans (null: none): a join by row key, so copies don't meet in one task."""
    spans = repeated_spans(docs, length, gram)
    lists = spans.groupBy(F.col("_id").alias("_sid"), F.col("_tag").alias("_stag")).agg(F.collect_set(F.struct("lo", "stop")).alias("_spans"))
    joined = packed(keyed(docs)).join(lists, (F.col("_id") == F.col("_sid")) & (F.col("_tag") == F.col("_stag")), "left")
    return joined.drop("_id", "_tag", "_sid", "_stag")


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left, maximal removed runs) of a text less its spans, which may overlap."""
    runs: list[tuple[int, int]] = []
    for lo, stop in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(stop, runs[-1][1]))
        else:
            runs.append((lo, stop))
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)), runs


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and text of every row of ``docs`` (doc_id, text), removal done.

    spans: the maximal removed runs, as struct(start, stop) in bytes of the text. text: what is left; the digest is of its
    bytes, of which a cut inside a character drops that character's remains from the text. Null texts count as empty. Rows that repeat count for one another: all their bytes go if they have ``length`` or
    more. Other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for text, spans in zip(part.column(1), part.column(2), strict=True):
                    data = unpack(text.as_py())
                    kept, gone = cut_spans(data, [(s["lo"], s["stop"]) for s in spans.as_py() or ()])
                    rows.append((len(data), sum(z - a for a, z in gone), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": z} for a, z in gone], kept.decode("utf-8", "ignore")))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], kind_of_spans), pa.array(cols[5], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])

    kind_of_spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(_pass(docs.select("doc_id", "text"), length, gram).select("doc_id", "text", "_spans"), run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, text string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with its columns, repeated passages cut from ``text`` and n_chars, if there, counted anew.

    A cut inside a character drops what is left of it. Null texts stay null.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                own = text.as_py()
                texts.append(None if own is None else cut_spans(unpack(own), [(s["lo"], s["stop"]) for s in spans.as_py() or ()])[0].decode("utf-8", "ignore"))
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    out = map_batches(_pass(docs, length, gram).select(*docs.columns, "_spans"), run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

"""Near copies: texts whose sets of five-word shingles have a Jaccard likeness of 4/5 or more, no link lost.

SimHash links come first: fingerprints of the same shingles, put together by deletion-variant signatures (see ``simhash``),
propose pairs, which are verified on the whole sets. By themselves they can't find all: at likeness 0.8 two fingerprints of
64 bits differ in about ten. So an exact completion follows. Two sets of n and m shingles with likeness 4/5 or more share
one of the first n // 5 + 1 and m // 5 + 1 in any order common to all sets (prefix filter). The order here is by the
frequency in a sample of the texts, then by hash; the sample bears on the cost only. Each shingle of these prefixes is a
key, and what has no other text at any of its keys is never looked at again.

Texts with equal sets are one node. Keys of two texts give that pair. Of keys with more, first the least and the greatest
node meet, then all members one of them, in rounds; only pairs of nodes that aren't in one component by then are made. A
key lies among the first fifth of a set's shingles, the frequent ones last, so texts that share one and are not near are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetnet.llm import simhash
from fleetnet.llm.common import map_batches, stored
from fleetnet.llm.graphs import components

SHINGLE_WORDS = 5
#: One in SAMPLE texts is counted for the order; shingles of SEEN or more of them, at most about MOST_COMMON, go last.
SAMPLE, SEEN, MOST_COMMON = 32, 2, 1 << 20
#: Rounds in which a key's members meet one of them only.
STAR_ROUNDS = 2
#: Rows whose texts are asked for that are broadcast if there are no more, counted first; else both sides are shuffled.
#: Over FEW_ROWS they go as sorted arrays (24 bytes a row, 12 MB at most), not as a hash table, of which the driver holds several copies.
MOST_ROWS, FEW_ROWS = 500_000, 50_000


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes, as signed integers."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE_WORDS).view(np.int64))


def _node(shingles: np.ndarray) -> int:
    """A set's number: equal sets have equal ones."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many sampled texts share, sorted, and in how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(0)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets), pa.int64())], names=["h"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    seen = stored(map_batches(some, run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN))
    least, total = SEEN, 0
    for r in sorted(seen.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count("*").alias("k")).collect(), reverse=True):  # at most 4,096 rows
        total += r["k"]
        if total > MOST_COMMON:
            least = r["n"] + 1
            break
    rows = seen.filter(F.col("n") >= least).toArrow()
    h, n = rows.column("h").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, text_hash, node, fp, n, prefix) of every row: its set's number, SimHash and size, and the first n // 5 + 1
    of its shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def first(s: np.ndarray) -> np.ndarray:
        known, counts = shared.value
        seen = np.zeros(len(s), dtype=np.int64)
        if len(known) and len(s):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            seen = np.where(known[at] == s, counts[at], 0)
        return s[np.lexsort((s, seen))[: len(s) // 5 + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [simhash.shingle_hashes(t.as_py(), SHINGLE_WORDS) for t in batch.column(2)]
            sets = [np.unique(h.view(np.int64)) for h in hashes]
            columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([simhash.bits_of(h) for h in hashes], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([first(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "node", "fp", "n", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, f"doc_id {kind}, text_hash bigint, node bigint, fp bigint, n int, prefix array<bigint>")


def _sorted_rows(wanted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``wanted`` (node, _i, _h) as arrays in order of its rows' hashes: hash, text's hash, node; None if two hashes are equal."""
    rows = wanted.select(F.xxhash64("_i", "_h").alias("k"), "_h", "node").toArrow()
    key, text, node = (rows.column(c).to_numpy() for c in range(3))
    order = np.argsort(key)
    key = key[order]
    return None if (key[1:] == key[:-1]).any() else (key, text[order], node[order])


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed) of the rows that ``wanted`` (node, doc_id, text_hash) names, repeated rows repeatedly: texts
    compressed, which are smaller than their sets."""

    def pack(node: pa.Array, text: pa.Array) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([node, pa.array([press(t) for t in text.cast(pa.large_binary()).to_pylist()], pa.binary())], names=["node", "packed"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pack(batch.column(0), batch.column(1))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts, nodes = shared.value
        for batch in batches:
            key, text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            found = np.flatnonzero((known[at] == key) & (texts[at] == text))
            yield pack(pa.array(nodes[at[found]], pa.int64()), batch.column(2).take(pa.array(found)))

    w = stored(wanted.select("node", F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")))
    n = w.limit(MOST_ROWS + 1).count()
    if FEW_ROWS < n <= MOST_ROWS and (rows := _sorted_rows(w)):
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        return map_batches(docs.select(F.xxhash64("doc_id", F.xxhash64("text")), F.xxhash64("text"), "text"), picked, "node bigint, packed binary")
    rows = docs.select("doc_id", "text").join(F.broadcast(w) if n <= FEW_ROWS else w, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64("text") == F.col("_h")))
    return map_batches(rows.select("node", "text"), joined, "node bigint, packed binary")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, repeats: bool) -> DataFrame:
    """The ``pairs`` (a, b) of ``nodes`` (node, n, doc_id, text_hash) whose sets have a likeness of 4/5 or more.

    Pairs whose sizes rule it out go first; texts of the others meet. ``repeats``: whether rows repeat both id and text, so
    that a node's text can come more than once.
    """
    size = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"))
    able = pairs.distinct().join(size("a"), "a").join(size("b"), "b").filter(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    pairs = stored(able.select("a", "b"))
    if not pairs.limit(1).count():
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = packed_texts(docs, nodes.join(ends, "node", "left_semi"))
    texts = stored(texts.dropDuplicates(["node"]) if repeats else texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        @lru_cache(maxsize=64)
        def known(packed: bytes) -> np.ndarray:
            return shingle_set(unpack(packed).decode("utf-8", "surrogatepass"))

        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = known(x.as_py()), known(y.as_py())
                near.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda k: texts.select(F.col("node").alias(k), F.col("packed").alias(f"_{k}"))
    return stored(map_batches(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b"), run, "a bigint, b bigint"))


def _possible(a: str, b: str) -> Column:
    """Whether two sets can be near whose first common shingle is the key."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * most >= 4 * (n + m))


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with comp, each node's component over ``links``, of the keys that nodes of several components have."""
    roots = stored(components(links, "a", "b").select(F.col("node").alias("_node"), "root"))
    named = stored(rows.join(roots, F.col("node") == F.col("_node"), "left").withColumn("comp", F.coalesce("root", "node")).drop("_node", "root"))
    several = named.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).filter("_x <> _y").select("key")
    return stored(named.join(several, "key", "left_semi"))


def _simhash_pairs(own: DataFrame) -> DataFrame:
    """(a, b): nodes with equal fingerprints, the least and the greatest of each, and the least of linked ones."""
    prints = stored(own.groupBy("fp").agg(F.min("node").alias("a"), F.max("node").alias("b")))
    linked = stored(simhash.links(prints.select("fp")))
    one = lambda k, name: prints.select(F.col("fp").alias(k), F.col("a").alias(name))
    far = linked.join(one("fp_a", "x"), "fp_a").join(one("fp_b", "y"), "fp_b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return prints.filter("a <> b").select("a", "b").unionByName(far.filter("a <> b"))


def near_links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): nodes with a likeness of 4/5 or more, enough of them that components over them are those over all."""
    repeats = own.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count() > 0
    nodes = stored(own.groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("_f")).select("node", "n", "_f.doc_id", "_f.text_hash"))
    keyed = own.select("node", F.explode("prefix").alias("key"))
    twice = stored(keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").cast("int").alias("k")).filter("a <> b"))
    links = verified(_simhash_pairs(own).unionByName(twice.select("a", "b")), docs, nodes, repeats)
    rest_of_keys = stored(twice.filter("k > 2").select("key"))  # two rows are one pair, and that has been looked at
    placed = own.select("node", "n", F.posexplode("prefix").alias("pos", "key")).join(rest_of_keys.hint("merge"), "key", "left_semi")  # alike at every size
    open_rows = _grouped(stored(placed.distinct()), links)
    for k in range(STAR_ROUNDS):
        if not open_rows.limit(1).count():  # no key left that two components have
            return links
        one = open_rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("comp", F.lit(k)), "node", "n", "pos", "comp")).alias("_o")).select(F.col("key"), "_o.node", "_o.n", "_o.pos", "_o.comp")
        met = open_rows.alias("a").join(one.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & _possible("a", "b"))
        links = links.unionByName(verified(met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")), docs, nodes, repeats))
        open_rows = _grouped(open_rows.drop("comp"), links)
    rest = open_rows.alias("a").join(open_rows.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & _possible("a", "b"))
    return links.unionByName(verified(rest.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), docs, nodes, repeats))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, component_id) of every row: the smallest doc_id of its component, over links of likeness 4/5 or more.

    Null and empty texts have no shingles and are copies of each other. A null doc_id is a component's id only where it
    has no other. Repeated rows each keep a row, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = stored(prefixes(rows, common_shingles(rows)))
    roots = components(near_links(rows, own), "a", "b").select(F.col("node").alias("_node"), "root")
    least = own.groupBy("node").agg(F.min("doc_id").alias("_least"))
    rooted = stored(least.join(roots, F.col("node") == F.col("_node"), "left").select("node", "_least", F.coalesce("root", "node").alias("_root")))
    ids = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return own.select("doc_id", "text_hash", "node").join(rooted.join(ids, "_root").select("node", "component_id"), "node").select("doc_id", "text_hash", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: its smallest doc_id's, the first of them where that id repeats."""
    found = near_duplicates(docs).select(F.col("doc_id").alias("_id"), "component_id").filter(F.col("_id").eqNullSafe(F.col("component_id"))).distinct()
    kept = docs.join(stored(found), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    ids = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not ids:  # ids are unique, as a rule: no shuffle of whole texts
        return kept
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).filter("_n = 1").drop("_n")

"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at up to four differing bits. Cut into three segments, two linked fingerprints differ by
at most one bit in some segment, so they share a variant of that segment in which one bit is a wildcard. Every distinct
fingerprint is indexed under its 64 one-wildcard variants, an equality join on (wildcard, rest of the segment) proposes
pairs and the join's own condition verifies them; it also accepts each pair under one variant only, so a pair comes out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetnet.llm.common import map_batches, stored
from fleetnet.llm.graphs import components

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: (lowest bit, bits) of the three segments; MAX_BITS // 3 = 1.
SEGMENTS = ((0, 21), (21, 21), (42, 22))

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, lower-cased in A-Z; of all words if there are fewer; none: empty."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    line = b" ".join(words)
    after = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *after[: len(words) - size].tolist()]
    ends = (after[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """A fingerprint as a signed 64-bit integer: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # very long texts in pieces
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text's shingles."""
    return bits_of(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([simhash(t.as_py(), size) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp bigint")


def _mask(segment: tuple[int, int]) -> int:
    value = ((1 << segment[1]) - 1) << segment[0]
    return value - (1 << 64) if value >> 63 else value


def _bit(p: int) -> int:
    return 1 << p if p < 63 else -(1 << 63)


def variants(fp: Column) -> Column:
    """The 64 variants: struct(wild, rest), ``rest`` being the segment of bit ``wild`` with that bit cleared."""
    return F.array(*[F.struct(F.lit(p).alias("wild"), fp.bitwiseAND(F.lit(_mask(s) & ~_bit(p))).alias("rest")) for s in SEGMENTS for p in range(s[0], s[0] + s[1])])


def _accepts(x: Column, wild: Column) -> Column:
    """Whether the pair with difference ``x`` (at most MAX_BITS bits) is to come out under the variant ``wild``: the
    first segment with at most one differing bit, at that bit, or at the segment's lowest if it is equal there."""
    out = F.lit(False)
    for s in reversed(SEGMENTS):
        part = x.bitwiseAND(F.lit(_mask(s)))
        here = F.when(part == 0, wild == s[0]).otherwise(F.expr("shiftleft(1L, {w})".format(w="a.wild")) == part)
        out = F.when(F.bit_count(part) <= 1, wild.between(s[0], s[0] + s[1] - 1) & here).otherwise(out)
    return out


def links(distinct_fps: DataFrame) -> DataFrame:
    """(fp_a, fp_b) with fp_a < fp_b for each two distinct fingerprints of column ``fp`` with up to MAX_BITS differing bits."""
    keyed = distinct_fps.select("fp", F.explode(variants(F.col("fp"))).alias("_v")).select("fp", "_v.wild", "_v.rest")
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = (F.col("a.wild") == F.col("b.wild")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= MAX_BITS) & _accepts(x, F.col("a.wild"))
    return a.join(b, near).select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own included. Null and empty texts have
    fingerprint 0 and link like any other. Rows that repeat each keep a row; null doc_ids are never a component's id
    unless it has no other. Other columns are ignored; an empty table gives an empty result.
    """
    own = stored(fingerprints(docs))
    classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("_least")))  # copies meet here, before any key is spread
    roots = components(links(classes), "fp_a", "fp_b")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = stored(rooted.join(least, "_root").select(F.col("fp").alias("_fp"), "component_id"))
    return own.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: its smallest doc_id's, the first of them where that id repeats."""
    found = near_duplicates(docs).select(F.col("doc_id").alias("_id"), "component_id").filter(F.col("_id").eqNullSafe(F.col("component_id"))).distinct()
    kept = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    ids = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not ids:  # ids are unique, as a rule: no shuffle of whole texts
        return kept
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).filter("_n = 1").drop("_n")

"""Document fingerprints of closed syncmers [native].

A text is a sequence of tokens: words, and of runs of over TOKEN_CHARS characters without white space, as in scripts
without spaces or in minified text, single characters, so a character put in or left out moves no other token. A run of K
tokens is a closed syncmer if, of the runs of S tokens inside it, the one with the least hash is the first or the last. Whether a run
is chosen depends on its own tokens only, so the same passage gives the same anchors wherever it stands.
The fingerprint is the SKETCH least distinct anchor hashes; likeness is the Jaccard estimate over two sketches' union.
Where a passage lies in two texts is told by anchors that both have, at one distance (``matched_passages``).

Whole texts travel once: they are dealt to contiguous ranges of doc_id, where a window finds each row's next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetnet.llm.common import let, partitions

K, S = 5, 2
TOKEN_CHARS = 16
SKETCH = 64
#: Hexadecimal digits of an anchor's hash in a fingerprint.
DIGITS = 10

_TOKEN = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{TOKEN_CHARS}}}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def anchors(hashes: Column) -> Column:
    """array<struct<pos int, hash bigint>> of the closed syncmers of a token-hash array, in order of position.

    Where there is none, as with fewer than K tokens and with some texts of K to K + S - 1, but there are tokens, the
    whole sequence is the only anchor.
    """
    def chosen(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))

        def pick(g: Column) -> Column:
            last = K - S
            edge = lambda i: F.least(F.get(g, i), F.get(g, i + last)) <= F.least(*[F.get(g, i + j) for j in range(1, last)])
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - K), edge), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.get(g, i), F.get(h, i + 2), F.get(g, i + 3)).alias("hash")))

        return let(inner, pick)

    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    whole = lambda h: F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
    some = lambda h: let(chosen(h), lambda c: F.when(F.size(c) > 0, c).otherwise(whole(h)))
    return let(hashes, lambda h: F.when(F.size(h) >= K, some(h)).when(F.size(h) > 0, whole(h)).otherwise(none))


def sketch(found: Column) -> Column:
    """The least SKETCH distinct anchor hashes, as fixed-width hexadecimal strings in order."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda a: F.substring(F.lpad(F.hex(a["hash"]), 16, "0"), 1, DIGITS)))), 1, SKETCH)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sketches: the share of both among the least SKETCH of their union; of two empty ones 1."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    common = lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)
    return let(both, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common(u)))


def document_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, hash): every anchor of every row of ``docs`` (doc_id, text), for positional matching."""
    return docs.select("doc_id", F.explode(anchors(token_hashes(F.coalesce("text", F.lit(""))))).alias("_a")).select("doc_id", "_a.pos", "_a.hash")


def matched_passages(pairs: DataFrame, found: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shift, n_anchors, a_from, a_to): of each pair (a, b: doc_ids) the passages that both have, as ``least`` or more
    anchors at one distance: token p of a is token p - shift of b, from a_from to the last anchor's first token a_to.

    ``found``: document_anchors of both. An anchor that a text has several times counts at each of its distances. Pairs
    meet their own anchors only, so what joins is bounded by the pairs' texts. Ids that are null or in no pair have no row.
    """
    wanted = pairs.select("a", "b").distinct()
    one = lambda k: found.select(F.col("doc_id").alias(k), F.col("hash"), F.col("pos").alias(f"_{k}"))
    both = wanted.join(one("a"), "a").join(one("b"), ["b", "hash"]).withColumn("shift", F.col("_a") - F.col("_b"))
    return both.groupBy("a", "b", "shift").agg(F.countDistinct("_a").alias("n_anchors"), F.min("_a").alias("a_from"), F.max("_a").alias("a_to")).filter(F.col("n_anchors") >= least).select("a", "b", "shift", "n_anchors", "a_from", "a_to")


def range_number(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below a value, by binary search."""
    low = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)]) if cuts else F.array().cast("array<int>")
    go = lambda at, step: F.when((at + step <= len(cuts)) & (F.get(low, F.least(at + step, F.lit(len(cuts))) - 1) < value), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), go)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each row with the row after it in descending doc_id.

    After the last row comes the first. Equal ids go by their text's hash and then the text, null ids come last, null
    texts are empty. Rows are dealt by ranges of doc_id; the first row of each range is also sent to the range above it.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_id"), text.alias("text"))
    n = max(4 * partitions(spark), 2)
    cuts = base.select(F.percentile_approx("_id", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("q")).first()["q"] or []
    ranged = base.withColumn("_range", range_number(F.col("_id"), sorted(set(cuts))))
    firsts = {r["_range"]: r["m"] for r in ranged.groupBy("_range").agg(F.max("_id").alias("m")).collect()}  # a row for each range
    there = sorted(firsts)
    goes = {firsts[r]: there[(k + 1) % len(there)] for k, r in enumerate(there)}  # a range's first row follows the last of the range above
    ranged = ranged.withColumn("sketch", sketch(anchors(token_hashes(F.col("text")))))
    rows = ranged.withColumn("_real", F.lit(True))
    if goes:
        to = F.element_at(F.create_map(*[F.lit(x) for pair in goes.items() for x in pair]), F.col("_id"))
        extra = ranged.filter(F.col("_id").isin(list(goes))).withColumn("_range", to).withColumn("_real", F.lit(False))
        rows = rows.unionByName(extra)
    order = Window.partitionBy("_range").orderBy(F.desc("_real"), F.desc("_id"), F.xxhash64("text"), "text")
    out = rows.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    return out.filter("_real").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null
    texts count as empty, a lone row is its own next, other columns are ignored, an empty table gives an empty result.
    """
    pairs = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("_edited"), "sketch", "next_sketch")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(anchors(token_hashes(F.col("_edited")))).alias("_es"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("sketch", "").alias("fingerprint"), F.array_join("_es", "").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("_es")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )

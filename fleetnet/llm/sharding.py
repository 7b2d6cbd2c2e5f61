"""Sharding along a Hilbert curve over quantised metadata [native].

Several metadata dimensions are quantised to a small grid, grid cells are numbered by a Hilbert curve, documents are
ordered by (curve index, text checksum, doc_id) and the order is cut into runs of equal row count. Neighbouring cells share
metadata in every dimension, so each shard covers a compact box and file statistics prune on any of them.

Rows are dealt by ranges of (curve index, text, doc_id) and numbered in their range; a range's numbers start after those
of the ranges before it. So neither a cell, nor a source, nor a group of copies that holds most of the rows is sorted by
one task; only a row for each range is summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetnet.llm.common import cut, stored
from fleetnet.operators.ranks import in_order

BITS = 5


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """The Hilbert-curve index of integer coordinates below 2^bits, by Skilling's transpose construction."""
    n = len(coords)
    x = F.array(*[c.cast("int") for c in coords])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(acc: Column, step: Column) -> Column:
        low, own, head = step["q"] - 1, F.get(acc, step["i"]), F.get(acc, F.lit(0))
        swap = head.bitwiseXOR(own).bitwiseAND(low)
        inverted = F.transform(acc, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
        exchanged = F.transform(acc, lambda v, k: F.when((k == 0) | (k == step["i"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(step["q"]) != 0, inverted).otherwise(exchanged)

    x = F.aggregate(x, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(v)), lambda acc: F.aggregate(steps, acc, undo)) if bits > 1 else x
    gray = F.aggregate(x, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0)).bitwiseXOR(v))))

    def interleave(g: Column) -> Column:
        qs = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
        t = F.aggregate(qs, F.lit(0), lambda acc, q: F.when(F.element_at(g, -1).bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        out = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = out * 2 + F.shiftright(F.get(g, F.lit(i)).bitwiseXOR(t), b).bitwiseAND(F.lit(1))
        return out

    return F.get(F.transform(F.array(gray), interleave), 0)


def name_cuts(names: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """At most 2^bits first names of runs of neighbouring names, with like numbers of distinct names in each run.

    Up to 2^bits names each have a run of their own; of more, neighbours share one, so a file's least and greatest name
    still tell what is in it.
    """
    kinds = names.select(F.coalesce(F.col(column), F.lit("")).alias("_name")).distinct()
    placed = in_order(kinds, [F.col("_name")], "_pos", "_all")
    run = F.expr(f"_pos * {1 << bits} div greatest(_all, {1 << bits})")
    return sorted(r["m"] for r in placed.groupBy(run.alias("_run")).agg(F.min("_name").alias("m")).collect())  # 2^bits rows


def name_coordinate(name: Column, cuts: list[str]) -> Column:
    """The number of a name's run."""
    own = F.coalesce(name.cast("string"), F.lit(""))
    return F.greatest(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= own)) - 1, F.lit(0)) if cuts else F.lit(0)


def size_coordinate(size: Column, bits: int = BITS) -> Column:
    """A size on a half-octave scale."""
    return F.least(F.floor(F.log2(size.cast("double")) * 2), F.lit((1 << bits) - 1)).cast("int")


def _placed(docs: DataFrame, n_shards: int, bits: int, carry: bool) -> DataFrame:
    """shard_documents' columns, and with ``carry`` _doc, the whole row of ``docs`` as a struct."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if carry else []
    base = stored(docs.select(F.col("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), name("source").alias("_source"), name("lang").alias("_lang"), F.monotonically_increasing_id().alias("_row"), *whole))
    cuts = {c: name_cuts(base, c, bits) for c in ("_source", "_lang")}
    base = base.withColumn("_cell", F.array(size_coordinate(F.col("size"), bits), *[name_coordinate(F.col(c), cuts[c]) for c in cuts]))
    cells = base.select("_cell").distinct().select(F.col("_cell").alias("_at"), hilbert_index([F.get("_cell", F.lit(i)) for i in range(3)], bits).alias("curve"))
    rows = base.join(F.broadcast(cut(cells)), F.col("_cell") == F.col("_at"))  # one row for each cell: 2^15 at most, whatever the input
    rows = in_order(rows.select("doc_id", "size", "text_crc32", "curve", "_row", *["_doc"] * carry), [F.col(c) for c in ("curve", "text_crc32", "doc_id", "_row")], "_rank", "_all")
    first = F.expr(f"(shard * _all + {n_shards - 1}) div {n_shards}")
    rows = rows.withColumn("shard", F.expr(f"_rank * {n_shards} div _all").cast("int"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *["_doc"] * carry)


def shard_documents(docs: DataFrame, n_shards: int = 8, bits: int = BITS) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text, lang, source) in a shard; law ``rows``: counts at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (null: of the empty text), law,
    shard, slot (gapless from 0 inside the shard, in curve order), grown_shard (null: this law moves rows when a shard
    is added) and curve. In a cell, rows come by the checksum of their text, so copies of one source and language are
    neighbours, then by doc_id, null first, and repeated rows, which keep a slot each, as they come. Null source or lang
    count as the empty name, other columns are ignored, an empty table gives an empty result.
    """
    return _placed(docs.select("doc_id", "text", "lang", "source"), n_shards, bits, carry=False)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, bits: int = BITS) -> None:
    """Write ``docs``, with their own columns, into ``path/shard=<n>/``, each shard in slot order.

    Whole rows are placed, not joined to their places, so repeated and null ids come out as often as they go in.
    """
    rows = _placed(docs, n_shards, bits, carry=True).select("shard", "slot", "_doc")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("shard", "_doc.*").write.partitionBy("shard").parquet(path)

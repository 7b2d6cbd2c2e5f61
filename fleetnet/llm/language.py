"""Language identification by Bayesian evidence fusion.

For every item the log-likelihood of its text under each language (hashed byte trigrams, tempered) is combined with
 * the language that its markup declares, by how often items of each language declare what they do, and
 * a prior of its host, smoothed towards its registered domain's, its address suffix's and the whole corpus's.
Declared-language tables and priors are grouped aggregates of the items' text posteriors over the whole corpus; an
item's own share is taken out of its priors, so its text isn't counted twice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetnet.llm.common import cut, let, map_batches, stored, unit

#: Bound of each language's sample of labelled texts that the text model is fitted on.
ROWS_PER_LANGUAGE = 1000
BUCKETS = 1 << 14
#: A text's evidence saturates at this many trigrams' worth.
TEXT_WEIGHT = 200.0
#: Items' worth of the level above in a host's, domain's or suffix's prior.
SMOOTHING = 5.0
#: Languages that are told apart, those with most labelled rows; texts of all further ones are learnt together as OTHER.
MAX_LANGUAGES, OTHER = 128, "other"
#: Address suffixes, and hosts, up to which their tables are broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 100_000

_DROP = re.compile(r"(?is)<(script|style|nav|footer|aside|head|noscript)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\">.*?</div>")
_TAG = re.compile(r"(?s)<[^>]*>")


def visible_text(page: str) -> str:
    """A page's text without tags, scripts, styles, navigation, advertisements and footers."""
    return html.unescape(_TAG.sub(" ", _DROP.sub(" ", page)))


def _codes(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    return ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(18)) if len(b) > 2 else np.zeros(0, dtype=np.uint32)


class TextModel:
    """Trigram log-probabilities of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts.astype(np.float64) + 0.5
        self.logs = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)) if len(languages) else np.zeros((BUCKETS, 0), dtype=np.float32)

    def loglik(self, text: str) -> np.ndarray:
        codes = _codes(text)
        total = np.zeros(len(self.languages))
        for at in range(0, len(codes), 1 << 16):
            total += self.logs[codes[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total * (TEXT_WEIGHT / (TEXT_WEIGHT + len(codes)))


def train(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE, most: int = MAX_LANGUAGES) -> TextModel:
    """Fit on about ``rows`` texts of each language of ``labelled`` (doc_id, text, lang), chosen by a hash of their id and
    text, so a rare language is learnt as well as a frequent one; beyond ``most`` languages the least frequent are one,
    OTHER. Only trigram counts reach the driver, at most (most + 1) * BUCKETS."""
    marked = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    sizes = cut(marked.groupBy("lang").agg(F.count("*").alias("n")))
    named = [r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(most).collect()]
    own = F.when(F.col("lang").isin(named), F.col("lang")).otherwise(OTHER) if named else F.col("lang")
    marked = marked.withColumn("lang", own)
    rates = {r["lang"]: rows / r["n"] for r in sizes.withColumn("lang", own).groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # most + 1 rows
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("lang")) if rates else F.lit(0.0)
    chosen = marked.filter(unit(F.lit(3), F.col("doc_id"), F.xxhash64("text")) < rate).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang] = held.get(lang, 0) + np.bincount(_codes(text), minlength=BUCKETS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    found = map_batches(chosen, run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rates)
    counts = np.zeros((len(languages), BUCKETS))
    if len(found):
        counts[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy(int)] = found["n"].to_numpy()
    return TextModel(languages, counts)


def address(url: Column) -> list[Column]:
    """_host, _domain (its last two labels) and _suffix (its last) of an address; null: empty names."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return [host.alias("_host"), F.substring_index(host, ".", -2).alias("_domain"), F.substring_index(host, ".", -1).alias("_suffix")]


def declared_language(page: Column) -> Column:
    """The primary subtag that the html element, or a content-language header, declares; else empty."""
    own = F.lower(F.regexp_extract(page, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    head = F.lower(F.regexp_extract(page, r"(?i)http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*?content\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    return F.coalesce(F.when(own != "", own).otherwise(head), F.lit(""))


def _softmax(logs: Column) -> Column:
    return let(F.array_max(logs), lambda top: let(F.transform(logs, lambda x: F.exp(x - top)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda z: F.transform(e, lambda x: x / z))))


def _mixed(counts: Column, own: Column, above: Column) -> Column:
    """(counts - own + SMOOTHING * above) over its sum, entry by entry."""
    raw = F.zip_with(F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0))), above, lambda c, p: c + SMOOTHING * p)
    return let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda z: F.transform(r, lambda x: x / z)))


def identify(items: DataFrame, model: TextModel) -> DataFrame:
    """Fuse the evidence for every row of ``items`` (id, content, url, declared, is_page).

    Returns id, is_page, host, declared, text_lang, lang, posterior and evidence (posteriors by language). Rows whose
    content is null or empty go by their other evidence; unknown declarations count as one value, missing ones as none;
    rows without an address share the corpus's prior. Columns of other names are ignored. Without any language (no labelled text) lang is null. Repeated
    rows count and come out each; an empty table gives an empty result.
    """
    spark, languages = items.sparkSession, model.languages
    n = len(languages)
    kinds = dict(items.dtypes)
    if not n:
        empty = F.lit(None).cast("string")
        return items.select("id", "is_page", address(F.col("url"))[0].alias("host"), "declared", empty.alias("text_lang"), empty.alias("lang"), F.lit(None).cast("double").alias("posterior"), F.array().cast("array<double>").alias("evidence"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, pages, rest = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.columns[2:]
            logs = [shared.value.loglik(visible_text(t or "") if p else t or "") for t, p in zip(texts, pages, strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1, dtype=np.int32) * n), pa.array(np.concatenate(logs) if logs else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([ids, flat, *rest], names=["id", "_text", "is_page", "declared", "_host", "_domain", "_suffix"])

    rows = map_batches(items.select("id", "content", "is_page", "declared", *address(F.col("url"))), run, f"id {kinds['id']}, _text array<double>, is_page boolean, declared string, _host string, _domain string, _suffix string")
    rows = stored(rows.withColumn("_post", _softmax(F.col("_text"))).withColumn("_said", F.when(F.col("declared").isNull(), "").when(F.col("declared").isin("", *languages), F.col("declared")).otherwise(OTHER)))
    sums = [F.sum(F.get("_post", F.lit(i))) for i in range(n)]
    vector = F.array(*sums)

    said = rows.filter("_said <> ''").groupBy("_said").agg(vector.alias("_c"))  # at most a row for each language and OTHER
    heard = {r["_said"]: r["_c"] for r in said.collect()}
    values = list(dict.fromkeys([*languages, OTHER]))
    table = np.array([heard.get(x, [0.0] * n) for x in values]) + 0.5
    chance = np.log(table / table.sum(axis=0))
    literal = F.map_from_arrays(F.array(*map(F.lit, ["", *values])), F.array(*[F.array(*map(F.lit, row)) for row in [[0.0] * n, *chance.tolist()]]))

    overall = rows.agg(vector.alias("_c")).first()["_c"]
    base = np.array([x or 0.0 for x in overall]) + 1.0
    top = F.array(*map(F.lit, (base / base.sum()).tolist()))
    hosts = stored(rows.filter("_host <> ''").groupBy("_host", "_domain", "_suffix").agg(vector.alias("_h")))
    up = lambda key, name: hosts.groupBy(key).agg(F.array(*[F.sum(F.get("_h", F.lit(i))) for i in range(n)]).alias(name))
    priors = stored(hosts.join(_small(up("_domain", "_d")), "_domain").join(_small(up("_suffix", "_s")), "_suffix").select(F.col("_host").alias("_at"), "_h", "_d", "_s"))

    # Rows without a host meet no prior but the corpus's, so they don't go through the join, where they would be one key.
    with_host = rows.filter("_host <> ''").join(_small(priors), F.col("_host") == F.col("_at"))
    none = F.lit(None).cast("array<double>")
    joined = with_host.drop("_at").unionByName(rows.filter("_host = ''").withColumns({"_h": none, "_d": none, "_s": none}))
    prior = F.when(F.col("_h").isNull(), top).otherwise(let(_mixed(F.col("_s"), F.col("_post"), top), lambda s: let(_mixed(F.col("_d"), F.col("_post"), s), lambda d: _mixed(F.col("_h"), F.col("_post"), d))))
    logs = F.zip_with(F.zip_with(F.col("_text"), F.element_at(literal, F.col("_said")), lambda a, b: a + b), F.transform(prior, lambda p: F.log(p + 1e-12)), lambda a, b: a + b)
    out = joined.withColumn("evidence", _softmax(logs))
    names = F.array(*map(F.lit, languages))
    best = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    return out.select("id", "is_page", F.col("_host").alias("host"), "declared", best(F.col("_post")).alias("text_lang"), best(F.col("evidence")).alias("lang"), F.array_max("evidence").alias("posterior"), "evidence")


def _small(table: DataFrame) -> DataFrame:
    """A table, to be broadcast if it has few rows; they are counted first."""
    table = stored(table)
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def corpus_items(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages with all their evidence, and documents, which have their text only, as items."""
    web = pages.select(F.col("page_id").cast("bigint").alias("id"), F.col("html").alias("content"), "url", declared_language(F.coalesce(F.col("html"), F.lit(""))).alias("declared"), F.lit(True).alias("is_page"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("url"), F.lit("").alias("declared"), F.lit(False).alias("is_page"))
    return web.unionByName(own)

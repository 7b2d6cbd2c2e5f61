"""Quality classifier: nearest-neighbour voting over labelled latent-semantic vectors.

A text is a bag of hashed byte trigrams and of pseudo-terms for its style (case, symbols, repetition). On a bounded
sample of labelled rows, inverse document frequencies and a truncated singular value decomposition are fitted; the
sample's vectors are broadcast, and every document gets its exact cosine with all of them, block by block; the nearest
neighbours vote with their labels, weighted by similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetnet.llm.common import map_batches

#: The bound of the sample of labelled rows that the model is fitted on; the broadcast is FIT_ROWS * RANK * 4 bytes.
FIT_ROWS = 4096
BUCKETS, RANK, NEIGHBOURS, BLOCK = 2048, 48, 25, 512
#: Weight of the style pseudo-terms against the trigrams, each group being of unit length.
STYLE_WEIGHT = 1.0

_STYLE = ("upper", "symbols", "bangs", "same_runs", "variety", "repeated_lines", "bare")
_LEVELS = 6
N_TERMS = BUCKETS + len(_STYLE) * _LEVELS

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BARE = re.compile(r"(?<![^\x20\x09-\x0D])[^\w\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def trigram_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, dtype=np.float32)
    code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(21), minlength=BUCKETS).astype(np.float32)


def style_shares(text: str) -> list[float]:
    words = _WORD.findall(text)
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    return [
        len(_UPPER.findall(text)) / max(len(text), 1),
        sum(map(text.count, "#*$%&|<>")) / n,
        text.count("!") / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,  # noqa: B905
        1 - len(set(words)) / n ** 0.8 if n > 1 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        len(_BARE.findall(text)) / n,
    ]


def terms(text: str | None) -> np.ndarray:
    """The term vector: square roots of trigram counts, and for each style a soft one-hot of its level."""
    text = text or ""
    out = np.zeros(N_TERMS, dtype=np.float32)
    grams = np.sqrt(trigram_counts(text.encode("utf-8", "surrogatepass")))
    norm = np.linalg.norm(grams)
    out[:BUCKETS] = grams / norm if norm else grams
    for i, share in enumerate(style_shares(text)):
        level = min(max(share, 0.0), 1.0) ** 0.5 * (_LEVELS - 1)
        low = min(int(level), _LEVELS - 2)
        at = BUCKETS + i * _LEVELS + low
        out[at], out[at + 1] = 1 - (level - low), level - low
    out[BUCKETS:] *= STYLE_WEIGHT / len(_STYLE) ** 0.5
    return out


@dataclass
class Model:
    """idf of the terms, the projection, the labelled unit vectors and their labels (1.0: good)."""

    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Model:
        """Fit to half-precision term vectors: the decomposition by subspace iteration on the Gram matrix, which is summed
        up block by block, so the driver never holds the sample in full precision."""
        blocks = [x[at : at + BLOCK] for at in range(0, len(x), BLOCK)]
        seen = sum((b > 0).sum(axis=0) for b in blocks) if blocks else np.zeros(x.shape[1])
        idf = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
        gram = np.zeros((x.shape[1], x.shape[1]), dtype=np.float32)
        for b in blocks:
            w = b.astype(np.float32) * idf
            gram += w.T @ w
        project = np.random.default_rng(0).standard_normal((x.shape[1], RANK + 16)).astype(np.float32)
        for _ in range(20 if blocks else 0):  # small factorisations only: large ones wait for their threads on a busy driver
            grown = (gram @ project).astype(np.float64)
            values, axes = np.linalg.eigh(grown.T @ grown)
            project = (grown @ (axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], values[-1] * 1e-14)))).astype(np.float32)
        project = np.ascontiguousarray(project[:, :RANK])
        vectors = np.concatenate([cls._unit((b.astype(np.float32) * idf) @ project) for b in blocks]) if blocks else np.zeros((0, RANK), dtype=np.float32)
        return cls(idf, project, vectors, labels.astype(np.float32))

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of good labels among the nearest neighbours; without labels a half."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = self._unit((x * self.idf) @ self.project) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 0.0) ** 8 + 1e-6
        return (weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, quality) of up to ``fit_rows`` labelled ids that aren't held out, chosen by a hash of the id."""
    marked = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    chosen = marked.groupBy(F.col("doc_id").alias("_id")).agg(F.avg(F.col("quality").cast("double")).alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled sample; term vectors are made on the executors, at most ``fit_rows`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t.as_py()).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(rows, pa.binary()), batch.column(2)], names=["doc_id", "terms", "quality"])

    sample = map_batches(labelled_sample(docs, labels, fit_rows), run, "doc_id string, terms binary, quality double").toArrow().combine_chunks()
    rows: dict[str, int] = {}  # a repeated id counts once, by its least vector
    terms_of = sample.column("terms")
    for i, d in enumerate(sample.column("doc_id").to_pylist()):
        if d not in rows or terms_of[i].as_py() < terms_of[rows[d]].as_py():
            rows[d] = i
    chosen = [rows[d] for d in sorted(rows)]
    x = np.empty((len(chosen), N_TERMS), dtype=np.float16)
    for k, i in enumerate(chosen):
        x[k] = np.frombuffer(terms_of[i].as_buffer(), dtype=np.float16)
    return Model.fit(x, np.array([sample.column("quality")[i].as_py() for i in chosen], dtype=np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text).

    Null texts count as empty, and empty texts have a score as any other. Repeated rows are scored each, other columns
    are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.stack([terms(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(x).astype(np.float64))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def kept(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with its columns, that score ``threshold`` or more; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.stack([terms(t.as_py()) for t in part.column(at_text)])
                yield part.filter(pa.array(shared.value.score(x) >= threshold))

    return map_batches(docs, run, docs.schema)

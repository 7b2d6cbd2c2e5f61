"""The corpus pipeline: five operators applied to ``documents`` one after the other.

Each stage takes (spark, docs, sf_dir), works on every row it gets and returns the rows it keeps with the columns of
``documents``; the last returns the encoded corpus.

Nulls in any column, empty and very long texts, repeated rows and further columns go through every stage: a null text
scores like an empty one, null and empty texts are copies of each other and have no passage, a document without a word is
never sampled, and null texts get null ids. Repeated rows score alike; one of them stays. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetnet.llm import mixing, nearcopies, passages, pieces, quality
from fleetnet.llm.common import stored, table


#: Bytes of a passage that counts as repeated here: about 35 words of prose, so a passage of 50 words or more of any of
#: the languages is long enough; and the length of the anchors that bring its copies together.
PASSAGE_BYTES, ANCHOR_BYTES = 200, 32


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote scores under a half go."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; near is a likeness of 0.8 or more
    over five-word shingles. SimHash links come first; what four bits of fingerprints don't reach is completed exactly."""
    return nearcopies.deduplicated(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_BYTES or more that occur again are cut out of the texts; every document stays."""
    return passages.without_repeats(docs, PASSAGE_BYTES, ANCHOR_BYTES)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities that meet the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as sampled piece ids that decode to it: doc_id, ids, n_pieces, lossless."""
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: The classifier, the suffix sort and the sampled segmentation can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

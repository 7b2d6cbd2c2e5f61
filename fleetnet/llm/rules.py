"""Quality rules as weak supervision.

Each rule votes keep, reject or abstains on a document's measures. Expectation-maximisation over the table of vote
patterns (at most 3^rules rows, whatever the corpus) estimates for both classes how often each rule gives each vote;
a document is kept by the posterior probability of the good class, not by passing every rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetnet.llm.common import map_batches, stored

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words without a letter, digit or underscore.
_BARE = re.compile(r"(?<![^\x20\x09-\x0D])[^\w\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")
_BLANK = " \t\n\x0b\x0c\r"
_LETTER = re.compile(r"[^\W\d_]")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bangs", "n_runs", "n_lines", "n_bare")


@dataclass(frozen=True)
class Rule:
    """Votes keep where ``keep`` holds, reject where ``reject`` does, else (also where both are null) abstains."""

    name: str
    keep: Column
    reject: Column


def default_rules() -> list[Rule]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    within = lambda name, x, low, high: Rule(name, x <= low, x > high)
    mean = share("word_chars", "n_words")
    return [
        Rule("word_length", mean.between(3, 10), (mean < 2.5) | (mean > 14)),
        within("symbols", share("n_symbols", "n_words"), 0.02, 0.1),
        within("duplicate_lines", share("n_dup_lines", "n_lines"), 0.1, 0.5),
        within("repeated_words", share("n_repeat_words", "n_words"), 0.2, 0.5),
        within("upper_case", share("n_upper", "n_letters"), 0.2, 0.4),
        within("exclamation", share("n_bangs", "n_words"), 0.05, 0.3),
        within("same_word_runs", share("n_runs", "n_words"), 0.05, 0.2),
        Rule("letters", share("n_letters", "word_chars") >= 0.85, share("n_letters", "word_chars") < 0.6),
        within("bare_symbols", share("n_bare", "n_words"), 0.1, 0.2),
    ]


def repeated_positions(words: list[str], window: int = 3) -> int:
    """How many words lie in a window of three words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code, base = ids[:n], len(number)
    for k in range(1, window):
        if int(code.max()) >= (1 << 62) // base:  # renumber before a product could overflow
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + ids[k : n + k]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one whole text; null counts as empty."""
    text = text or ""
    words = _WORD.findall(text)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_UPPER))
    letters = len(_LETTER.findall(text)) if not text.isascii() else len(text) - len(text.translate(_NO_LETTER))
    runs = sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
    return (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, repeated_positions(words), upper, letters, text.count("!"), runs, lines, len(_BARE.findall(text)))


_NO_UPPER = {c: None for c in range(65, 91)}
_NO_LETTER = _NO_UPPER | {c: None for c in range(97, 123)}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the MEASURES of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t.as_py()) for t in batch.column(1)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def pattern(rules: list[Rule]) -> Column:
    """The votes as one number in base 3: a rule's digit is 0 reject, 1 abstain, 2 keep."""
    out = F.lit(0)
    for rule in reversed(rules):
        out = out * 3 + F.when(rule.reject, 0).when(rule.keep, 2).otherwise(1)
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 200, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each pattern, votes' probabilities [class, rule, vote], prior of the good class) by EM.

    Starts from the good class for patterns without a reject vote; every estimate is smoothed by one vote, so unseen
    votes keep a probability; should the classes have changed places, they are put back. Without rows, the posterior is empty and the prior a half.
    """
    votes = (patterns[:, None] // 3 ** np.arange(n_rules)) % 3
    good = np.where((votes == 0).any(axis=1), 0.05, 0.95)
    chance, prior = np.full((2, n_rules, 3), 1 / 3), 0.5
    if not len(patterns):
        return good, chance, prior
    shown = votes[:, :, None] == np.arange(3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        chance = np.einsum("cp,prv->crv", weight, shown) + 1.0
        chance /= chance.sum(axis=2, keepdims=True)
        log = np.einsum("prv,crv->cp", shown, np.log(chance)) + np.log([1 - prior, prior])[:, None]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        moved, good = float(np.abs(new - good).max()), new
        if moved <= tolerance:
            break
    if chance[1, :, 0].sum() > chance[0, :, 0].sum():  # the good class is the one that rules reject less
        good, chance, prior = 1 - good, chance[::-1], 1 - prior
    return good, chance, prior


def judged(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text): doc_id, MEASURES, base_failed, pattern, posterior, kept.

    base_failed: under 50 words, or over half of the words in repeated windows; such rows aren't kept. Null and empty
    texts have no words. Repeated rows are judged each, other columns are ignored, an empty table gives an empty result.
    """
    rules = rules or default_rules()
    rows = stored(measures(docs).withColumn("pattern", pattern(rules)))
    table = rows.groupBy("pattern").count().toPandas()  # 3^rules rows at most
    good, _, _ = fit(table["pattern"].to_numpy(np.int64), table["count"].to_numpy(np.float64), len(rules))
    posts = docs.sparkSession.createDataFrame(list(zip(table["pattern"].astype(int).tolist(), good.tolist(), strict=True)), "_pattern int, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(F.broadcast(posts), F.col("pattern") == F.col("_pattern")).drop("_pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("posterior") >= threshold))

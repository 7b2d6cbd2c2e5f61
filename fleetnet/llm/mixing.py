"""Mixing sources to target weights by iterative proportional fitting [native].

Token counts are aggregated to (source, lang, topic) cells; the cells' weights are raked until their source, language
and topic marginals meet the targets; a document's inclusion probability is its cell's weight over its cell's tokens,
scaled so that the expected number of tokens meets the budget, and a hash of its id decides.

No document can be taken more than once, so a cell can't weigh more than all its tokens. That bound is part of the fit:
targets that ask for more than nearly all tokens of a value are lowered to what there is and the rest goes to the other
values, in proportion; and the raking scales only weights below their bound.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetnet.llm.common import WORD, cut, stored, unit

DIMS = ("source", "lang", "topic")
#: Exponents that flatten the observed shares into the targets; under 1 favours the small.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Share of the tokens that the sample is to hold, and of a value's tokens that may be asked for.
BUDGET, MOST = 0.6, 0.95
TOLERANCE, ROUNDS, ACCEPTED = 1e-5, 100, 5e-3
#: What a mixture is fitted to: each round is a dozen small jobs, and the driver keeps something of each.
FIT_TOLERANCE, FIT_ROUNDS = 2e-4, 30
#: Up to so many cells (about 100 bytes each) they are raked in one task and broadcast to the documents; beyond, both are shuffled.
BROADCAST_CELLS = 100_000

#: Up to so many cells and targets (about 2 MB), counted first, are fitted in the driver by the same rules: each round over
#: tables is a dozen jobs, and the driver keeps something of each.
FIT_HERE = 20_000

#: Topics: the strings, or after "re:" a pattern, that mark each, and their number for each word of a text from which on
#: they outweigh running prose.
MARKS = {
    "legal": (("icense", "icence", "opyright", "arrant", "iabilit", "LICENSE", "COPYRIGHT"), 0.004),
    "contact": (("@", "://", "+"), 0.01),
    "tabular": ((" | ", "\t"), 0.05),
    "code": (("re:[{}=<>;]", "()"), 0.06),
    "numeric": (("re:\\d+",), 0.2),
    "promotion": (("!!",), 0.04),
}


def _times(text: Column, mark: str) -> Column:
    """How often a mark occurs; strings by the bytes that go with them, without a pattern's cost."""
    if mark.startswith("re:"):
        return F.regexp_count(text, F.lit(mark[3:]))
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark.encode())


def topic_of(text: Column, words: Column) -> Column:
    """The topic whose marks are densest in the whole text, each in terms of its own threshold, of equal ones the first;
    prose if none reaches it. ``words``: the text's number of words."""
    scores = {name: sum((_times(text, m) for m in marks[1:]), _times(text, marks[0])) / least for name, (marks, least) in MARKS.items()}
    best = F.greatest(*scores.values())
    out = F.when(best < F.greatest(words, F.lit(1)), "prose")
    for name, score in scores.items():
        out = out.when(score == best, name)
    return out


def with_cells(docs: DataFrame, topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """``docs`` with _source, _lang, _topic (null: the empty name) and _tokens (words; null text: 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = docs.select("*", name("source").alias("_source"), name("lang").alias("_lang"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_tokens"))
    return counted.withColumn("_topic", F.coalesce(topic(text, F.col("_tokens")), F.lit("")))


def flattened_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(_dim, _t): target shares in proportion to the observed shares to the given power."""
    sums = cells.groupBy(f"_{dim}").agg(F.pow(F.sum("_tokens").cast("double"), F.lit(power)).alias("_t"))
    return sums.crossJoin(sums.agg(F.sum("_t").alias("_z"))).select(f"_{dim}", (F.col("_t") / F.col("_z")).alias("_t"))


def feasible_targets(cells: DataFrame, dim: str, targets: DataFrame, budget: float) -> DataFrame:
    """(_dim, _wanted, _t): the target shares (_dim, _t) of values that have tokens, rescaled to 1, and what of them there is.

    A value gives at most MOST of its tokens (more where the budget is near all of them); what it can't give is asked of the
    others in proportion to their targets, until no other reaches its own bound.
    """
    most = max(MOST, (1 + budget) / 2)
    have = cells.filter("_tokens > 0").groupBy(f"_{dim}").agg(F.sum("_tokens").alias("_have"))
    rows = targets.select(f"_{dim}", F.col("_t").alias("_wanted")).join(have, f"_{dim}")
    sums = rows.agg(F.sum("_wanted").alias("w"), F.sum("_have").alias("h")).first()
    if not sums["w"]:
        return rows.select(f"_{dim}", "_wanted", F.lit(0.0).alias("_t"))
    rows = cut(rows.withColumns({"_wanted": F.col("_wanted") / sums["w"], "_bound": F.col("_have") * (most / (budget * sums["h"]))}))
    scale = 1.0
    for _ in range(100):
        full = F.col("_wanted") * scale >= F.col("_bound")
        got = rows.agg(F.sum(F.when(full, F.col("_bound")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("_wanted"))).alias("open")).first()
        new = (1 - got["full"]) / got["open"] if got["open"] else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return rows.select(f"_{dim}", "_wanted", F.least(F.col("_wanted") * scale, F.col("_bound")).alias("_t"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """Fit ``_w`` of cells (_source, _lang, _topic, _tokens) to target shares (_dim, _t) of each dimension.

    Each half-step multiplies a dimension's cells by one factor for each value, so that its sum meets the target; with a
    ``budget`` a cell's weight is its product or, if that is less, its bound, all its tokens in shares of the budget, and
    the factor is that of the cells below their bounds. A value without a target, or with no tokens, weighs nothing;
    targets are rescaled to what has tokens. Ends when all sums of a round are within ``tolerance`` of their targets; where
    they can't be met together, stops after ``rounds``, or once ten rounds bring nothing, warns if a sum is over ACCEPTED off,
    and gives the last weights.
    """
    total = cells.agg(F.sum("_tokens")).first()[0] or 0
    state = cells.filter("_tokens > 0").withColumn("_u", F.col("_tokens") / F.lit(float(total or 1)))
    state = state.withColumn("_cap", F.col("_tokens") / F.lit(budget * total) if budget else F.lit(float("inf")))
    for dim in DIMS:
        state = state.join(targets[dim].select(f"_{dim}", F.col("_t").alias(f"_t_{dim}")), f"_{dim}")
    state = cut(state)
    for dim in DIMS:  # shares of values that have no cell go to the others
        there = state.groupBy(f"_{dim}").agg(F.first(f"_t_{dim}").alias("_t")).agg(F.sum("_t")).first()[0]
        state = state.withColumn(f"_t_{dim}", F.col(f"_t_{dim}") / (there or 1.0))
    weight, full = F.least(F.col("_u"), F.col("_cap")), F.col("_u") >= F.col("_cap")
    best, idle = float("inf"), 0
    for _ in range(rounds):
        off = F.lit(0.0)
        for dim in DIMS:
            sums = state.groupBy(f"_{dim}").agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("_full"), F.sum(F.when(full, 0.0).otherwise(F.col("_u"))).alias("_open"))
            t, whole = F.col(f"_t_{dim}"), F.col("_full") + F.col("_open")
            factor = F.when((F.col("_open") > 0) & (t > F.col("_full")), (t - F.col("_full")) / F.col("_open")).when(t >= whole, 1.0).otherwise(t / whole)
            state = state.join(sums, f"_{dim}").withColumns({"_u": F.col("_u") * factor, f"_off_{dim}": F.when(t > 0, F.abs(whole / t - 1)).otherwise(0.0)}).drop("_full", "_open")
            off = F.greatest(off, F.col(f"_off_{dim}"))
        state = cut(state.withColumn("_off", off).drop(*[f"_off_{d}" for d in DIMS]))
        worst = state.agg(F.max("_off")).first()[0]
        state = state.drop("_off")
        if worst is None or worst <= tolerance:
            break
        best, idle = (worst, 0) if worst < 0.99 * best else (best, idle + 1)
        if idle == 10:
            worst = best
            break
    if worst is not None and worst > max(tolerance, ACCEPTED):
        warnings.warn(f"raking stopped {worst:.2g} off", stacklevel=2)
    return state.withColumn("_w", weight).drop("_u", "_cap")


def calibrate(fitted: DataFrame, budget: float) -> DataFrame:
    """``fitted`` with _p, the inclusion probability: min(1, c * _w / _tokens), expected tokens ``budget`` of all.

    c grows step by step: what saturated cells can't give is asked of the others, until no further cell saturates.
    """
    ratio = F.col("_w") / F.col("_tokens")
    total = fitted.agg(F.sum("_tokens")).first()[0] or 0
    c = 0.0
    for _ in range(200):
        full = ratio * F.lit(c) >= 1
        row = fitted.agg(F.sum(F.when(full, F.col("_tokens"))).alias("full"), F.sum(F.when(~full, F.col("_w"))).alias("open")).first()
        if not row["open"]:
            break
        new = (budget * total - (row["full"] or 0)) / row["open"]
        if new <= c * (1 + 1e-12):
            break
        c = new
    return fitted.withColumn("_p", F.least(F.lit(1.0), ratio * F.lit(c)))


def fit(cells: DataFrame, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(cells with _weight and _p, {dim: feasible_targets}) for a table of cells."""
    here = _fit_here(cells, budget, targets)
    if here:
        return here
    wanted = targets or {d: flattened_targets(cells, d, FLATTEN[d]) for d in DIMS}
    asked = {d: cut(feasible_targets(cells, d, wanted[d], budget)) for d in DIMS}
    fitted = calibrate(rake(cells, asked, budget, FIT_TOLERANCE, FIT_ROUNDS), budget)
    return cut(fitted.select("_source", "_lang", "_topic", "_tokens", F.col("_w").alias("_weight"), "_p")), asked


def _few(rows: DataFrame) -> list | None:
    got = rows.limit(FIT_HERE + 1).collect()
    return got if len(got) <= FIT_HERE else None


def _feasible_here(wanted: dict[str, float], have: dict[str, float], budget: float) -> dict[str, tuple[float, float]]:
    """``feasible_targets``: {value: (wanted, feasible)}."""
    names = [v for v in wanted if v in have]
    w, h = np.array([wanted[v] for v in names]), np.array([have[v] for v in names])
    if not w.sum():
        return {v: (wanted[v], 0.0) for v in names}
    w, bound, scale = w / w.sum(), h * (max(MOST, (1 + budget) / 2) / (budget * h.sum())), 1.0
    for _ in range(100):
        full = w * scale >= bound
        rest = w[~full].sum()
        new = (1 - bound[full].sum()) / rest if rest else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return {v: (float(x), float(t)) for v, x, t in zip(names, w, np.minimum(w * scale, bound), strict=True)}


def _rake_here(at: list[np.ndarray], t: list[np.ndarray], tokens: np.ndarray, total: float, budget: float) -> np.ndarray:
    """``rake``: the weights; ``at``: each cell's value in each dimension, ``t``: their targets."""
    u, cap = tokens / total, tokens / (budget * total)
    best, idle, worst = float("inf"), 0, None
    for _ in range(FIT_ROUNDS if len(u) else 0):
        worst = 0.0
        for k, goal in zip(at, t, strict=True):
            full = u >= cap
            held, rest = (np.bincount(k, np.where(x, y, 0.0), len(goal)) for x, y in ((full, cap), (~full, u)))
            whole = held + rest
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where((rest > 0) & (goal > held), (goal - held) / rest, np.where(goal >= whole, 1.0, goal / whole))
                off = np.where(goal > 0, np.abs(whole / goal - 1), 0.0)
            u, worst = u * factor[k], max(worst, float(off.max()))
        if worst <= FIT_TOLERANCE:
            break
        best, idle = (worst, 0) if worst < 0.99 * best else (best, idle + 1)
        if idle == 10:
            worst = best
            break
    if worst is not None and worst > ACCEPTED:
        warnings.warn(f"raking stopped {worst:.2g} off", stacklevel=2)
    return np.minimum(u, cap)


def _calibrate_here(w: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """``calibrate``: the inclusion probabilities."""
    ratio, c = w / tokens, 0.0
    for _ in range(200):
        full = ratio * c >= 1
        rest = w[~full].sum()
        new = (budget * tokens.sum() - tokens[full].sum()) / rest if rest else c
        if new <= c * (1 + 1e-12):
            break
        c = new
    return np.minimum(1.0, ratio * c)


def _fit_here(cells: DataFrame, budget: float, targets: dict[str, DataFrame] | None) -> tuple[DataFrame, dict[str, DataFrame]] | None:
    """``fit`` on arrays in the driver; None for more than FIT_HERE cells or targets."""
    rows = _few(cells.select("_source", "_lang", "_topic", "_tokens"))
    given = [_few(targets[d].select(f"_{d}", "_t")) for d in DIMS] if targets else []
    if rows is None or any(g is None for g in given):
        return None
    rows = sorted(rows, key=lambda r: tuple(r)[:3])  # sums don't hang on the order in which cells come
    asked = []
    for k, d in enumerate(DIMS):
        sums: dict[str, int] = {}
        for r in rows:
            sums[r[k]] = sums.get(r[k], 0) + r["_tokens"]
        powers = {v: float(n) ** FLATTEN[d] for v, n in sums.items()}
        whole = sum(powers.values())
        wanted = dict(map(tuple, given[k])) if given else {v: x / whole for v, x in powers.items() if whole}
        asked.append(_feasible_here(wanted, {v: n for v, n in sums.items() if n}, budget))
    total = float(sum(r["_tokens"] for r in rows))
    rows = [r for r in rows if r["_tokens"] > 0 and all(r[k] in asked[k] for k in range(len(DIMS)))]
    at, goals = [], []
    for k in range(len(DIMS)):
        values = sorted({r[k] for r in rows})
        number = {v: n for n, v in enumerate(values)}
        t = np.array([asked[k][v][1] for v in values])
        at.append(np.array([number[r[k]] for r in rows], dtype=int))
        goals.append(t / (t.sum() or 1.0))  # shares of values that have no cell go to the others
    tokens = np.array([r["_tokens"] for r in rows], dtype=float)
    w = _rake_here(at, goals, tokens, total, budget)
    p = _calibrate_here(w, tokens, budget)
    spark = cells.sparkSession
    out = [(*tuple(r)[:4], float(x), float(y)) for r, x, y in zip(rows, w, p, strict=True)]
    fitted = spark.createDataFrame(out, "_source string, _lang string, _topic string, _tokens bigint, _weight double, _p double")
    return fitted, {d: spark.createDataFrame([(v, *x) for v, x in asked[k].items()], f"_{d} string, _wanted double, _t double") for k, d in enumerate(DIMS)}


def _cells(rows: DataFrame) -> DataFrame:
    """The cells of rows; up to BROADCAST_CELLS of them, counted first, lie in one partition, so raking shuffles nothing."""
    cells = cut(rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_tokens")))
    return cut(cells.coalesce(1)) if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else cells


def marginals(docs: DataFrame, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """(dim, value, wanted, feasible, expected): each value's target share, what of it there is, and its expected share of
    the sample's tokens."""
    fitted, asked = fit(_cells(with_cells(docs.select("doc_id", "text", "lang", "source"), topic)), budget, targets)
    total = fitted.agg(F.sum(F.col("_p") * F.col("_tokens"))).first()[0] or 1.0
    one = lambda d: fitted.groupBy(f"_{d}").agg((F.sum(F.col("_p") * F.col("_tokens")) / total).alias("expected")).join(asked[d], f"_{d}").select(F.lit(d).alias("dim"), F.col(f"_{d}").alias("value"), F.col("_wanted").alias("wanted"), F.col("_t").alias("feasible"), "expected")
    return one("source").unionByName(one("lang")).unionByName(one("topic"))


def _decided(rows: DataFrame, budget: float, targets: dict[str, DataFrame] | None, seed: int) -> DataFrame:
    """``rows`` (see with_cells) with _weight, _p and _kept."""
    fitted, _ = fit(_cells(rows), budget, targets)
    fitted = fitted.drop("_tokens")
    few = fitted.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    out = rows.join(F.broadcast(fitted) if few else fitted, ["_source", "_lang", "_topic"], "left")
    p = F.when(F.col("_tokens") > 0, F.coalesce("_p", F.lit(0.0))).otherwise(0.0)
    return out.withColumns({"_weight": F.coalesce("_weight", F.lit(0.0)), "_p": p, "_kept": unit(F.lit(seed), F.col("doc_id")) < p})


def mixed(docs: DataFrame, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, seed: int = 17, topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """``docs`` with _tokens, _topic, _weight, _p and _kept, one row for each row of ``docs``.

    Documents without a word are in no cell: _weight 0, _p 0, not kept. Ids that repeat share a decision; null ids
    hash as null. Extra columns stay; names that start with an underscore are ours. Texts are read twice, for the cells and
    for the rows, so that whole texts are neither stored nor shuffled.
    """
    return _decided(with_cells(docs.select([F.col(c) for c in docs.columns if not c.startswith("_")]), topic), budget, targets, seed)


def mixture(docs: DataFrame, budget: float = BUDGET, seed: int = 17, targets: dict[str, DataFrame] | None = None, topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """The decision for each document: doc_id, source, lang, topic, tokens, cell_weight, probability, sampled.

    Rows as in ``mixed``; texts are read once, what is left of them is stored.
    """
    rows = stored(with_cells(docs.select("doc_id", "text", "lang", "source"), topic).select("doc_id", "_source", "_lang", "_topic", "_tokens"))
    out = _decided(rows, budget, targets, seed)
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.col("_weight").alias("cell_weight"), F.col("_p").alias("probability"), F.col("_kept").alias("sampled"))


def sample(docs: DataFrame, budget: float = BUDGET, seed: int = 17) -> DataFrame:
    """The sampled rows of ``docs``, with its columns."""
    return mixed(docs, budget, seed=seed).filter("_kept").select([F.col(c) for c in docs.columns])

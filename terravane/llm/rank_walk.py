"""One ranking from several scores on different scales, by a Markov chain over ranks.

From an item the walk picks one of the scores that the item has, each alike, and jumps uniformly to an item that stands
at least as high in that score; with probability 1 - damping it jumps to any item. The share of time spent at an item
is its strength. Only ranks enter, so no scale and no tail decides.

Ranks are read in ``levels`` steps of equal share. An item's stationary mass then depends on its levels alone, so what
leaves the items of a level is a sum over the levels that they have in the other scores: the chain needs the items only as
the table of how often two levels meet, (scores x levels) squared numbers, which one aggregate gives, summed on the map
side. The power iteration with its prefix sums over the sorted levels runs on that table, whatever the number of items.
Items of one level pattern have one strength; ranks in ``finer`` steps within the levels put them in order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.relational import top_rows
from terravane.session import cut_lineage

LEVELS, FINER = 50, 20
DAMPING = 0.5
TOLERANCE = 1e-6
ACCURACY = 100_000


def level_of(c: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie at or below c, as a balanced tree of comparisons; null for null."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= cuts[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(c.isNotNull(), tree(0, len(cuts)))


def level_cuts(items: DataFrame, scores: list[str], levels: int, finer: int) -> tuple[list[list[float]], list[list[list[float]]]]:
    """Per score the values at which a new level begins, and per level those at which a finer step begins within it; equal
    values share a level and a step."""
    at = [k / (levels * finer) for k in range(1, levels * finer)]
    row = items.agg(*[F.percentile_approx(s, at, ACCURACY).alias(s) for s in scores]).first()
    cuts, inner = [], []
    for s in scores:
        found = row[s] or []
        own = sorted(set(found[finer - 1 :: finer]))
        ends = [float("-inf"), *own, float("inf")]
        cuts.append(own)
        inner.append([sorted({x for x in found if a < x < b}) for a, b in zip(ends[:-1], ends[1:])])
    return cuts, inner


def stationary_arrivals(counts: np.ndarray, meets: np.ndarray, first: list[int], total: float, damping: float, tolerance: float) -> np.ndarray:
    """What arrives at one item of each level (of all scores, one after the other) through that score.

    ``counts`` are the items of each level, ``meets`` the items of two levels, each item weighted by one over its number of
    scores. Mass leaves a level in equal parts to all items at or above it in its score: a prefix sum over the levels."""
    ends = [*first[1:], len(counts)]
    above = np.concatenate([np.cumsum(counts[a:b][::-1])[::-1] for a, b in zip(first, ends)])
    arrivals, base = np.zeros(len(counts)), 1 / total
    # the change shrinks by the damping at least from round to round
    for _ in range(int(np.ceil(np.log(tolerance) / np.log(damping))) + 100):
        leaving = base * np.diag(meets) + damping * meets @ arrivals
        each = np.divide(leaving, above, out=np.zeros_like(leaving), where=above > 0)
        new = np.concatenate([np.cumsum(each[a:b]) for a, b in zip(first, ends)])
        change = np.abs(new - arrivals).max()
        arrivals, base = new, (1 - damping * leaving.sum()) / total
        if change * total < tolerance:  # arrivals in units of the mean mass
            return arrivals
    raise RuntimeError("the walk did not settle")


def strengths(items: DataFrame, scores: list[str], levels: int = LEVELS, damping: float = DAMPING, tolerance: float = TOLERANCE, finer: int = FINER) -> DataFrame:
    """items with ``n_scores``, ``strength``, larger for stronger items, and ``fine_level``, which orders equal strengths.

    Higher scores are stronger. A null or NaN score is not measured: it is never picked, and strength is the mass that
    arrives per measured score, so that items with fewer scores rank by what they have; fine_level is their mean level with
    its finer part. Without any score both are 0. Repeated rows are items of their own; extra columns stay."""
    s_ = [f"_s{i}" for i in range(len(scores))]
    clean = items.withColumns({a: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for a, c in zip(s_, scores)})
    clean = cut_lineage(clean)  # read four times
    cuts, inner = level_cuts(clean, s_, levels, finer)
    level = [level_of(F.col(a), c) for a, c in zip(s_, cuts)]
    l_ = [f"_l{i}" for i in range(len(scores))]
    patterns = clean.groupBy(*[x.alias(n) for x, n in zip(level, l_)]).agg(F.count("*").alias("n"))
    first = np.cumsum([0, *[len(c) + 1 for c in cuts]]).tolist()
    size = first.pop()
    places = F.array_compact(F.array(*[F.col(n) + F.lit(f) for n, f in zip(l_, first)]))
    pairs = patterns.select("n", places.alias("p")).where(F.size("p") > 0).select((F.col("n") / F.size("p")).alias("w"), "n", "p", F.explode("p").alias("a"))
    table = pairs.select("w", "n", "a", F.explode("p").alias("b")).groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    total = float(clean.count())
    counts, meets = np.zeros(size), np.zeros((size, size))
    for r in table:
        meets[r["a"], r["b"]] = r["w"]
        if r["a"] == r["b"]:
            counts[r["a"]] = r["n"]
    n_scores = reduce(lambda a, b: a + b, [F.col(a).isNotNull().cast("int") for a in s_])
    out = clean.withColumn("n_scores", n_scores)
    if not len(table):
        return out.withColumns({"strength": F.lit(0.0), "fine_level": F.lit(0.0)}).drop(*s_)
    arrivals = stationary_arrivals(counts, meets, first, total, damping, tolerance)
    ends = [*first[1:], size]
    mean = lambda parts: F.coalesce(F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in parts]), F.col("n_scores")), F.lit(0.0))
    arriving = [F.get(F.array(*map(F.lit, arrivals[a:b].tolist())), x) for x, a, b in zip(level, first, ends)]

    def fine(value: Column, own: Column, steps: list[list[float]]) -> Column:
        at = F.get(F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<double>") for x in steps]), own)
        return own + F.size(F.filter(at, lambda c: c <= value)) / (F.size(at) + 1)

    fines = [fine(F.col(a), x, steps) for a, x, steps in zip(s_, level, inner)]
    return out.withColumns({"strength": F.round(mean(arriving) * total, 9), "fine_level": F.round(mean(fines), 9)}).drop(*s_)


def strongest(ranked: DataFrame, share: float, item: str) -> DataFrame:
    """The first share of the items (rounded down, at least one) by strength, then fine_level, ties by id."""
    ranked = cut_lineage(ranked)
    n = ranked.count()
    return top_rows(ranked, "strength", max(1, int(share * n + 1e-9)), [F.desc("fine_level"), item])

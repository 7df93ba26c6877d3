"""Pairwise comparison: matches, win rates and Bradley-Terry ratings. Items are rows ``model, item_id, item``."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINNERS = ("model1", "model2", "draw")


def all_combinations(items: DataFrame, include_reversed: bool = True, cached: DataFrame | None = None) -> DataFrame:
    """Each item of each pair of models, both ways with ``include_reversed``; ``winner`` and ``rationale`` come from ``cached`` matches with equal models and items."""
    one = items.select(F.col("model").alias("model1"), "item_id", F.col("item").alias("item1"))
    two = items.select(F.col("model").alias("model2"), "item_id", F.col("item").alias("item2"))
    pairs = one.join(two, "item_id").where(F.col("model1") != F.col("model2") if include_reversed else F.col("model1") < F.col("model2"))
    return with_cache(pairs, cached)


def match_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_key", F.sha2(F.to_json(F.struct("model1", "model2", "item1", "item2")), 256))


def with_cache(pairs: DataFrame, cached: DataFrame | None) -> DataFrame:
    if cached is None:
        return pairs.withColumns({"winner": F.lit(None).cast("string"), "rationale": F.lit(None).cast("string")})
    known = match_key(cached).groupBy("_key").agg(F.first("winner").alias("winner"), F.first("rationale").alias("rationale"))
    return match_key(pairs).join(known, "_key", "left").drop("_key")


def random_combinations(items: DataFrame, n: int = 100, seed: int = 42, cached: DataFrame | None = None, incremental: bool = False) -> DataFrame:
    """Up to ``n`` matches: cached ones first, then always one of the model with the fewest so far. The draw is made on the driver, on keys only."""
    keys = items.select("model", "item_id").distinct().collect()
    by_item: dict = {}
    for r in keys:
        by_item.setdefault(r["item_id"], []).append(r["model"])
    pairs = [(a, b, i) for i, models in sorted(by_item.items(), key=lambda x: str(x[0])) for a in sorted(models) for b in sorted(models) if a != b]
    known = [] if cached is None else [tuple(r) for r in cached.select("model1", "model2", "item_id").distinct().collect()]
    possible = set(pairs)
    known = [k for k in known if k in possible]
    want = min(len(pairs), n + (len(known) if incremental else 0))
    rng, chosen = random.Random(seed), known[:want]
    played = {m: 0 for m in sorted({p[0] for p in pairs})}
    for a, b, _ in chosen:
        played[a] += 1
        played[b] += 1
    left: dict[str, list] = {m: [] for m in played}
    done = set(chosen)
    for p in pairs:
        if p not in done:
            left[p[0]].append(p)
            left[p[1]].append(p)
    for p in left.values():
        rng.shuffle(p)
    while len(chosen) < want:
        for model in sorted(played, key=lambda m: (played[m], m)):
            while left[model] and left[model][-1] in done:
                left[model].pop()
            if left[model]:
                p = left[model].pop()
                break
        done.add(p)
        chosen.append(p)
        played[p[0]] += 1
        played[p[1]] += 1
    spark = items.sparkSession
    drawn = spark.createDataFrame(chosen, items.select(F.col("model").alias("model1"), F.col("model").alias("model2"), "item_id").schema)
    one = items.select(F.col("model").alias("model1"), "item_id", F.col("item").alias("item1"))
    two = items.select(F.col("model").alias("model2"), "item_id", F.col("item").alias("item2"))
    return with_cache(drawn.join(one, ["model1", "item_id"]).join(two, ["model2", "item_id"]), cached)


def judged(matches: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``matches`` with the judge's ``winner, rationale`` where there is none yet."""
    return matches.where("winner IS NOT NULL").unionByName(judge(matches.where("winner IS NULL").drop("winner", "rationale")))


def win_rate(matches: DataFrame) -> DataFrame:
    """``model, win_rate``: 100 times wins and half the draws over the matches."""
    sides = F.array(F.struct(F.col("model1").alias("model"), F.lit("model1").alias("side")), F.struct(F.col("model2").alias("model"), F.lit("model2").alias("side")))
    points = F.when(F.col("winner") == "draw", 0.5).when(F.col("winner") == F.col("s.side"), 1.0).otherwise(0.0)
    return matches.select("winner", F.explode(sides).alias("s")).groupBy("s.model").agg((F.avg(points) * 100).alias("win_rate"))


def win_matrix(matches: DataFrame) -> DataFrame:
    """``winner, loser, wins``: a draw is half a win for both."""
    a, b = F.col("model1"), F.col("model2")
    half = F.when(F.col("winner") == "draw", 0.5)
    sides = F.array(F.struct(a.alias("winner"), b.alias("loser"), half.when(F.col("winner") == "model1", 1.0).otherwise(0.0).alias("w")), F.struct(b.alias("winner"), a.alias("loser"), half.when(F.col("winner") == "model2", 1.0).otherwise(0.0).alias("w")))
    return matches.select(F.explode(sides).alias("s")).groupBy("s.winner", "s.loser").agg(F.sum("s.w").alias("wins"))


def bradley_terry(matches: DataFrame, rounds: int = 1000, tolerance: float = 1e-3, eps: float = 1e-8, base: float = 10.0, scale: float = 400.0, start: float = 1000.0) -> DataFrame:
    """``model, rating`` by falling rating, then name: strengths by Newman's iteration on the win matrix (models by models, on the driver).

    A round goes over the models in the order of their names; each is compared with those it has beaten, or drawn with, and from then on with those that were
    compared with it. A round ends with a geometric mean of 1. ``eps`` in both sums keeps the strengths finite where there is no maximum of the likelihood, as with
    a model that never wins: such models come last, by a rating that depends on ``eps``; elsewhere it changes nothing within the tolerance.
    """
    rows = win_matrix(matches).collect()
    models = sorted({r["winner"] for r in rows} | {r["loser"] for r in rows})
    place = {m: k for k, m in enumerate(models)}
    wins = np.zeros((len(models), len(models)))
    for r in rows:
        wins[place[r["winner"]], place[r["loser"]]] = r["wins"]
    met = wins > 0
    strength = np.ones(len(models))
    for _ in range(rounds):
        before = strength.copy()
        for i in range(len(models)):
            other = np.flatnonzero(met[i])
            met[other, i] = True
            both = strength[i] + strength[other]
            strength[i] = ((wins[i, other] * strength[other] / both).sum() + eps) / ((wins[other, i] / both).sum() + eps)
        strength /= np.exp(np.log(strength).mean()) if len(models) else 1
        if np.abs(strength - before).sum() < tolerance:
            break
    ratings = [(m, scale / math.log(base) * math.log(s) + start) for m, s in zip(models, strength.tolist())]
    return matches.sparkSession.createDataFrame(sorted(ratings, key=lambda r: (-r[1], r[0])), "model string, rating double")


def ranked(scores: DataFrame, score: str) -> DataFrame:
    """Scores by falling value, then by model."""
    return scores.orderBy(F.desc(score), "model")

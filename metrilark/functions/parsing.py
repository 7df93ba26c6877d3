"""Parsers of judges' and models' answers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .processors import last_match

SCORE = r"(\d+)"


def judge_score(text: Column, valid: tuple[int, int] | None = None, pattern: str = SCORE) -> Column:
    """The last match as a whole number; null without one or outside ``valid``."""
    value = last_match(pattern, None)(text).try_cast("int")
    return value if valid is None else F.when(value.between(*valid), value)


def judge_label(text: Column, labels: Sequence[str]) -> Column:
    """The last of the labels named; of labels at one place the first in the list."""
    return last_match(f"({'|'.join(map(re.escape, labels))})", None)(text)


def judge_winner(text: Column) -> Column:
    """A struct (winner, rationale): the last whole number 1, 2 or 3 stands for model1, model2, draw; anything else is a draw with a note."""
    last = last_match(r"(\d+)", None)(text)
    value = last.try_cast("int")
    winner = F.when(value == 1, "model1").when(value == 2, "model2").otherwise("draw")
    note = F.when(last.isNull(), F.concat(F.lit("Parsing failure: "), text)).when(value.isin(1, 2, 3), text).otherwise(F.concat(F.lit("Invalid judge '"), last, F.lit("': "), text))
    return F.struct(winner.alias("winner"), note.alias("rationale"))


def verdict_correct(text: Column, gold: Column, labels: tuple[str, str] = ("[[A]]", "[[B]]")) -> Column:
    """Whether a judge names the right one of two answers, and it only."""
    both = F.contains(text, F.lit(labels[0])) & F.contains(text, F.lit(labels[1]))
    return ~both & F.contains(text, gold)


def weighted_score(log_probs: Column, valid: tuple[int, int], least: float = 0.0) -> Column:
    """Mean of the numbers in ``valid`` that are keys of a map<string, double> of log-probabilities, by probability; null if these are none or sum to less than ``least``."""
    rows = F.filter(F.transform(F.map_entries(log_probs), lambda e: F.struct(e["key"].try_cast("int").alias("score"), F.exp(e["value"]).alias("p"))), lambda e: e["score"].between(*valid))
    total = F.aggregate(rows, F.lit(0.0), lambda a, e: a + e["p"])
    mean = F.aggregate(rows, F.lit(0.0), lambda a, e: a + e["p"] * e["score"])
    return F.when((F.size(rows) > 0) & (total > 0) & (total >= least), mean / total)

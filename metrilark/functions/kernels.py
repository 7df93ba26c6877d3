"""Sequence algorithms that no column expression has, as plain functions and as Arrow UDFs over whole batches."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _masks(seq: Sequence) -> dict:
    out: dict = {}
    for k, x in enumerate(seq):
        out[x] = out.get(x, 0) | (1 << k)
    return out


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of a longest common subsequence, a machine word of ``a`` at a time."""
    if len(a) < len(b):
        a, b = b, a
    masks, full = _masks(a), (1 << len(a)) - 1
    state = full
    for x in b:
        hit = state & masks.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def lcs_items(a: Sequence, b: Sequence) -> list:
    """The items of a longest common subsequence."""
    masks, full = _masks(a), (1 << len(a)) - 1
    states = [full]
    for x in b:
        hit = states[-1] & masks.get(x, 0)
        states.append(((states[-1] + hit) | (states[-1] - hit)) & full)
    out, i, j = [], len(a), len(b)
    length = lambda i, j: i - (states[j] & ((1 << i) - 1)).bit_count()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out[::-1]


def similarity(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in whole percents; 0 if one text is empty."""
    if not a or not b:
        return 0.0
    return float(np.rint(200 * lcs_length(a, b) / (len(a) + len(b)))) / 100


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Least number of insertions, deletions and substitutions, with the columns' differences in bit vectors."""
    if not a or not b:
        return len(a) or len(b)
    masks, full, last = _masks(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for x in b:
        eq = masks.get(x, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        score += bool(up & last) - bool(down & last)
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
    return score


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def common_substring(a: str, b: str) -> int:
    """Length of the longest common substring: the longest window of one that the other holds, found by bisection over hashed windows."""
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:
        n = (low + high + 1) // 2
        seen = {a[k : k + n] for k in range(len(a) - n + 1)}
        if any(b[k : k + n] in seen for k in range(len(b) - n + 1)):
            low = n
        else:
            high = n - 1
    return low


def most_repeated(text: str, length: int) -> tuple[str, int]:
    """The most frequent window, the first seen of equals; windows that start or end with a blank, "=", "-" or "/" don't count."""
    counts = Counter(w for k in range(max(len(text) - length + 1, 1)) if not ((w := text[k : k + length])[:1] in tuple(" =-/") or w[-1:] in tuple(" =-/")))
    return counts.most_common(1)[0] if counts else ("", 0)


def grams(tokens: Sequence[str], n: int) -> list[tuple]:
    return list(zip(*(tokens[k:] for k in range(n))))


def sari(source: Sequence[str], output: Sequence[str], references: Sequence[Sequence[str]], most: int = 4) -> tuple[float, float, float, float]:
    """(score, add, keep, delete): means over n-gram sizes of the F1 of added, the F1 of kept and the precision of deleted n-grams."""
    ratio = lambda a, b: a / b if b else 1.0
    f1 = lambda p, r: 2 * p * r / (p + r) if p + r else 0.0
    parts = np.zeros(3)
    for n in range(1, most + 1):
        s, c = Counter(grams(source, n)), Counter(grams(output, n))
        r = Counter(g for ref in references for g in grams(ref, n))
        new, wanted = c.keys() - s.keys(), r.keys() - s.keys()
        good = len(new & r.keys())
        add = f1(ratio(good, len(new)), ratio(good, len(wanted)))
        times = len(references)
        s, c = ({g: k * times for g, k in x.items()} for x in (s, c))
        kept = {g: min(k, c[g]) for g, k in s.items() if c.get(g)}
        right = {g: min(k, r[g]) for g, k in kept.items() if r[g]}
        could = sum(min(k, r[g]) for g, k in s.items())
        keep = f1(ratio(sum(k / kept[g] for g, k in right.items()), len(kept)), ratio(sum(right.values()), could))
        gone = {g: k - c.get(g, 0) for g, k in s.items() if k > c.get(g, 0)}
        delete = ratio(sum(max(0, k - r[g]) / k for g, k in gone.items()), len(gone))
        parts += (add, keep, delete)
    add, keep, delete = (parts / most).tolist()
    return (add + keep + delete) / 3, add, keep, delete


def bleu_counts(output: Sequence[str], references: Sequence[Sequence[str]], most: int = 4) -> list[int]:
    """Sufficient statistics of BLEU: clipped matches and totals of each order, output length, length of the closest reference."""
    out = []
    for n in range(1, most + 1):
        mine = Counter(grams(output, n))
        clip: Counter = Counter()
        for ref in references:
            clip |= Counter(grams(ref, n))
        out += [sum((mine & clip).values()), sum(mine.values())]
    closest = min((len(r) for r in references), key=lambda k: (abs(k - len(output)), k), default=0)
    return [*out, len(output), closest]


def bleu(counts: Sequence[float], most: int = 4, effective: bool = False) -> tuple[float, float]:
    """(score of 0 to 100, brevity penalty) of summed counts, with exponential smoothing; ``effective``: only orders that occur."""
    length, reference = counts[2 * most], counts[2 * most + 1]
    penalty = 1.0 if length >= reference else math.exp(1 - reference / length) if length else 0.0
    logs, smooth = [], 1.0
    for n in range(most):
        hit, total = counts[2 * n], counts[2 * n + 1]
        if not total:
            if not effective:
                logs.append(-math.inf)
            continue
        if not hit:
            smooth *= 2
            logs.append(math.log(100 / (smooth * total)))
        else:
            logs.append(math.log(100 * hit / total))
    if not logs or not counts[0]:
        return 0.0, penalty
    mean = sum(logs) / len(logs)
    return (penalty * math.exp(mean) if mean > -math.inf else 0.0), penalty


def rouge(output: Sequence[str], reference: Sequence[str]) -> tuple[float, float, float]:
    """F scores of shared unigrams, shared bigrams (as sets) and the union over sentences of longest common subsequences."""

    def score(hit: int, ours: int, theirs: int) -> float:
        p, r = (hit / ours if ours else 0.0), (hit / theirs if theirs else 0.0)
        return 2 * p * r / (p + r + 1e-8)

    def sentences(tokens: Sequence[str]) -> list[list[str]]:
        return [s.split() for s in " ".join(tokens).split(".") if s]

    a, b = sentences(output), sentences(reference)
    mine, other = [w for s in a for w in s], [w for s in b for w in s]
    parts = []
    for n in (1, 2):
        x, y = set(grams(mine, n)), set(grams(other, n))
        parts.append(score(len(x & y), len(x), len(y)))
    union = {w for r in b for s in a for w in lcs_items(r, s)}
    return parts[0], parts[1], score(len(union), len(set(mine)), len(set(other)))


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """Sum of the products of the weights of all pairs of which the earlier has the larger value, bit by bit of the values' ranks."""
    distinct, rank = np.unique(values, return_inverse=True)
    weights = weights.astype(np.int64)
    total = 0
    for bit in range(int(len(distinct) - 1).bit_length() if len(distinct) else 0):
        key = rank >> (bit + 1)
        order = np.argsort(key, kind="stable")
        one = (rank[order] >> bit) & 1
        w = weights[order]
        before = np.cumsum(w * one)
        start = np.searchsorted(key[order], key[order])
        earlier = before - np.where(start > 0, before[start - 1], 0)
        total += int((earlier * w * (1 - one)).sum())
    return total



_BOXED = re.compile(r"\\boxed\s*\{")


def math_answer(text: str) -> str:
    """The last boxed expression, else the last one between dollars, else the last number, else the text."""
    found = list(_BOXED.finditer(text))
    if found:
        depth, at = 1, found[-1].end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        return text[found[-1].end() : at - 1 if not depth else at].strip()
    inside = re.findall(r"\$+([^$]+)\$+", text)
    if inside:
        return inside[-1].strip()
    numbers = re.findall(r"-?\d[\d,]*(?:\.\d+)?(?:\s*/\s*\d+)?%?", text)
    return numbers[-1] if numbers else text.strip()


def _value(text: str) -> Fraction | None:
    plain = re.sub(r"\\(?:left|right|,|!|;|text\{[^}]*\}|mathrm\{[^}]*\})|\\?\$|\s|\\%|%", "", text).replace("{,}", "").replace(",", "")
    plain = re.sub(r"\\d?t?frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}", r"\1/\2", plain).rstrip(".")
    m = re.fullmatch(r"([+-]?\d*\.?\d+)(?:/([+-]?\d*\.?\d+))?", plain)
    try:
        return Fraction(m[1]) / Fraction(m[2] or 1) if m else None
    except ZeroDivisionError:
        return None


def math_equal(output: str, reference: str) -> bool:
    """Whether two answers are the same number, to six digits, or the same text without blanks: numbers and fractions only, no symbolic algebra."""
    a, b = math_answer(output), math_answer(reference)
    x, y = _value(a), _value(b)
    if x is not None and y is not None:
        return abs(x - y) <= Fraction(1, 10**6) * max(1, abs(y))
    return re.sub(r"\s|\\left|\\right", "", a) == re.sub(r"\s|\\left|\\right", "", b)


def _best(score: Callable[[str, str], float], kind: str):
    """A UDF (text, references) -> the largest score; 0 without references."""

    @F.pandas_udf(kind)
    def run(text: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([max((score(t or "", r) for r in ([] if refs is None else refs) if r is not None), default=0) for t, refs in zip(text, references)])

    return run


def best_similarity():
    return _best(similarity, "double")


def best_prefix():
    return _best(common_prefix, "int")


def best_substring():
    return _best(common_substring, "int")


def any_math():
    return _best(lambda a, b: int(math_equal(a, b)), "int")


def edits():
    """A UDF of the edit distance of two token arrays."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b)])

    return run


def repeated(length: int):
    @F.pandas_udf("struct<most_repeated string, count int>")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([most_repeated(t or "", length) for t in text], columns=["most_repeated", "count"])

    return run


def sari_scores(most: int = 4):
    @F.pandas_udf("struct<sari_score double, sari_add double, sari_keep double, sari_del double>")
    def run(source: pd.Series, output: pd.Series, references: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sari(list(s), list(o), [list(r) for r in refs], most) for s, o, refs in zip(source, output, references)], columns=["sari_score", "sari_add", "sari_keep", "sari_del"])

    return run


def bleu_statistics():
    """A UDF (tokens, references' tokens) -> (counts, sentence score, sentence brevity penalty)."""

    @F.pandas_udf("struct<counts array<long>, bleu_score double, bleu_bp double>")
    def run(output: pd.Series, references: pd.Series) -> pd.DataFrame:
        rows = []
        for o, refs in zip(output, references):
            counts = bleu_counts([t for t in o if t], [[t for t in r if t] for r in refs])
            rows.append((counts, *bleu(counts, effective=True)))
        return pd.DataFrame(rows, columns=["counts", "bleu_score", "bleu_bp"])

    return run


def rouge_scores():
    @F.pandas_udf("struct<rouge1 double, rouge2 double, rougeL double>")
    def run(output: pd.Series, reference: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rouge(list(o), list(r)) for o, r in zip(output, reference)], columns=["rouge1", "rouge2", "rougeL"])

    return run

"""Isotonic calibration on the driver, over bounded samples."""

from __future__ import annotations

import numpy as np


def isotonic(score: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, value) of the weighted least-squares non-decreasing fit, by pooling adjacent violators; equal scores are pooled first."""
    if not len(score):
        return np.array([0.0]), np.array([0.0])
    order = np.argsort(score, kind="stable")
    knots, first = np.unique(score[order], return_index=True)
    w = np.add.reduceat(weight[order], first)
    v = np.add.reduceat((weight * target)[order], first) / w
    stack: list[list[float]] = []
    for k in range(len(knots)):
        stack.append([v[k], w[k], 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            total = a[1] + b[1]
            stack.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return knots, np.repeat([s[0] for s in stack], [int(s[2]) for s in stack])


def apply(knots: np.ndarray, values: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The fit at ``score``, linear between knots and flat beyond them."""
    return np.interp(score, knots, values)

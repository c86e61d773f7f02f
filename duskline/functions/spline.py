"""Natural cubic spline of a number, as Spark columns.

The columns are the ones the usual statistics packages make: cubic B-splines
without the first, with the second derivative held at zero on both ends by the
orthogonal complement of that condition. Spark evaluates the equal truncated
power form; the small matrix between the two forms comes from a dozen points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F


def spline_columns(x: Column, inner: Sequence[float], low: float, high: float) -> list[Column]:
    """One column per degree of freedom: ``len(inner) + 1`` of them."""
    powers = [F.lit(1.0), *truncated_powers(x, inner, low, high)]
    weights = power_weights(inner, low, high)
    return [
        sum((F.lit(float(w)) * p for w, p in zip(column[1:], powers[1:])), F.lit(float(column[0])))
        for column in weights.T
    ]


def truncated_powers(x: Column, inner: Sequence[float], low: float, high: float) -> list[Column]:
    """The scaled number and its bends at the knots, straight beyond both ends."""
    scaled = (x - F.lit(float(low))) / F.lit(float(high - low))
    knots = _scaled_knots(inner, low, high)
    return [scaled, *_bends(scaled, knots, lambda v: F.greatest(v, F.lit(0.0)))]


def power_weights(inner: Sequence[float], low: float, high: float) -> np.ndarray:
    """Matrix from the truncated power form to the spline columns."""
    knots = _scaled_knots(inner, low, high)
    points = np.linspace(0.0, 1.0, 8 * len(knots))
    bends = _bends(points, knots, lambda v: np.maximum(v, 0.0))
    powers = np.column_stack([np.ones_like(points), points, *bends])
    return np.linalg.lstsq(powers, natural_basis(points, knots), rcond=None)[0]


def natural_basis(points: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Natural spline basis at a few points; ``knots`` include both ends."""
    full = np.concatenate([np.repeat(knots[0], 3), knots, np.repeat(knots[-1], 3)])
    ends = np.array([knots[0], knots[-1]])
    curvature = _b_splines(ends, full, derivative=2)[:, 1:]
    complement = np.linalg.qr(curvature.T, mode="complete")[0][:, 2:]
    return _b_splines(points, full)[:, 1:] @ complement


def _scaled_knots(inner: Sequence[float], low: float, high: float) -> np.ndarray:
    return (np.array([low, *inner, high], dtype=float) - low) / (high - low)


def _bends(x, knots, positive):
    last = knots[-1]

    def cubic(knot):
        hinge, end = positive(x - float(knot)), positive(x - float(last))
        return (hinge * hinge * hinge - end * end * end) / float(last - knot)

    reference = cubic(knots[-2])
    return [cubic(knot) - reference for knot in knots[:-2]]


def _b_splines(points: np.ndarray, full: np.ndarray, derivative: int = 0) -> np.ndarray:
    """Cubic B-splines, or their second derivative, one column per spline."""
    count = len(full) - 4
    span = np.clip(np.searchsorted(full, points, side="right") - 1, 3, count - 1)
    table = np.zeros((len(points), len(full) - 1))
    table[np.arange(len(points)), span] = 1.0
    x = points[:, None]
    for degree in range(1, 4):
        left, right = full[: -degree - 1], full[degree + 1 :]
        rise = _reciprocal(full[degree:-1] - left)
        fall = _reciprocal(right - full[1 : len(full) - degree])
        if degree > 3 - derivative:
            table = degree * (rise * table[:, :-1] - fall * table[:, 1:])
        else:
            table = (x - left) * rise * table[:, :-1] + (right - x) * fall * table[:, 1:]
    return table


def _reciprocal(width: np.ndarray) -> np.ndarray:
    return np.divide(1.0, width, out=np.zeros_like(width), where=width > 0)

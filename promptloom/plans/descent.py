"""Minimising a loss whose value and gradient are sums over a distributed table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Called with a point, returns the loss and its gradient there.
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]

MEMORY = 8
# a step must bring this share of what the slope promises
SUFFICIENT = 1e-4
HALVINGS = 12


def lbfgs(objective: Objective, start: np.ndarray, iterations: int, tolerance: float = 1e-5) -> np.ndarray:
    """The best point found by limited-memory BFGS from ``start``.

    Every call of ``objective`` is one job over the table; what stays here are
    ``MEMORY`` pairs of vectors. Steps are halved until the loss falls enough, so
    the result is never worse than the start, whatever the loss looks like.
    """
    point = start.astype(np.float64)
    loss, slope = objective(point)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        direction = _direction(slope, steps)
        promised = float(slope @ direction)
        if promised >= 0:
            # a bent loss can spoil the memory: go on downhill without it
            steps, direction = [], -slope
            promised = -float(slope @ slope)
        if -promised <= tolerance * max(1.0, abs(loss)) * 1e-3:
            break
        size = 1.0 if steps else 1.0 / max(1.0, float(np.abs(slope).sum()))
        for _ in range(HALVINGS):
            tried = point + size * direction
            new_loss, new_slope = objective(tried)
            if new_loss <= loss + SUFFICIENT * size * promised:
                break
            size /= 2
        else:
            break
        moved, bent = tried - point, new_slope - slope
        if float(moved @ bent) > 1e-12:
            steps = [*steps[1 - MEMORY :], (moved, bent)]
        gained = loss - new_loss
        point, loss, slope = tried, new_loss, new_slope
        if gained <= tolerance * max(1.0, abs(loss)):
            break
    return point


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope turned downhill by the inverse curvature that the last steps have seen."""
    out = -slope
    shares = []
    for moved, bent in reversed(steps):
        share = float(moved @ out) / float(moved @ bent)
        shares.append(share)
        out = out - share * bent
    if steps:
        moved, bent = steps[-1]
        out = out * (float(moved @ bent) / float(bent @ bent))
    for (moved, bent), share in zip(steps, reversed(shares)):
        out = out + moved * (share - float(bent @ out) / float(moved @ bent))
    return out

"""The cutting-stock linear program by column generation, over a histogram of piece lengths.

Lengths are rounded up to classes of GRAIN tokens. The master program chooses how often each pattern
(a multiset of classes that fits a sequence) is used so that all pieces are covered with the
fewest sequences. Its dual values are the prices of the classes; a knapsack dynamic program
finds the pattern worth most at these prices, which enters the basis. The bound z / value of the best
pattern ends the search. Everything here is as large as the histogram, whatever the number of pieces.
"""

from __future__ import annotations

import numpy as np

# Tokens by which lengths are classed.
GRAIN = 16
# The search ends when the bound shows less than this share to gain, or after so many patterns.
GAP = 1e-3
MAX_PATTERNS = 4000
# Needs are raised by up to this share, each by another, so that no two steps tie and the search can't stall.
SPREAD = 1e-4


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of classes 1..len(prices) with total size <= capacity and the highest price."""
    sizes = np.flatnonzero(prices > 1e-12) + 1
    worth = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    prices_of = prices[sizes - 1]
    for room in range(1, capacity + 1):
        fit = np.searchsorted(sizes, room, side="right")
        worth[room] = worth[room - 1]
        if fit:
            value = prices_of[:fit] + worth[room - sizes[:fit]]
            i = int(np.argmax(value))
            if value[i] > worth[room]:
                worth[room], choice[room] = value[i], sizes[i]
    pattern = np.zeros(len(prices))
    room = capacity
    while room > 0:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(worth[capacity]), pattern


def solve(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: how many pieces of each class) and their uses in the optimum of the relaxed program.

    counts: pieces of size 1..len(counts); classes without pieces take no part.
    """
    present = np.flatnonzero(counts > 0)
    m = len(present)
    if m == 0:
        return np.zeros((0, len(counts))), np.zeros(0)
    need = counts[present] * (1 + SPREAD * np.random.default_rng(1).random(m))
    basis = np.diag(np.floor(capacity / (present + 1.0)))
    inverse = np.diag(1 / np.diag(basis))
    uses = inverse @ need
    for _ in range(MAX_PATTERNS):
        prices = np.maximum(inverse.sum(axis=0), 0)
        every = np.zeros(len(counts))
        every[present] = prices
        value, pattern = best_pattern(every, capacity)
        if value <= 1 + 1e-9 or uses.sum() * (1 - 1 / value) <= GAP * uses.sum():
            break
        column = pattern[present]
        move = inverse @ column
        able = move > 1e-9
        ratio = np.full(m, np.inf)
        ratio[able] = uses[able] / move[able]
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        uses = np.maximum(uses - step * move, 0)
        uses[out] = step
        basis[:, out] = column
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    patterns = np.zeros((m, len(counts)))
    patterns[:, present] = basis.T
    return patterns, uses

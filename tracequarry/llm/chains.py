"""Messages along many chains at once: Viterbi (max-sum) and forward-backward (sum-product).

Chains are cut into chunks of equal size. Chunk by chunk, all in step, the transfer matrix of
each chunk is built; the chunks of a chain are joined in order; then all chunks run again from
their known entry. So a chain of any length takes few numpy calls.
"""

from __future__ import annotations

import numpy as np

CHUNK = 32


class MaxSum:
    """Scores, with one penalty for any change of state."""

    def __init__(self, penalty: float):
        self.penalty = penalty

    def start(self, states: int) -> tuple[np.ndarray, np.ndarray]:
        identity = np.full((states, states), -1e30)
        np.fill_diagonal(identity, 0.0)
        return np.zeros(states), identity

    def move(self, x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.maximum(x, x.max(-1, keepdims=True) - self.penalty) + e

    def join(self, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (v[:, :, None] + m).max(1)

    def level(self, x: np.ndarray) -> np.ndarray:
        return x - x.max(axis=tuple(range(1, x.ndim)), keepdims=True)


class SumProduct:
    """Weights; ``steps[i, j]`` is that of going from state i to state j.

    A chain is entered from, and left to, any state alike, each with its step.
    """

    def __init__(self, steps: np.ndarray):
        self.steps = steps

    def start(self, states: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full(states, 1.0 / states), np.eye(states)

    def move(self, x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (x @ self.steps) * e

    def join(self, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (v[:, :, None] * m).sum(1)

    def level(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.max(axis=tuple(range(1, x.ndim)), keepdims=True), 1e-300)


def messages(emissions: np.ndarray, counts: np.ndarray, algebra: MaxSum | SumProduct) -> np.ndarray:
    """For each item the message up to and with it, over chains of ``counts`` items one after another."""
    n, states = emissions.shape
    first, identity = algebra.start(states)
    if not n:
        return np.zeros((0, states))
    starts = np.cumsum(counts) - counts
    chunks = -(-counts // CHUNK)
    of = np.repeat(np.arange(len(counts)), chunks)
    number = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = starts[of] + number * CHUNK
    size = np.minimum(CHUNK, starts[of] + counts[of] - begin)
    entry = np.tile(first, (len(of), 1))
    inner = np.flatnonzero(number < chunks[of] - 1)  # all full, another chunk follows
    if len(inner):
        moved = np.tile(identity, (len(inner), 1, 1))
        for t in range(CHUNK):
            moved = algebra.level(algebra.move(moved, emissions[begin[inner] + t][:, None, :]))
        order = np.argsort(number[inner], kind="stable")
        by_number = number[inner][order]
        for k in range(int(by_number[-1]) + 1):
            at = order[np.searchsorted(by_number, k) : np.searchsorted(by_number, k, side="right")]
            entry[inner[at] + 1] = algebra.level(algebra.join(entry[inner[at]], moved[at]))
    out = np.empty((n, states))
    x = entry
    for t in range(int(size.max())):
        x = algebra.level(algebra.move(x, emissions[np.minimum(begin + t, n - 1)]))
        live = size > t
        out[begin[live] + t] = x[live]
    return out


def best_states(emissions: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The state of each item on the best path; of equal states the first."""
    algebra = MaxSum(penalty)
    both = messages(emissions, counts, algebra) + messages(emissions[::-1], counts[::-1], algebra)[::-1] - emissions
    return both.argmax(1)


def marginals(weights: np.ndarray, counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The probability of each state at each item."""
    forward = messages(weights, counts, SumProduct(steps))
    backward = messages(weights[::-1], counts[::-1], SumProduct(steps.T))[::-1]
    both = forward * backward / weights
    return both / both.sum(1, keepdims=True)

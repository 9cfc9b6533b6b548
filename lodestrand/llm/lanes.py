"""Runs a transition array over many places of a byte buffer at once.

A buffer is cut into lanes that all begin in the automaton's start state. A cut is exact
only after a byte that leads to the start state from every state, so cuts are looked for
behind such bytes; where there is none for long, the lane just grows.
"""

from __future__ import annotations

import numpy as np


def cut(resets: np.ndarray, total: int, step: int) -> np.ndarray:
    """Lane starts about `step` apart, each behind a reset position; the first is 0, and `total` ends the array."""
    want = np.arange(step, total, step)
    found = np.searchsorted(resets, want - 1)
    starts = resets[np.minimum(found, len(resets) - 1)][found < len(resets)] + 1 if len(resets) else want[:0]
    return np.unique(np.concatenate(([0], starts[starts < total], [total]))).astype(np.int64)


def scan(text: np.ndarray, starts: np.ndarray, nexts: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where matches end (the places behind them, ascending) and the accept masks there. nexts: next state at [state * 256 + byte]; the start state is 0."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    by_length, at = lengths[order], starts[:-1][order].copy()
    state = np.zeros(len(order), np.int32)
    places, masks = [np.zeros(0, np.int64)], [np.zeros(0, accepts.dtype)]
    live = np.searchsorted(-by_length, -np.arange(int(by_length[0]) if len(order) else 0), side="left")  # lanes longer than the step
    for n in live:
        s = nexts[state[:n] * 256 + text[at[:n]]]
        state[:n] = s
        at[:n] += 1
        met = accepts[s]
        if met.any():
            some = np.flatnonzero(met)
            places.append(at[some])
            masks.append(met[some])
    place, mask = np.concatenate(places), np.concatenate(masks)
    order = np.argsort(place, kind="stable")
    return place[order], mask[order]

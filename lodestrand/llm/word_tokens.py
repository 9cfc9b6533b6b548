"""Token ids of word_bpe_49k.json, word by word.

The tokenizer drops white space and lets nothing reach across it, so a normalised text's
ids are the ids of its words, one after another. The words of a batch are cut as columns of
bytes (token_counts.py); each distinct one runs once through the compiled transducer, all of
them side by side, and a gather puts their ids where the words are. From batch to batch a
worker keeps the transducer only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from lodestrand.llm.common import HELD, Memory
from lodestrand.llm.token_counts import _SPACES, Full, encoded, normal, transducer, words

#: Characters of text that are cut into words at once. A longer text is cut at the next white space after so many.
STRETCH = 1 << 21


def stretches(text: str) -> list[str]:
    """A text cut at white space, which nothing reaches across."""
    out, at = [], 0
    while len(text) - at > STRETCH and (m := _SPACES.search(text, at + STRETCH)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:] if at else text]


def _bytes(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each entry begins in them (one more than entries)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset :][: len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _column(body: np.ndarray, at: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])


class Words:
    """One vocabulary."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.special = re.compile("|".join(map(re.escape, self.machine.special)))
        self.pieces, self.words = Memory(0), Memory(0)  # nothing is remembered beside the transducer

    @property
    def machine(self):
        return transducer(self.path)

    def _encoded(self, body: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        try:
            return encoded(self.machine, body, stop)
        except Full:
            self.machine.reset()
            half = len(stop) // 2
            cut = stop[half - 1]
            (one, at), (two, further) = self._encoded(body[:cut], stop[:half]), self._encoded(body[cut:], stop[half:] - cut)
            return np.concatenate((one, two)), np.concatenate((at, at[-1] + further[1:]))

    def _joined(self, parts: list[str]) -> tuple[memoryview, list[int]]:
        """The ids of normal texts one after another, and where each text's begin in them (one more than texts)."""
        body, ends, starts = words(parts)
        stop = np.flatnonzero(ends) + 1
        if not len(stop):
            return memoryview(b""), [0] * (len(parts) + 1)
        coded = _column(body, np.concatenate(([0], stop))).dictionary_encode()
        distinct, at = _bytes(coded.dictionary)
        ids, before = self._encoded(distinct, at[1:])
        found, at = _bytes(_column(ids.view(np.uint8), 4 * before).take(coded.indices))
        return memoryview(found), at[np.searchsorted(stop, starts, side="right")].tolist()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, a special token's string in it being one token."""
        parts, of, marks = [], [], []

        def add(i: int, text: str, mark: bytes) -> None:
            cut = stretches(normal(text))
            parts.extend(cut)
            of.extend([i] * len(cut))
            marks.extend([b""] * (len(cut) - 1) + [mark])

        for i, t in enumerate(texts):
            if "<|" in t and self.special.search(t):
                at = 0
                for m in self.special.finditer(t):
                    add(i, t[at : m.start()], np.array([self.machine.special[m[0]]], "<u4").tobytes())
                    at = m.end()
                t = t[at:]
            add(i, t, b"")
        out: list[list[bytes]] = [[] for _ in texts]
        total = np.cumsum([len(p) for p in parts])
        lo = 0
        while lo < len(parts):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - len(parts[lo]) + 2 * STRETCH, side="right")))
            found, at = self._joined(parts[lo:hi])
            for i, a, b, mark in zip(of[lo:hi], at, at[1:], marks[lo:hi], strict=False):
                out[i] += [found[a:b], mark]
            lo = hi
        return [b"".join(x) for x in out]


_MADE: dict[str, Words] = {}
HELD["words"] = _MADE.clear


def ids_of(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, without added special tokens."""
    if path not in _MADE:
        _MADE[path] = Words(path)
    return _MADE[path].ids(texts)

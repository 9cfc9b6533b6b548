"""Byte-level BPE encoding and decoding with two tiers.

A text is cut into pre-tokens by the vocabulary's pattern. Tier one: a minimal perfect hash
over the vocabulary gives the id of a pre-token that is a token itself. Tier two, for the
misses: bytes in a linked list and a heap of possible merges, lowest rank first and
leftmost among equals. Workers remember a bounded number of pre-tokens with their ids, and,
under the vocabulary's own pattern, of stretches (white space and what follows up to the
next white space; no pre-token of that pattern reaches across its ends); what was asked for
last stays longest. Another pattern is applied to whole texts.

Null and empty texts have no ids, and decode to nothing. Special tokens' strings are
ordinary text. Repeated rows are encoded one by one; other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import re
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import HELD, Memory, arrow_map, documents, id_and_text, texts
from lodestrand.llm.perfect_hash import PerfectHash

#: Entries of a generation of what a worker remembers.
STRETCHES, PIECES = 80_000, 200_000
#: White space as the pattern's \s has it.
_WS = "\t-\r \x85\xa0  -     　"
_STRETCH = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Coder:
    """One vocabulary file with its lookup tiers."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the pattern's classes in this library's terms: \s there leaves x1c to x1f out
        self.pattern = regex.compile(pattern.replace(r"\s+(?!\S)", f"[{_WS}]+(?![^{_WS}])").replace(r"[^\s", f"[^{_WS}").replace(r"\s+", f"[{_WS}]+"))
        tokens = list(self.ranks)
        self.whole = PerfectHash(tokens)
        number = self.whole.numbers(tokens)
        self.stored: list[bytes] = [b""] * len(tokens)
        for t, k in zip(tokens, number.tolist(), strict=True):
            self.stored[k] = t
        self.id = np.zeros(len(tokens), np.int64)
        self.id[number] = list(self.ranks.values())
        most = max(self.ranks.values()) + 1
        by_id = [b""] * most
        for t, k in self.ranks.items():
            by_id[k] = t
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.by_stretch = pattern == default_pattern()
        self.stretches, self.pieces = Memory(STRETCHES), Memory(PIECES)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        split = list(map((_STRETCH if self.by_stretch else self.pattern).findall, batch))
        flat = list(chain.from_iterable(split))
        found = self.stretches.of(flat, self._of_stretches) if self.by_stretch else self.pieces.of(flat, self._of_pieces)
        out, at = [], 0
        for parts in split:
            out.append(b"".join(found[at : at + len(parts)]))
            at += len(parts)
        return out

    def _of_stretches(self, stretches: list[str]) -> list[bytes]:
        cut = list(map(self.pattern.findall, stretches))
        found = iter(self.pieces.of(list(chain.from_iterable(cut)), self._of_pieces))
        return [next(found) if len(parts) == 1 else b"".join(islice(found, len(parts))) for parts in cut]

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Tier one for all pre-tokens at once, tier two for its misses."""
        raw = [p.encode() for p in pieces]
        number = self.whole.numbers(raw)
        one = self.id[number].astype("<i4").tobytes()
        stored, merged = self.stored, self.merged
        return [one[4 * i : 4 * i + 4] if k >= 0 and stored[k] == p else merged(p) for i, (p, k) in enumerate(zip(raw, number.tolist(), strict=True))]

    def merged(self, piece: bytes) -> bytes:
        """Tier two: a heap over linked bytes. Part i ends before stop[i] (0: merged into another) and follows part before[i]; an entry is stale when one of its two parts has been merged since."""
        n, rank = len(piece), self.ranks.get
        stop, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = stop[i]
            if not j or j >= n or stop[j] != end:
                continue
            stop[i], stop[j] = end, 0
            before[end] = i
            if end < n and (r := rank(piece[i : stop[end]])) is not None:
                heappush(heap, (r, i, stop[end]))
            h = before[i]
            if h >= 0 and (r := rank(piece[h:end])) is not None:
                heappush(heap, (r, h, end))
        ids, ranks, i = [], self.ranks, 0
        while i < n:
            ids.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return pack(f"<{len(ids)}i", *ids)

    def decode(self, ids: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each list's bytes begin; `lists`: where each list begins in ids."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        first = ends - size
        source = np.arange(total) + np.repeat(self.at[ids] - first, size)
        return self.bytes[source], np.concatenate(([0], ends))[lists]


_CODERS: dict[tuple[str, str], Coder] = {}
HELD["coder"] = _CODERS.clear


def coder(path: str, pattern: str) -> Coder:
    """One for each worker and vocabulary."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns id and ids array<int>, one row for each row of `df`."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        gc.disable()  # many small objects, no cycles
        try:
            made = coder(path, pattern).encode(texts(batch.column(1)))
        finally:
            gc.enable()
        at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in made]))).astype(np.int32)
        return {"id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(made), "<i4")))}

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, ids array<int>", mb=2, keeps="coder")


def decode(df: DataFrame, ids_col: str = "ids", as_col: str = "decoded", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes that a column of ids stands for (null ids: empty); the other columns stay as they are."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    place, names = df.columns.index(ids_col), df.columns
    from pyspark.sql import types as T

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                lists = batch.column(place)
                if lists.null_count:
                    lists = pa.array([x or [] for x in lists.to_pylist()], type=lists.type)
                at = np.asarray(lists.offsets)[: len(lists) + 1].astype(np.int64)
                ids = np.asarray(lists.values)[at[0] : at[-1]]
                body, begin = coder(path, pattern).decode(ids, at - at[0])
                made = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, as_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(as_col, T.BinaryType())]))


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns: all documents encoded, and the ids decoded again."""
    coded = encode(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids",
    )
    return decode(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

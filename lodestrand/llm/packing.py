"""Best-fit packing by minimum bin slack.

Bins differ by the lengths in them only, so the plan is made on the histogram of lengths,
which has no more entries than a sequence has tokens. For each bin, the longest piece left
is set and a bitset of reachable sums over the lengths left (with their counts) finds the
fullest completion; the bin is filled and its pieces are removed. The next bin gets the same
answer until a length runs out, so a filling is repeated until then: at most as many
fillings as there are lengths, whatever the number of documents. Pieces are then ranked
within their length (in salted buckets, as one length may hold a third of all rows) and
look up their bin in the plan.

A null or empty text is one piece that holds the end id alone. Repeated rows are packed one
by one. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_map, documents, id_and_text, stored, texts
from lodestrand.llm.token_counts import default_vocabulary
from lodestrand.llm.word_tokens import ids_of


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """id, piece, start, length, ids (binary, little-endian unsigned 32-bit): each text's ids and the end id, cut into pieces of `size`."""
    path, end = vocabulary or default_vocabulary(), np.array([end_id], "<u4").tobytes()

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        rows, number, ids = [], [], []
        for i, x in zip(batch.column(0).to_pylist(), ids_of(texts(batch.column(1)), path), strict=True):
            x += end
            for k, a in enumerate(range(0, len(x), 4 * size)):
                rows.append(i)
                number.append(k)
                ids.append(x[a : a + 4 * size])
        return {"id": rows, "piece": number, "start": [k * size for k in number], "length": [len(x) // 4 for x in ids], "ids": ids}

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, piece int, start long, length long, ids binary", mb=2, keeps="transducer words")


def fillings(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Bins by minimum bin slack: ({length: how many in a bin}, how many such bins), for {length: pieces of that length}."""
    left, plan = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}, []
    while left:
        first = next(iter(left))
        bin_ = {first: 1}
        room, reach, steps = size - first, 1, []
        full = 1 << room
        mask = full * 2 - 1
        for n, c in left.items():
            c = min(c - (n == first), room // n)
            part = 1
            while c > 0 and not reach & full:
                part = min(part, c)
                steps.append((reach, n, part))
                reach = (reach | reach << part * n) & mask
                c -= part
                part *= 2
            if reach & full:
                break
        at = reach.bit_length() - 1
        for before, n, part in reversed(steps):
            if not before >> at & 1:
                bin_[n] = bin_.get(n, 0) + part
                at -= part * n
        times = min(left[n] // m for n, m in bin_.items())
        plan.append((bin_, times))
        for n, m in bin_.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return plan


def _by_length(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the rank at which each filling's share begins, pieces a bin, first sequence, first offset."""
    out: dict[int, list[list[int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bin_, times in plan:
        offset = 0
        for n, m in sorted(bin_.items(), reverse=True):
            out.setdefault(n, []).append([used.get(n, 0), m, sequence, offset])
            used[n] = used.get(n, 0) + m * times
            offset += m * n
        sequence += times
    return {n: tuple(np.array(rows, np.int64).T) for n, rows in out.items()}


def pack(lengths: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length` of at most `size`; `order` makes ranks repeatable. `lengths` should be a stored table, as it is read three times."""
    histogram = {r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    place = _by_length(fillings(histogram, size))
    buckets = max(1, round(sum(histogram.values()) ** 0.5))
    salted = lengths.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_bucket", (F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*order))).join(before, ["length", "_bucket"])
    names = [c for c in lengths.columns]
    ready = ranked.select(*names, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def run(batches):
        for batch in batches:
            n, rank = (np.asarray(batch.column(i)) for i in (names.index("length"), len(names)))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for one in np.unique(n):
                begin, many, first, at = place[int(one)]
                rows = np.flatnonzero(n == one)
                k = np.searchsorted(begin, rank[rows], side="right") - 1
                sequence[rows] = first[k] + (rank[rows] - begin[k]) // many[k]
                offset[rows] = at[k] + (rank[rows] - begin[k]) % many[k] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    out = T.StructType([*lengths.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ready.mapInArrow(run, out)


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row."""
    made = pieces(df, id_col, text_col, size, vocabulary=vocabulary)
    table = stored(made.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(table, size, ["id", "piece", "start", "length", "ids_crc32"])


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of packed over all documents."""
    return packed(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")

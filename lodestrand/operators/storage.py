"""Layout of records: sizes from the leaves up, offsets from the top down, redefined storage, tables in tables.

Items are rows of a tree (file, line, parent), as data_items() and parents() give them. Each
file's items come to one task, line by line, and files are laid out a batch at a time: a round of the
loops takes one level of all trees of a batch, and a tree of programs is at most 49 levels
deep. Nothing is written, joined or sent to the driver in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.text import picture
from lodestrand.operators.program import data_items

# Usages, those that no record of a run can be filled with, and bytes of binary numbers by digits.
USAGE = r"(?i)\b(?:USAGE\s+(?:IS\s+)?)?(COMP(?:UTATIONAL)?(?:-[0-9])?|BINARY|PACKED-DECIMAL|DISPLAY|POINTER|PROCEDURE-POINTER|FUNCTION-POINTER|INDEX)\b(?!-)"
REFUSED = ("COMP-1", "COMP-2", "POINTER", "PROCEDURE-POINTER", "FUNCTION-POINTER", "INDEX")
PACKED = ("COMP-3", "PACKED-DECIMAL")
BINARY = ("COMP", "COMP-4", "COMP-5", "BINARY")
#: Items that are laid out at a time, and those of the file that is open then.
ROWS = 100_000


def described(lines: DataFrame) -> DataFrame:
    """data_items() of lines with usage, redefines, and why an item can't be laid out (a table whose size depends on data, a usage that is refused)."""
    t = F.upper(F.trim("text"))
    word = F.regexp_replace(F.upper(F.regexp_extract(F.regexp_replace("text", "'[^']*'|\"[^\"]*\"", ""), USAGE, 1)), "COMPUTATIONAL", "COMP")
    items = data_items(lines, word.alias("usage"), F.regexp_extract(t, r"\sREDEFINES\s+([A-Z0-9-]+)", 1).alias("redefines"), t.rlike(r"\sOCCURS\s+[0-9]+\s+TO\b").alias("varies"))
    usage = F.when(F.col("usage") != "", F.col("usage"))
    why = F.when(F.col("varies"), "the table's size depends on data").when(usage.isin(*REFUSED), F.concat(usage, F.lit(" items have no bytes to fill")))
    return items.withColumns({"usage": usage, "redefines": F.when(F.col("redefines") != "", F.col("redefines")), "problem": why}).drop("varies")


def record_layout(items: DataFrame) -> DataFrame:
    """Items with depth, root, base (the line that a redefinition shares its start with, through others), size (of one occurrence), bytes (of all) and start (of the first occurrence, from the root's).

    items: (file, line, level, name, picture, occurs, usage, redefines, problem, parent). A group's size is the sum of its
    children times their occurrences; children that redefine one before them add nothing unless they are longer. A redefinition
    of a name that no sibling before it has stands on its own. Items with a problem, and groups with one inside, have no size.
    Usage and problems come down from groups; an elementary item has a byte for each place, half of that and a sign where it is packed, 2, 4 or 8
    where it is binary. `shared` is the base of the nearest of the item and its groups that has one, `chain` has the occurrences, size and line of the item and its groups, from the item up.
    """
    made = picture(F.col("picture"))
    kept = items.filter("level <> 88 AND file IS NOT NULL").withColumns({"_digits": F.coalesce(made["digits"], made["length"]).cast("long"), "_length": made["length"].cast("long")})
    # a window brings each file's items to one task, by line, and uses the order that parents() has made
    sorted_ = kept.withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy("line"))).drop("_n")
    line = items.schema["line"].dataType.simpleString()
    more = f"depth int, root {line}, base {line}, shared {line}, size bigint, bytes bigint, start bigint, chain array<struct<times:bigint,stride:bigint,line:{line}>>"
    schema = T.StructType([*[f for f in sorted_.schema.fields if not f.name.startswith("_")], *T.StructType.fromDDL(more).fields])
    return sorted_.mapInArrow(_laid_out, schema)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files of a stream that is ordered by file and line, a few at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begins = _begins(table)
        if begins[-1]:
            yield from _layout_of(table.slice(0, int(begins[-1]))).to_batches()
        held = table.slice(int(begins[-1])).to_batches()
    if held and sum(b.num_rows for b in held):
        yield from _layout_of(pa.Table.from_batches(held).combine_chunks()).to_batches()


def _begins(table: pa.Table) -> np.ndarray:
    """The rows with which files begin."""
    file = table.column("file")
    other = pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False) if len(file) > 1 else np.zeros(0, bool)
    return np.concatenate([[0], np.nonzero(other.astype(bool))[0] + 1])


def _coded(column: pa.ChunkedArray, words: list[str]) -> np.ndarray:
    """Places in a list of words, which grows; -1 for null."""
    made = column.combine_chunks().dictionary_encode() if isinstance(column, pa.ChunkedArray) else column.dictionary_encode()
    made = made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made
    at = {w: k for k, w in enumerate(words)}
    place = np.empty(len(made.dictionary) + 1, np.int64)
    for k, w in enumerate(made.dictionary.to_pylist()):
        place[k] = at.setdefault(w, len(words))
        if place[k] == len(words):
            words.append(w)
    place[-1] = -1
    return place[made.indices.fill_null(len(made.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)]


def _numbers(column: pa.ChunkedArray, null: int) -> np.ndarray:
    return pc.fill_null(pc.cast(column, pa.int64()), null).to_numpy()


#: Stands for null among whole numbers.
NONE = np.iinfo(np.int64).min


def _layout_of(table: pa.Table) -> pa.Table:
    n = table.num_rows
    row, first = np.arange(n), _begins(table)
    file = np.searchsorted(first, row, side="right") - 1
    line = _numbers(table.column("line"), 0)
    parent = _numbers(table.column("parent"), NONE)
    # rows by (file, line); a parent that is no item makes an item unreachable
    lines = np.unique(np.concatenate([line, parent]), return_inverse=True)[1]
    at, want = file * (2 * n + 1) + lines[:n], file * (2 * n + 1) + lines[n:]
    order = np.argsort(at, kind="stable")
    spot = np.minimum(np.searchsorted(at[order], want), n - 1)
    up = np.where((parent != NONE) & (at[order][spot] == want), order[spot], -1)
    depth = np.where(parent == NONE, 0, -1)
    root = np.where(depth == 0, row, -1)
    words: list[str] = []
    usage, problem = _coded(table.column("usage"), words), _coded(table.column("problem"), words)
    refused = np.full(len(words) + 1, -1)
    for k, w in enumerate(list(words)):
        if w in REFUSED:
            words.append(f"{w} items have no bytes to fill")
            refused[k] = len(words) - 1
    level = 0
    while True:
        here = np.nonzero((depth < 0) & (up >= 0) & (depth[up] == level))[0]
        if not len(here):
            break
        level += 1
        over = up[here]
        depth[here], root[here] = level, root[over]
        usage[here] = np.where(usage[here] < 0, usage[over], usage[here])
        own = np.where(problem[here] < 0, refused[usage[here]], problem[here])
        problem[here] = np.where(own < 0, problem[over], own)
    # bases: the last sibling before an item with the name that it redefines, through others
    named: list[str] = []
    name, asked = _coded(table.column("name"), named), _coded(table.column("redefines"), named)
    family = np.where(up >= 0, up, n + file)
    both = np.unique(np.concatenate([family * (len(named) + 1) + name, family * (len(named) + 1) + asked]), return_inverse=True)[1]
    sibling = np.where((depth >= 0) & (name >= 0), both[:n], 2 * n) * n + row
    sibling.sort()
    spot = np.searchsorted(sibling, both[n:] * n + row) - 1
    hit = (asked >= 0) & (spot >= 0) & (sibling[np.maximum(spot, 0)] // n == both[n:])
    base = np.where(hit, sibling[np.maximum(spot, 0)] % n, -1)
    while ((base >= 0) & (base[base] >= 0)).any():
        base = np.where((base >= 0) & (base[base] >= 0), base[base], base)
    view = np.where(base >= 0, base, row)
    shared = base.copy()
    # sizes from the leaves up
    digits, length, times = _numbers(table.column("_digits"), NONE), _numbers(table.column("_length"), NONE), _numbers(table.column("occurs"), 1)
    kind = np.zeros(len(words) + 1, int)
    for k, w in enumerate(words):
        kind[k] = 1 if w in PACKED else 2 if w in BINARY else 0
    of = np.where(usage >= 0, kind[usage], 0)
    size = np.select([(of == 1) & (digits == NONE), of == 1, (of == 2) & (digits == NONE), of == 2], [np.full(n, NONE), digits // 2 + 1, np.full(n, 8), np.where(digits <= 4, 2, np.where(digits <= 9, 4, 8))], length)
    group, missing, parts, widest = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool), np.full(n, NONE)
    bytes_ = np.full(n, NONE)
    for d in range(level, -1, -1):
        here = np.nonzero(depth == d)[0]
        made = np.where(parts[here], np.where(missing[here], NONE, group[here]), size[here])
        size[here] = np.where(problem[here] >= 0, NONE, made)
        known = size[here] != NONE
        bytes_[here] = np.where(known, size[here] * times[here], NONE)
        np.maximum.at(widest, view[here], bytes_[here])
        below = here[up[here] >= 0]
        parts[up[below]] = True
        missing[up[below[bytes_[below] == NONE]]] = True
        own = below[(base[below] < 0) & (widest[below] != NONE)]
        np.add.at(group, up[own], widest[own])
    # starts: what stands before an item in its group, then the group's own start
    adds = np.where((base < 0) & (widest != NONE) & (depth >= 0), widest, 0)
    order = np.lexsort((row, family))
    before = np.cumsum(adds[order]) - adds[order]
    fresh = np.concatenate([[True], family[order][1:] != family[order][:-1]]) if n else np.zeros(0, bool)
    start = np.empty(n, np.int64)
    start[order] = before - before[fresh][np.cumsum(fresh) - 1]
    start = np.where(base >= 0, start[base], start)
    start[depth == 0] = 0
    for d in range(1, level + 1):
        here = np.nonzero(depth == d)[0]
        start[here] += start[up[here]]
        shared[here] = np.where(shared[here] < 0, shared[up[here]], shared[here])
    # the item and its groups, from the item up
    reached = np.nonzero(depth >= 0)[0]
    sizes = depth[reached] + 1
    ends = np.cumsum(sizes)
    chain = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    now, to = reached.copy(), ends - sizes
    while len(now):
        chain[to] = now
        on = up[now] >= 0
        now, to = up[now[on]], to[on] + 1
    whole = lambda x, type_: pa.array(x, mask=x == NONE).cast(type_)
    line_type = table.schema.field("line").type
    lined = lambda x: pa.array(np.where(x >= 0, line[np.maximum(x, 0)], 0), mask=x < 0).cast(line_type)
    worded = lambda x: pa.array(words + [None], pa.string()).take(pa.array(np.where(x >= 0, x, len(words))))
    steps = pa.StructArray.from_arrays([whole(times[chain], pa.int64()), whole(size[chain], pa.int64()), lined(chain)], names=["times", "stride", "line"])
    out = {c: table.column(c) for c in table.column_names if not c.startswith("_")}
    out["usage"], out["problem"] = worded(usage), worded(problem)
    made = pa.table({**out, "depth": pa.array(depth, pa.int32()), "root": lined(root), "base": lined(base), "shared": lined(shared), "size": whole(size, pa.int64()), "bytes": whole(bytes_, pa.int64()), "start": pa.array(start, pa.int64())})
    made = made.take(pa.array(reached))
    return made.append_column("chain", pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), steps))


def occurrences(placed: DataFrame) -> DataFrame:
    """(file, root, line, name, subscripts, start, bytes): each occurrence of each elementary item of record_layout(), with a subscript for each table that it is in. Unnamed items and those without a size have none; the start is null where a group around has no size."""
    now = placed.filter("picture IS NOT NULL AND size IS NOT NULL AND name <> 'FILLER'").select("file", "root", "line", "name", F.col("size").alias("bytes"), F.when(~F.exists("chain", lambda x: x["stride"].isNull()), F.col("start")).alias("start"), F.filter("chain", lambda x: x["times"] != 1).alias("chain"), F.array().cast("array<int>").alias("subscripts"))
    deepest = placed.agg(F.max(F.size(F.filter("chain", lambda x: x["times"] != 1)))).first()[0] or 0  # one number
    for _ in range(deepest):
        none, step = F.size("chain") == 0, F.get("chain", F.lit(0))
        each = now.withColumn("_k", F.explode(F.when(none, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), step["times"].cast("int")))))
        now = each.select(
            "file", "root", "line", "name", "bytes", F.when(none, F.col("start")).otherwise(F.col("start") + (F.col("_k") - 1) * step["stride"]).alias("start"), F.slice("chain", F.lit(2), F.greatest(F.size("chain") - 1, F.lit(0))).alias("chain"),
            F.when(none | (step["times"] <= 1), F.col("subscripts")).otherwise(F.concat(F.array("_k"), "subscripts")).alias("subscripts"))
    return now.select("file", "root", "line", "name", "subscripts", "start", "bytes")


def redefined_values(placed: DataFrame, contents: DataFrame) -> DataFrame:
    """(file, line, name, value, source, overlaps): values that an item may hold because storage that it or its nearest redefining group shares has items of the same picture with values; `overlaps` tells whether their bytes meet.

    contents: (file, line, value) of VALUE clauses.
    """
    items = placed.filter("picture IS NOT NULL")
    found = items.filter("shared IS NOT NULL").select("file", "line", "name", "picture", "start", "bytes", F.col("shared").alias("_base"))
    given = contents.hint("merge").join(items.select("file", "line", "picture", "chain", F.col("start").alias("_start"), F.col("bytes").alias("_bytes")), ["file", "line"])
    held = given.select("file", F.col("line").alias("_in"), "picture", "value", "_start", "_bytes", F.explode(F.col("chain")["line"]).alias("_base"))  # all that it lies in, itself included
    meets = (F.col("start") < F.col("_start") + F.col("_bytes")) & (F.col("_start") < F.col("start") + F.col("bytes"))
    return found.hint("merge").join(held, ["file", "_base", "picture"]).select("file", "line", "name", "value", F.col("_in").alias("source"), F.coalesce(meets, F.lit(False)).alias("overlaps"))

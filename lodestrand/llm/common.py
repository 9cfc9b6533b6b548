"""What the corpus operators share: reading documents, shared scratch tables, Arrow plumbing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.sources.scratch import folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `documents` of a data folder; Spark opens the path, so any store that it reads will do."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, `id` and `text` (null text stays null); other columns, whatever their names, are pruned."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def id_key(column: Column) -> dict[str, Column]:
    """An id that may be null as two columns that are not."""
    return {"_kept_id": F.coalesce(column.cast("long"), F.lit(0).cast("long")), "_kept_none": column.isNull()}


def one_each(df: DataFrame, key: dict[str, Column], kept: DataFrame, also: list[Column], order: list[Column]) -> DataFrame:
    """The rows of `df` whose key is in `kept`, with all their columns; of those with equal key and `also` the first by `order`."""
    first = Window.partitionBy(*key, *also).orderBy(*order)
    found = df.withColumns(key).join(kept, list(key), "left_semi")
    return found.withColumn("_kept_first", F.row_number().over(first)).filter("_kept_first = 1").drop(*key, "_kept_first")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What workers keep from task to task, by name: how to drop it.
HELD: dict[str, Callable[[], None]] = {}


def release(keeps: str | None = None) -> None:
    """Drops what other operators than those named in `keeps` (with spaces between) have left in this worker process, and hands freed memory back to the system."""
    for name, drop in HELD.items():
        if name not in (keeps or "").split():
            drop()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Memory:
    """What a worker has computed for keys, in two generations of at most `most` entries and 128 bytes an entry on average, and a batch's new keys.

    What a batch asks for is moved to the younger one; when that is full it becomes the older one, and what was not asked for since is dropped.
    Keys of more than LONGEST characters (lines of text without spaces, say) are never kept, so memory follows neither their number nor their length.
    """

    LONGEST = 64

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old, self.size = most, {}, {}, 0

    def of(self, keys: list, learn: Callable[[list], list]) -> list:
        """The value of each key; `learn` is asked for those of new keys."""
        if len(self.young) > self.most or self.size > 128 * self.most:
            self.young, self.old, self.size = {}, self.young, 0
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        if gaps:
            new, long, size = [], {}, 0
            for k in dict.fromkeys(map(keys.__getitem__, gaps)):
                if (v := old.get(k)) is not None:
                    young[k] = v
                    size += len(k) + len(v)
                else:
                    new.append(k)
            if new:
                made = learn(new)
                if max(map(len, new)) > self.LONGEST:
                    long = {k: v for k, v in zip(new, made, strict=True) if len(k) > self.LONGEST}
                    made = [v for k, v in zip(new, made, strict=True) if k not in long]
                    new = [k for k in new if k not in long]
                young.update(zip(new, made, strict=True))
                size += sum(map(len, new)) + sum(map(len, made))
            self.size += size
            for i in gaps:
                v = young.get(keys[i])
                found[i] = long[keys[i]] if v is None else v
        return found


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], dict[str, object]], schema: str, mb: int = 4, keeps: str | None = None) -> DataFrame:
    """mapInArrow in which `each` gets batches of about `mb` MB, so that a task's memory doesn't follow the length of texts.

    Workers live from task to task; what operators other than `keeps` have remembered in one is dropped first.
    """
    import pyspark.sql.types as T

    out = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        for batch in batches:
            for part in parts(batch, mb << 20):
                made = each(part)
                yield pa.RecordBatch.from_arrays(
                    [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, made[f.name]) for f in arrow)],
                    schema=arrow,
                )

    return df.mapInArrow(run, out)


def parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text each; a longer single row is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    names = batch.schema.names
    if "text" not in names:
        yield batch
        return
    at = utf8(batch.column(names.index("text")))[1]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and where each row begins in them (one more than rows)."""
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, first = len(column), column.offset
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[first : first + n + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return text, at - at[0]


def texts(column: pa.Array) -> list[str]:
    """The texts of a string column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def smallest_first(id_col: str) -> Column:
    """Orders ids from the smallest; null ids come last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))

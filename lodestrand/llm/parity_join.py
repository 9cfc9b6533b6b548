"""Joins documents by the Jaccard similarity of their word shingles, through parity sketches.

Every shingle hashes to one bit, and a document's sketch is the XOR of its shingles' bits.
A shingle that only one of two documents has flips one bit at most, so the Hamming distance
of two sketches never exceeds the symmetric difference of their sets. Two sets of sizes a
and b at the threshold differ in D = (a + b) * (100 - percent) / (100 + percent) shingles
at most.

Size bands. Sizes are dealt into bands that double, with a band around each edge for pairs
across it. A band cuts its sketches into the same parts of 64 bits. A part's place, its bits and
the XOR of the whole hashes in it make a key, for parts that are not zero; bits alone would not
do, as a part that holds one shingle has only 64 values, which documents without a common shingle
share by chance. Of its keys in a band a document keeps the D + 1 that fewest documents have (of equally many, by hash): a linked pair differs in D parts at
most, so the rarest key that both have is among these (keys before it are not shared, and
there are D of those at most). Keys out of passages that many documents share are the ones
that go. Sketches hold so many parts that a document lacks D + 1 keys with a chance below 1e-12.

Documents that share a key are compared in three steps, none of which expands a key into
all pairs of its members. Equal sets are one class from the start. The members of a key meet
its smallest id, and linked ones form components. In keys that still hold several
components, what is outside the largest meets members of other components inside a join that
sifts by sketches of `FOLDED` bits (folded by XOR, so the bound stays). Where that would be
more than `HARD` comparisons for one key, its documents are joined by their rarest shingles
instead: in an order by frequency among these documents, a linked pair shares one of its
first n - ceil(n * percent / 100) + 1. What passes is sifted
again by sketches that grow with the set, and all links are confirmed on full sets from whole texts.

Null texts and texts without words have an empty set and are linked with nothing. A text
with fewer words than a shingle has the whole sequence as its one shingle. Very long texts
only have more keys, and a task holds a few of them at a time. Rows with one id are one
document (fully repeated rows are harmless); rows with a null id stand alone. An empty table
gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_map, documents, id_and_text, stored, utf8
from lodestrand.llm.near_dedup import _confirmed, _mixed, components, rare_shingles, shingles, still_open

#: Bits of the folded sketches that sift pairs inside a join.
FOLDED = 512
#: Comparisons that one key may ask for before its documents are joined by rare shingles instead.
HARD = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def most_different(a: int, b: int, percent: int) -> int:
    """Shingles in which two sets of these sizes may differ at most and still be linked."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """The bands of a set of n shingles: a number and the greatest size that belongs to it. Sets that may be linked have one in common."""
    k = n.bit_length() - 1
    low, high = 1 << k, 2 << k
    out = [(2 * k, high - 1)]
    if n * percent <= low * 100 and k:  # a set below the band may reach up to it
        out.append((2 * k - 1, low * 100 // percent))
    if n * 100 >= high * percent:
        out.append((2 * k + 1, high * 100 // percent))
    return out


def dealt(hashes: np.ndarray, top: int, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many parts the sketches of a band whose greatest size is `top` have, and each shingle's part and bit."""
    count = max(64, (most_different(top, top * 100 // percent, percent) + 1) * 5 // 4 + 1)
    at = (hashes >> np.uint64(16)) % np.uint64(64 * count)
    return count, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def parts_of(hashes: np.ndarray, top: int, percent: int) -> np.ndarray:
    """The sketch of a set in a band whose greatest size is `top`: parts of 64 bits each."""
    count, place, bit = dealt(hashes, top, percent)
    parts = np.zeros(count, np.uint64)
    np.bitwise_xor.at(parts, place, bit)
    return parts


def sums_of(hashes: np.ndarray, top: int, percent: int) -> np.ndarray:
    """For each part of that sketch the XOR of the whole hashes in it."""
    count, place, _ = dealt(hashes, top, percent)
    sums = np.zeros(count, np.uint64)
    np.bitwise_xor.at(sums, place, hashes)
    return sums


def keys_of(hashes: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """For each band of a set its keys, and how many of them it may spare. Sets that may differ in nothing have none, as equal sets are one class anyway."""
    n = len(hashes)
    need = most_different(n, n * 100 // percent, percent) + 1
    made = []
    for band, top in bands(n, percent) if need > 1 else []:
        parts, sums = parts_of(hashes, top, percent), sums_of(hashes, top, percent)
        at = np.flatnonzero(parts)
        keys = _mixed(_mixed(parts[at] * _MIX + at.astype(np.uint64)) * _MIX + sums[at])
        keys = _mixed(keys * _MIX + np.uint64(band))
        made.append((keys.view(np.int64), max(0, len(at) - need)))
    return made


def sketch_of(hashes: np.ndarray, bits: int | None = None) -> np.ndarray:
    """A sketch in longs, of the power of two that is twice the set's size or more if `bits` isn't given."""
    bits = bits or max(FOLDED, 1 << (2 * len(hashes) - 1).bit_length())
    out = np.zeros(bits // 64, np.uint64)
    at = (hashes >> np.uint64(16)) % np.uint64(bits)
    np.bitwise_xor.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    """A sketch's halves XORed until so many longs are left."""
    while len(sketch) > longs:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """id, n (set size), same (a 128-bit digest of the set, null if empty), keys0 to keys2 and spare0 to spare2 of its bands, sketch (of FOLDED bits) and whole (a sketch that follows the set's size)."""
    none = (np.zeros(0, np.int64), 0)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        body, at = utf8(batch.column(1))
        raw = body.tobytes()
        sets = [shingles(raw[a:b], words) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        lists = lambda made: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *made]))
        keys = [[*keys_of(s, percent), none, none, none][:3] for s in sets]
        return {
            "id": batch.column(0), "n": [len(s) for s in sets], "same": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            **{f"keys{k}": lists([x[k][0] for x in keys]) for k in range(3)}, **{f"spare{k}": [x[k][1] for x in keys] for k in range(3)},
            "whole": lists(whole := [sketch_of(s) for s in sets]), "sketch": lists([folded(s, FOLDED // 64) for s in whole]),
        }

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, n long, same binary, keys0 array<long>, keys1 array<long>, keys2 array<long>, spare0 int, spare1 int, spare2 int, sketch array<long>, whole array<long>", mb=1)


def _may_link(percent: int) -> Column:
    """Sizes allow a link, and so does the distance of the folded sketches."""
    words = range(FOLDED // 64)
    differ = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in words), F.lit(0))
    fits = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return fits & (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))


def _side(rows: DataFrame, drawn: DataFrame, k: str, *more: Column) -> DataFrame:
    """Rows with an id joined to its size and sketch, under names that end in `k`."""
    longs = [F.col("sketch")[i].alias(f"s{i}_{k}") for i in range(FOLDED // 64)]
    return rows.join(drawn, "id").select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), *more, *longs)


def shared_keys(known: DataFrame, first: DataFrame) -> DataFrame:
    """bucket, id and center (the smallest id) of keys that several of the `first` rows (id) of a class have, after each has spared its most frequent ones."""
    # a row's band and what it may spare there are one number, and later how many have the key in front of them: three longs go through each exchange
    each = F.explode(F.array(*[F.struct((F.col(f"spare{k}").cast("long") * 4 + k).alias("tag"), F.col(f"keys{k}").alias("keys")) for k in range(3)]))
    rows = known.select("id", each.alias("x")).select("id", "x.tag", F.explode("x.keys").alias("bucket"))
    often = rows.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("often > 1").select("id", "bucket", (F.least("often", F.lit((1 << 31) - 1)) * (1 << 32) + F.col("tag")).alias("tag"))
    own = Window.partitionBy("id", F.col("tag") % 4).orderBy(F.desc(F.shiftright("tag", 32)), F.desc("bucket"))
    kept = often.join(first, "id", "left_semi").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") > F.shiftright(F.col("tag") % (1 << 32), 2)).select("bucket", "id")
    same = Window.partitionBy("bucket")
    return kept.select("bucket", "id", F.count(F.lit(1)).over(same).alias("members"), F.min("id").over(same).alias("center")).filter("members > 1").drop("members")


def candidates(rows: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of one bucket and different components that sizes and sketches allow to be linked."""
    left = _side(rows.filter("component <> largest"), drawn, "a", F.col("component").alias("c_a"), "bucket", "largest")
    right = _side(rows, drawn, "b", F.col("component").alias("c_b"), "bucket")
    once = (F.col("c_b") == F.col("largest")) | (F.col("a") < F.col("b"))
    found = left.join(right, "bucket").filter((F.col("c_a") != F.col("c_b")) & once & _may_link(percent))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sifted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sketches, folded to the shorter one's length, differ in no more bits than linked sets may."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        a, b, n, x, m, y = batch.columns
        keep = []
        for i, (n_a, left, n_b, right) in enumerate(zip(n.to_pylist(), x, m.to_pylist(), y, strict=True)):
            p, q = left.values.to_numpy(), right.values.to_numpy()
            longs = min(len(p), len(q))
            if int(np.bitwise_count((folded(p, longs) ^ folded(q, longs)).view(np.uint64)).sum()) <= most_different(n_a, n_b, percent):
                keep.append(i)
        return {"a": a.take(pa.array(keep, pa.int32())), "b": b.take(pa.array(keep, pa.int32()))}

    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("whole").alias("whole_a"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("whole").alias("whole_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "whole_a", "n_b", "whole_b")
    return arrow_map(joined, each, "a long, b long")


def linked_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """id, n (set size), component (the smallest id reachable over links) and class (the smallest id with the same set), one row for each row of `df`."""
    raw = id_and_text(df, id_col, text_col)
    signed = stored(signatures(raw, "id", "text", words, percent), "parity")
    known = signed.filter("same IS NOT NULL AND id IS NOT NULL")
    classes = stored(known.groupBy("same").agg(F.min("id").alias("id")), "classes")
    drawn = known.select("id", "n", "sketch")
    member = stored(shared_keys(known, classes.select("id")), "members")
    met = member.filter("id <> center").select(F.col("center").alias("a"), "id").distinct()
    stars = _side(met.withColumnRenamed("a", "other"), drawn, "b", "other").withColumnRenamed("other", "id")
    own = [c for c in stars.columns if c != "id"]
    stars = stored(_side(stars, drawn, "a", *own).filter(_may_link(percent)).select("a", "b"), "pairs")

    def confirm(found: DataFrame) -> DataFrame:
        pairs = stored(sifted(found, known.select("id", "n", "whole"), percent), "sifted")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        return stored(_confirmed(pairs, raw.join(ids, "id", "left_semi"), words, percent), "links")

    first = confirm(stars)
    label = components(first)
    place = lambda rows: rows.join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    rows = stored(still_open(place(member.select("bucket", "id")), HARD), "open")
    pairs = candidates(rows.filter("NOT hard"), drawn, percent)
    hard = stored(rows.filter("hard").select("id").distinct(), "hard")
    if not hard.isEmpty():
        rare = stored(still_open(place(rare_shingles(raw.join(hard, "id", "left_semi"), words, percent)), HARD), "rare")
        pairs = pairs.union(candidates(rare, drawn, percent)).distinct()
    second = confirm(stored(pairs.join(stars, ["a", "b"], "left_anti"), "pairs"))
    if not second.isEmpty():
        label = components(first.union(second))
    by_class = classes.select("same", F.col("id").alias("class")).join(label.withColumnRenamed("id", "class"), "class", "left")
    out = signed.select("id", "n", "same").join(by_class, "same", "left")
    of_own = lambda *c: F.when(F.col("id").isNotNull(), F.coalesce(*c, "id"))  # noqa: E731  a row without id is in no group
    return out.select("id", "n", of_own("component", "class").alias("component"), of_own("class").alias("class"))


def op13_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of linked_groups over all documents."""
    return linked_groups(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))

"""Near-duplicate detection by min-max hashing.

A document's set holds 64-bit hashes of its distinct word shingles. Under each random
permutation both the least and the greatest element are kept, so a signature costs half the
hash evaluations; each of the two agrees between sets with the probability of their
similarity. Bands of signature values put likely pairs into one bucket. With the default
bands a pair at the threshold shares no bucket with a probability of 6e-7.

No bucket is expanded into all pairs. Documents with equal sets are one class from the
start (linked by definition, however many). In each bucket, all classes are first compared
with one of them; linked ones form components. Only then, and only in buckets that still
hold several components, the classes outside the bucket's largest component meet that
component and each other: a pair inside one component can't change anything, and every
other pair of a bucket is looked at. Where that would be more than `HARD` comparisons in one
bucket or with one component, its documents are joined by their rarest shingles instead (in
an order by frequency among these documents, a linked pair shares one of its first
n - ceil(n * percent / 100) + 1), so families that all lie below the threshold stay cheap. Bit sketches (min-max again, with many more
permutations, drawn for these documents only) leave out pairs that are five standard
deviations below the threshold. Links are confirmed on the full sets, computed anew from
whole texts.

Null texts and texts without words have an empty set and are linked with nothing, not even
each other. A text with fewer words than a shingle has the whole sequence as its one
shingle. Rows with one id are one document here (give distinct ids; fully repeated rows are
harmless); rows with a null id stand alone. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_map, documents, id_and_text, id_key, one_each, stored, utf8

BANDS, ROWS = 36, 5
#: Bits of the sketches by which pairs of different components are sifted before their full sets are compared.
BITS = 4096
#: Comparisons that one bucket or component may ask for (seconds of one task) before its documents are joined by rare shingles instead.
HARD = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z count as a-z."""
    parts = text.lower().split()  # of bytes, both know ASCII only: x20 and x09 to x0D part words
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = _mixed(out * _MIX + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_607)
    return r.integers(0, 2**64, count, np.uint64) | np.uint64(1), r.integers(0, 2**64, count, np.uint64)


def bands_of(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A hash of each band for each (non-empty) set."""
    size = np.array([len(s) for s in sets])
    at = np.cumsum(size) - size
    joined = np.concatenate(sets)
    need = -(-bands * rows // 2)
    signature = np.empty((2 * need, len(sets)), np.uint64)
    for k, (a, b) in enumerate(zip(*_permutations(need), strict=True)):
        x = joined * a
        x ^= x >> np.uint64(31)
        x += b
        x *= _MIX
        signature[2 * k] = np.minimum.reduceat(x, at)
        signature[2 * k + 1] = np.maximum.reduceat(x, at)
    out = np.tile(np.arange(bands, dtype=np.uint64)[:, None], len(sets))
    for k in range(rows):
        out = _mixed(out * _MIX + signature[k : bands * rows : rows])
    return out.T


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n (set size), same (a 128-bit digest of the set, null if empty), bands array<long>."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        body, at = utf8(batch.column(1))
        raw = body.tobytes()
        sets = [shingles(raw[a:b], words) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        full = [i for i, s in enumerate(sets) if len(s)]
        made: list[list[int]] = [[] for _ in sets]
        if full:
            for i, row in zip(full, bands_of([sets[i] for i in full], bands, rows).astype(np.int64).tolist(), strict=True):
                made[i] = row
        return {"id": batch.column(0), "n": [len(s) for s in sets], "same": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "bands": made}

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, n long, same binary, bands array<long>", mb=1)


def bits_of(sets: list[np.ndarray]) -> np.ndarray:
    """BITS bits of each (non-empty) set, packed into longs: a bit each of the least and the greatest element under each permutation."""
    at = np.cumsum([len(s) for s in sets]) - [len(s) for s in sets]
    joined = np.concatenate(sets)
    bits = np.empty((len(sets), BITS), np.uint8)
    for k, (a, b) in enumerate(zip(*_permutations(BITS // 2), strict=True)):
        x = joined * a
        x ^= x >> np.uint64(31)
        x += b
        x *= _MIX
        bits[:, 2 * k] = _mixed(np.minimum.reduceat(x, at)) & np.uint64(1)
        bits[:, 2 * k + 1] = _mixed(np.maximum.reduceat(x, at)) & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """id and BITS bits in long columns. Bits agree with probability (1 + similarity) / 2."""
    names = [f"s{k}" for k in range(BITS // 64)]

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        packed = bits_of([shingles(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()])
        return {"id": batch.column(0), **{c: pa.array(np.ascontiguousarray(packed[:, k])) for k, c in enumerate(names)}}

    return arrow_map(texts.select("id", "text"), each, ", ".join(["id long", *(f"{c} long" for c in names)]), mb=1)


def _most_different(similarity: float, deviations: float = 5.0) -> int:
    """Bits in which sets at the threshold differ at most, but for a chance of 3e-7."""
    p = (1 - similarity) / 2
    return int(BITS * p + deviations * (BITS * p * (1 - p)) ** 0.5)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text")

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        left, right = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
        known: dict[int, np.ndarray] = {}
        keep = []
        for i, (x, y, s, t) in enumerate(zip(a, b, left, right, strict=True)):
            if len(known) > 64:
                known.clear()
            if x not in known:
                known[x] = shingles(s, words)
            if y not in known:
                known[y] = shingles(t, words)
            p, q = known[x], known[y]
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= percent * (len(p) + len(q) - both):
                keep.append(i)
        return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    return arrow_map(joined, each, "a long, b long", mb=1)


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) for every id in links (a, b): least labels pass along links, then labels' labels are taken."""
    both = stored(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    total = None
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        least = stored(labels.join(near, "id").select("id", F.least("component", "other").alias("component")), "labels")
        up = least.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = stored(least.join(up, "component").select("id", F.col("further").alias("component")), "labels")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]  # falls until nothing changes
        if now == total:
            return labels
        total = now


def still_open(placed: DataFrame, most: int) -> DataFrame:
    """Rows (bucket, id, component) of buckets that hold several components, with the bucket's largest one and whether comparing takes more than `most` comparisons. Buckets are dealt once, for all three windows."""
    bucket, own = Window.partitionBy("bucket"), Window.partitionBy("bucket", "component")
    sized = placed.repartition("bucket").withColumn("size", F.count(F.lit(1)).over(own))
    whole = sized.withColumns({"most": F.max(F.struct("size", "component")).over(bucket), "members": F.count(F.lit(1)).over(bucket)})
    hard = (F.col("members") - F.col("most.size")) * F.col("members") > most
    return whole.filter("size < members").select("bucket", "id", "component", F.col("most.component").alias("largest"), hard.alias("hard"))


def rare_shingles(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """bucket (a shingle) and id: of each text the rarest n - ceil(n * percent / 100) + 1 shingles, by their frequency among these texts."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        return {"id": batch.column(0), "found": [shingles(t, words).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]}

    found = stored(arrow_map(texts.select("id", "text"), each, "id long, found array<long>", mb=1).select("id", F.size("found").alias("n"), F.explode("found").alias("bucket")).distinct(), "shingles")
    often = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")  # those of one text alone come first and lead to nobody
    alone = found.join(often, "bucket", "left").select("id", "n", "bucket", F.coalesce("often", F.lit(1)).alias("often"))
    ranked = alone.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("often", "bucket")))
    return ranked.filter((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("often") > 1)).select("bucket", "id")


def _similar_size(percent: int):
    return F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n (set size), component (the smallest id reachable over links) and class (the smallest id with the same set), one row for each row of `df`."""
    raw = id_and_text(df, id_col, text_col)
    signed = stored(signatures(raw, "id", "text", words, bands, rows), "signatures")
    classes = stored(signed.filter("same IS NOT NULL AND id IS NOT NULL").groupBy("same").agg(F.min(F.struct("id", "n", "bands")).alias("first")).select("same", "first.*"), "classes")
    buckets = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("center"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket", "center")
    member = stored(buckets.join(shared, "bucket"), "members")
    stars = member.filter("id <> center.id").select(F.col("center.id").alias("a"), F.col("id").alias("b"), F.col("center.n").alias("n_a"), F.col("n").alias("n_b"))
    stars = stored(stars.filter(_similar_size(percent)).select("a", "b").distinct(), "pairs")
    ids = stored(member.select("id").distinct(), "ids")
    texts = stored(raw.join(ids, "id", "left_semi"), "texts")
    first = stored(_confirmed(stars, texts, words, percent), "links")
    label = components(first)
    # buckets that hold several components still: what is outside the largest one meets that component, and the others outside
    placed = member.join(label, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("bucket", F.col("largest.component").alias("largest"))
    outside = stored(placed.join(largest, "bucket").filter("component <> largest"), "outside")
    whole = stored(placed.select("id", "n", "component").distinct().join(outside.select(F.col("largest").alias("component")).distinct(), "component", "left_semi"), "whole")
    needed = whole.select("id").union(outside.select("id")).distinct()
    drawn = stored(sketches(texts.join(needed, "id", "left_semi"), words), "sketches")
    names = drawn.columns[1:]
    side = lambda df, k, *more: df.join(drawn, "id").select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("component").alias(f"c_{k}"), *more, *[F.col(c).alias(f"{c}_{k}") for c in names])
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in names[1:]), F.bit_count(F.col(f"{names[0]}_a").bitwiseXOR(F.col(f"{names[0]}_b"))))
    likely = (F.col("c_a") != F.col("c_b")) & _similar_size(percent) & (differ <= _most_different(percent / 100))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    # what a component or a bucket would compare may grow with its square: beyond HARD comparisons, documents meet at rare shingles instead
    inside = whole.groupBy(F.col("component").alias("largest")).agg(F.count(F.lit(1)).alias("inside"))
    hard_at = stored(outside.groupBy("largest").agg(F.count_distinct("id").alias("outside")).join(inside, "largest").filter(F.col("outside") * F.col("inside") > HARD).select("largest"), "hard")
    hard_in = stored(outside.groupBy("bucket").agg(F.count(F.lit(1)).alias("outside")).filter(F.col("outside") * F.col("outside") > HARD).select("bucket"), "hard")
    soft = outside.join(hard_at, "largest", "left_anti").select("id", "n", "component", "largest").distinct()
    at = F.col("component").alias("at")
    with_largest = side(soft, "a", F.col("largest").alias("at")).join(side(whole.join(hard_at.withColumnRenamed("largest", "component"), "component", "left_anti"), "b", at), "at").filter(likely).select(*ordered)
    rest = outside.join(hard_in, "bucket", "left_anti")
    others = side(rest, "a", "bucket").join(side(rest, "b", "bucket"), "bucket").filter((F.col("a") < F.col("b")) & likely).select(*ordered)
    hard = [outside.join(hard_at, "largest", "left_semi").select("id"), whole.join(hard_at.withColumnRenamed("largest", "component"), "component", "left_semi").select("id"), outside.join(hard_in, "bucket", "left_semi").select("id")]
    hard = stored(hard[0].union(hard[1]).union(hard[2]).distinct(), "hard")
    if not hard.isEmpty():
        known = placed.select("id", "n", "component").distinct()
        met = stored(still_open(rare_shingles(texts.join(hard, "id", "left_semi"), words, percent).join(known, "id").select("bucket", "id", "component"), HARD), "rare").join(known.select("id", "n"), "id")
        once = (F.col("c_b") == F.col("largest")) | (F.col("a") < F.col("b"))
        rare = side(met.filter("component <> largest"), "a", "bucket", "largest").join(side(met, "b", "bucket"), "bucket").filter(once & likely).select(*ordered)
        others = others.union(rare)
    pairs = stored(with_largest.union(others).distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    second = stored(_confirmed(pairs, texts, words, percent), "links")
    if not second.isEmpty():
        label = components(first.union(second))
    by_class = classes.select("same", F.col("id").alias("class")).join(label.withColumnRenamed("id", "class"), "class", "left")
    out = signed.select("id", "n", "same").join(by_class, "same", "left")
    own = lambda *c: F.when(F.col("id").isNotNull(), F.coalesce(*c, "id"))  # noqa: E731  a row without id is in no group
    return out.select("id", "n", own("component", "class").alias("component"), own("class").alias("class"))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, percent: int = 80) -> DataFrame:
    """The rows of `df` that stay (one of each group, the smallest id), with all their columns; of rows with equal id and text, one."""
    kept = near_groups(df, id_col, text_col, words, percent).filter("id <=> component")
    key = id_key(F.col("id"))
    return one_each(df, id_key(F.col(id_col)), kept.select(*[c.alias(k) for k, c in key.items()]), [F.col(text_col)], [F.col(text_col)])


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of near_groups over all documents."""
    return near_groups(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))

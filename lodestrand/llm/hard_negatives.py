"""Hard negatives of anchors by exact inner products, through lists that clusters of anchors share.

Anchors are dealt to the nearest of some centres (spherical k-means on at most `FIT` anchors,
by hash of the id; only the work depends on them, not the results). Anchor u of a cluster with
centre c lies within an angle t of c, so u * i <= |u| * |i| * cos(max(angle(i, c) - t, 0)) for
any row i. For each cluster the rows are sorted by this bound, without |u|, once; every
member walks the list from the top, a step of rows at a time, and leaves it when the bound of
all that follow is below its last place, or below all that it may take. Bounds have a margin
for rounding; scores are exact integers.

Anchors walk twice: for their positives (the first rows of their own label), then for the
negatives of each positive (the first rows of other labels in the window of its score).

Rows are dealt into blocks by hash of the id, and clusters are bundled; a cell of one bundle
and one block is one task's work, with `ANCHORS` anchors at most and about `ROWS` rows. A
cluster of more anchors is split by hash. Cells give the first places of each anchor in
their block, and a window over an anchor's rows takes the first of those.

Rows with a null id, label or vector, or with null or non-finite entries take no part, nor
do vectors of another length than the commonest. Entries are scaled, floored and held
within 2**27, so any inner product fits a long. Rows are candidates as they come, repeated
ones too; of anchors with one id, the one with the smallest label, then vector asks, and
rows with its id are not its positives. Anchors without positives, positives below zero and
windows without rows give no row. Ties go to the smaller id. An empty table gives an empty
result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import stored
from lodestrand.llm.whitening import vectors

FIT, CENTRES = 20_000, 1024
ANCHORS, ROWS, LEAST_BLOCKS = 65_536, 100_000, 12
#: Anchors that walk together, and the steps of a walk.
TOGETHER, FIRST_STEP, LAST_STEP = 1024, 64, 1024
_MOST = 1 << 27


def integers(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """id, label and q (array of ints, floor of scale times the entry) of the rows that take part."""
    q = F.transform("c", lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(float(_MOST))), F.lit(-float(_MOST)))).cast("int"))
    return vectors(df, id_col, vector_col, label.cast("long").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL").select("id", "label", q.alias("q"))


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and vectors of length 1 (zero ones stay)."""
    size = np.linalg.norm(x, axis=1)
    return size, x / np.where(size > 0, size, 1)[:, None]


def centres_of(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means, at most `count`."""
    unit = np.unique(_units(x.astype(float))[1], axis=0)
    centre = unit[np.random.default_rng(len(unit)).permutation(len(unit))[:count]]
    for _ in range(rounds):
        own = np.argmax(unit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        size = np.linalg.norm(total, axis=1)
        centre = np.where((size > 0)[:, None], total / np.where(size > 0, size, 1)[:, None], centre)
    return centre


def shared_list(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by falling bound for any of the anchors, and these bounds (to be multiplied by an anchor's length), with a closing minus infinity."""
    _, unit = _units(anchors.astype(float))
    centre = unit.sum(axis=0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 0 else centre
    widest = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) if size > 0 else math.pi
    length, directions = _units(rows.astype(float))
    apart = np.maximum(np.arccos(np.clip(directions @ centre, -1, 1)) - widest - 1e-7, 0) if size > 0 else np.zeros(len(rows))
    bound = length * (np.cos(apart) + 1e-9)
    order = np.argsort(-bound, kind="stable")
    return order, np.append(bound[order], -np.inf)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if top < 2**53 else a @ b.T


def walk(anchor: dict, at: np.ndarray, row: dict, order: np.ndarray, bound: np.ndarray, member: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each wish (a member of `at`, the scores that it may take) the first `most` rows: wish, score and place in `row`; also how far it walked is bounded by `bound`."""
    length = np.linalg.norm(anchor["q"][at].astype(float), axis=1)
    last, full = low.copy(), np.zeros(len(low), bool)  # the least score that is still of use
    pool = tuple(np.zeros(0, np.int64) for _ in range(3))
    begin, step, going = 0, FIRST_STEP, low <= high
    while begin < len(order) and going.any():
        some = np.unique(member[going])  # members that still walk
        place = np.full(len(at), -1)
        place[some] = np.arange(len(some))
        part = order[begin : begin + step]
        wish = np.flatnonzero(going)
        score = products(anchor["q"][at[some]], row["q"][part])[place[member[wish]]]
        equal = anchor["label"][at[member[wish]]][:, None] == row["label"][part]
        fits = (equal & (anchor["id"][at[member[wish]]][:, None] != row["id"][part])) if same else ~equal
        w, r = np.nonzero(fits & (score >= last[wish][:, None]) & (score <= high[wish][:, None]))
        found = [np.concatenate(x) for x in zip(pool, (wish[w], score[w, r], part[r]), strict=True)]
        sort = np.lexsort((row["id"][found[2]], -found[1], found[0]))
        found = [x[sort] for x in found]
        first = np.searchsorted(found[0], found[0])
        rank = np.arange(len(sort)) - first
        pool = tuple(x[rank < most] for x in found)
        ends = rank == most - 1
        full[found[0][ends]] = True
        last[found[0][ends]] = found[1][ends]
        begin += len(part)
        reach = length[member] * bound[begin] if begin < len(order) else np.full(len(low), -np.inf)
        going &= np.where(full, reach >= last, reach >= low)
        step = min(2 * step, LAST_STEP)
    return pool


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    q = table.column("q").combine_chunks()
    q = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)
    return {"q": q, **{c: table.column(c).to_numpy() for c in ("id", "label", *(["part"] if "part" in table.column_names else []))}}


def _tiles(anchor: dict):
    """Members of each cluster, at most TOGETHER at a time, with all members of the cluster."""
    for part in np.unique(anchor["part"]):
        whole = np.flatnonzero(anchor["part"] == part)
        yield whole, [whole[k : k + TOGETHER] for k in range(0, len(whole), TOGETHER)]


def positives_of(left: pa.Table, right: pa.Table, most: int) -> pa.Table:
    """anchor, id and score: the first rows of each anchor's own label in a cell."""
    made = []
    if left.num_rows and right.num_rows:
        anchor, row = _arrays(left), _arrays(right)
        for whole, tiles in _tiles(anchor):
            order, bound = shared_list(anchor["q"][whole], row["q"])
            for at in tiles:
                n = len(at)
                w, score, r = walk(anchor, at, row, order, bound, np.arange(n), np.full(n, -(2**62)), np.full(n, 2**62), True, most)
                made.append((anchor["id"][at[w]], row["id"][r], score))
    return pa.table({k: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in made)]) for i, k in enumerate(("anchor", "id", "score"))})


def negatives_of(left: pa.Table, right: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """anchor, place (of its positive), id and score: the first rows of other labels in each positive's window in a cell."""
    made = []
    if left.num_rows and right.num_rows:
        anchor, row = _arrays(left), _arrays(right)
        scores = left.column("scores").combine_chunks()
        sizes = np.diff(scores.offsets.to_numpy())
        begins, flat = np.cumsum(sizes) - sizes, scores.flatten().to_numpy()
        for whole, tiles in _tiles(anchor):
            order, bound = shared_list(anchor["q"][whole], row["q"])
            for at in tiles:
                member = np.repeat(np.arange(len(at)), sizes[at])
                place = np.arange(len(member)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
                score = flat[begins[at][member] + place]
                w, s, r = walk(anchor, at, row, order, bound, member, -(-low * score // 100), high * score // 100, False, most)
                made.append((anchor["id"][at[member[w]]], place[w], row["id"][r], s))
    return pa.table({k: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in made)]) for i, k in enumerate(("anchor", "place", "id", "score"))})


def clustered(anchors: DataFrame, most: int = ANCHORS) -> DataFrame:
    """Anchors with `part` (cluster, split where it is large) and `bundle` (of at most `most` anchors, but for uneven hashes)."""
    count = anchors.count()
    picked = anchors.orderBy(F.xxhash64("id"), "id").limit(FIT).select("q").toArrow().column("q").combine_chunks()
    centre = centres_of(picked.flatten().to_numpy(zero_copy_only=False).reshape(len(picked), -1), min(CENTRES, math.ceil(count**0.5))) if count else np.zeros((0, 0))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own = np.argmax(_units(q.astype(float))[1] @ centre.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=["id", "label", "q", "cluster"])

    dealt = stored(anchors.select("id", "label", "q").mapInArrow(run, "id long, label long, q array<int>, cluster int"), "anchors")
    plan, used = [], 0
    bundle = 0
    for cluster, size in sorted((r["cluster"], r["count"]) for r in dealt.groupBy("cluster").count().collect()):  # at most CENTRES rows
        for part in range(-(-size // most)):
            own = -(-size // -(-size // most))
            if used and used + own > most:
                bundle, used = bundle + 1, 0
            used += own
            plan.append((cluster, part, -(-size // most), len(plan), bundle))
    parts = anchors.sparkSession.createDataFrame(plan, "cluster int, slice int, slices int, part int, bundle int")
    sliced = dealt.join(F.broadcast(parts.groupBy("cluster").agg(F.first("slices").alias("slices"))), "cluster").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    return stored(sliced.join(F.broadcast(parts.select("cluster", "slice", "part", "bundle")), ["cluster", "slice"]).select("id", "label", "q", "part", "bundle"), "bundles")


def hard_negatives(df: DataFrame, asks: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for anchors (rows where `asks` holds) and each of their positives."""
    spark = df.sparkSession
    kept = df.withColumn("_asks", F.coalesce(asks, F.lit(False)))
    rows = stored(integers(kept, id_col, vector_col, label, scale), "integers")
    # anchors are told by id, so that `asks` may name any column
    chosen = integers(kept.filter("_asks"), id_col, vector_col, label, scale)
    width = rows.select(F.size("q").alias("n")).first()
    anchors = stored(chosen.filter(F.size("q") == (width[0] if width else 0)).groupBy("id").agg(F.min(F.struct("label", "q")).alias("one")).select("id", "one.label", "one.q"), "chosen")
    dealt = clustered(anchors)
    bundles = [r[0] for r in dealt.select("bundle").distinct().collect()]
    blocks = max(LEAST_BLOCKS, -(-rows.count() // ROWS))
    key = ["bundle", "block"]
    every = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int")).withColumn("bundle", F.explode(F.array(*map(F.lit, bundles)).cast("array<int>")))
    spread = lambda asking: asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = lambda asking, each, schema: spread(asking).groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(each, schema)
    near = cells(dealt, lambda left, right: positives_of(left, right, positives), "anchor long, id long, score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = near.withColumn("place", (F.row_number().over(first) - 1).cast("long")).filter(F.col("place") < positives)
    best = stored(best.filter("score >= 0"), "positives")
    wishes = best.groupBy(F.col("anchor").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))  # `positives` of them at most
    far = cells(dealt.join(wishes, "id"), lambda left, right: negatives_of(left, right, negatives, low, high), "anchor long, place long, id long, score long")
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= negatives)
    named = best.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = ranked.join(named, ["anchor", "place"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of hard_negatives: rows whose id 100 divides ask, and where 7 divides it the label moves on by one."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df, F.col("vec_id") % 100 == 0, label)

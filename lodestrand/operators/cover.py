"""Choosing few candidates that cover all elements, quadratic binary forms, and risk features."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.sources.scratch import Grown, cut


#: Pairs, and candidates, that one task settles at a time.
BATCH, MOST = 5_000_000, 100_000


def greedy_cover(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """(step, candidate, cost, gained): the cheapest candidate by newly covered element, ties by name, until all is covered.

    pairs: (candidate, element); costs: (candidate, cost). A round takes the best candidates that have BATCH pairs between them
    and picks among them, in one task, as long as a pick comes before the best candidate that was left out: what a candidate
    gains can only fall, so none of those is picked earlier, and picks come in the order of cost by gain, then name. Picks are
    appended to a table; one row, the best that was left out, reaches the driver. An element that no candidate with a cost
    covers is an error.
    """
    spark = pairs.sparkSession
    usable = pairs.join(costs.filter("cost IS NOT NULL"), "candidate", "left_semi").select(F.col("element").alias("_usable")).distinct()
    if (lost := pairs.join(usable, F.col("element").eqNullSafe(F.col("_usable")), "left_anti").first()) is not None:
        raise ValueError(f"no candidate with a cost covers {lost['element']!r}")
    given = cut(pairs.join(costs, "candidate").select("candidate", "cost", "element").distinct(), "cover")
    names = cut(numbered(given.select("candidate", "cost").distinct(), ["candidate", "cost"], "who"), "who")
    things = cut(numbered(given.select("element").distinct(), ["element"], "what"), "what").withColumnRenamed("element", "_element")
    own = names.select(F.col("candidate").alias("_candidate"), F.col("cost").alias("_cost"), "who")
    coded = given.join(things, F.col("element").eqNullSafe(F.col("_element"))).join(own, (F.col("candidate") == F.col("_candidate")) & F.col("cost").eqNullSafe(F.col("_cost")))
    left = cut(coded.select("who", "what"), "left")
    price = names.select("who", F.coalesce(F.col("cost").cast("double"), F.lit(float("-inf"))).alias("price"))
    picks = Grown(spark, T.StructType.fromDDL("who long, by_gain double, gained long"), "picks")
    covered = Grown(spark, T.StructType.fromDDL("what long"), "covered")
    picks.add(spark.createDataFrame([], picks.schema))
    size = None
    while True:
        gains = cut(left.groupBy("who").agg(F.count(F.lit(1)).alias("gained")).join(price, "who").withColumn("by_gain", F.col("price") / F.col("gained")), "gains")
        total = gains.agg(F.sum("gained")).first()[0]  # one number
        if not total:
            break
        if size is not None and total * 2 <= size:
            left, size = cut(left, "left"), total
        size = size or total
        ranked = gains.orderBy("by_gain", "who").limit(MOST).withColumn("_sum", F.sum("gained").over(W.orderBy("by_gain", "who").rowsBetween(W.unboundedPreceding, 0)))
        chosen = cut(ranked.filter((F.col("_sum") <= BATCH) | (F.col("_sum") == F.col("gained"))).select("who", "price"), "chosen")
        out = gains.join(chosen.select("who"), "who", "left_anti").agg(F.min(F.struct("by_gain", "who")).alias("m")).select("m.*").first()
        best_out = (float("inf") if out["by_gain"] is None else out["by_gain"], -1 if out["who"] is None else out["who"])
        won = picks.add(left.join(chosen, "who").repartition(1).mapInArrow(_settled(*best_out), picks.schema))
        new = covered.add(left.join(won.select("who"), "who", "left_semi").select("what").distinct())
        left = left.join(new, "what", "left_anti")
    found = numbered(picks.read().join(names, "who"), ["by_gain", "who"], "step")
    return found.select(F.col("step").cast("int").alias("step"), "candidate", F.col("cost").cast("long").alias("cost"), "gained")


def _settled(by_gain: float, who: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Picks (who, by_gain, gained) among all (who, what, price) that a task gets, while they come before the one that is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in ("who", "what", "price")] for b in batches]
        if not parts:
            return
        owner, thing, price = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        names, begin, sizes = np.unique(owner[order], return_index=True, return_counts=True)
        thing, price = np.unique(thing[order], return_inverse=True)[1], price[order][begin]
        open_ = np.ones(len(thing), bool)
        queue = [(float(price[k]) / int(sizes[k]), int(names[k]), k, int(sizes[k])) for k in range(len(names))]
        heapq.heapify(queue)
        made: list[tuple[int, float, int]] = []
        while queue and queue[0][:2] < (by_gain, who):
            key, name, k, gained = heapq.heappop(queue)
            own = thing[begin[k]:begin[k] + sizes[k]]
            now = int(open_[own].sum())
            if now == gained:
                open_[own] = False
                made.append((name, key, gained))
            elif now:
                heapq.heappush(queue, (float(price[k]) / now, name, k, now))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.int64())], names=["who", "by_gain", "gained"])

    return run


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds numbers from 1 in an order: within ranges, by how many rows stand in the ranges before; no task gets all rows."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(before, "_part").withColumn(name, F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")).drop("_part", "_before")


#: Longs of 64 elements that stand side by side in a row, and candidates that one task compares with as many others at a time.
WORDS, TILE = 16, 2048


def bitsets(once: DataFrame) -> tuple[DataFrame, int]:
    """(candidate, block, w0, w1, ...): 64 * WORDS elements to a block, those of many candidates first, as the bits of longs; and the number of longs. once: distinct (candidate, element) without nulls.

    `members` and `links` say how many candidates a block has and the sum of squares of its elements' candidates, `top` the number (from 0) of a row's last and so rarest element.
    """
    often = cut(numbered(once.groupBy("element").agg(F.count(F.lit(1)).alias("often")), [F.desc("often"), "element"], "number").select("element", "often", (F.col("number") - 1).alias("number")), "often")
    width = min(WORDS, ((often.agg(F.max("number")).first()[0] or 0) // 64) + 1)  # one number
    at = often.withColumn("block", F.floor(F.col("number") / (64 * WORDS)))
    word, bit = F.floor(F.col("number") / 64) % WORDS, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))
    longs = [F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(width)]
    own = cut(once.join(at, "element").groupBy("candidate", "block").agg(F.max("number").alias("top"), *longs), "bits")
    links = at.groupBy("block").agg(F.sum(F.col("often") * F.col("often")).alias("links"))
    return cut(own.join(own.groupBy("block").agg(F.count(F.lit(1)).alias("members")).join(links, "block"), "block"), "bits"), width


def tiled(a: DataFrame, b: DataFrame, key: list[str], how: str, condition: Column) -> DataFrame:
    """A join of all pairs with one key that are in tiles `ta` and `tb`: each pair of tiles is a group of its own, so that neither one task nor the driver gets all of a key."""
    spark = a.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    on = [*key, "ta", "tb"]
    return a.repartition(spread, *on).join(b.repartition(spread, *[f"_{k}" for k in on]).hint("merge"), (F.expr(" AND ".join(f"{k} = _{k}" for k in on))) & condition, how)


def in_common(once: DataFrame) -> DataFrame:
    """(a, b, common): the number of elements that two candidates a < b share, where there are any. once: distinct (candidate, element) without nulls.

    A block's candidates are compared by their bits, tile by tile, where that is less work than meeting at each of its elements; blocks
    of rare elements, in which most candidates have nothing in common, meet at elements. Counts are added up by pair only where there is more than one block.
    """
    bits, width = bitsets(once)
    order = cut(numbered(once.select("candidate").distinct(), ["candidate"], "place"), "order")
    blocks = bits.groupBy("block", "members").agg(F.first("links").alias("links")).withColumn("dense", F.col("members") * F.col("members") <= F.col("links"))
    counted = blocks.agg(F.count_if("dense").alias("dense"), F.count_if(~F.col("dense")).alias("sparse")).crossJoin(order.agg(F.count(F.lit(1)).alias("n"))).first()  # three counts
    n, dense, sparse = counted["n"], counted["dense"], counted["sparse"]
    is_dense, words = F.col("members") * F.col("members") <= F.col("links"), [f"w{k}" for k in range(width)]
    tiles = F.ceil(F.col("members") / TILE)
    rows = bits.filter(is_dense).join(order, "candidate").withColumn("tiles", tiles).withColumn("tile", F.least(F.floor((F.col("place") - 1) * F.col("tiles") / max(n, 1)), F.col("tiles") - 1))
    a = rows.select(F.col("candidate").alias("a"), "block", F.col("place").alias("p"), *words, F.col("tile").alias("ta"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tb"))
    b = rows.select(F.col("candidate").alias("b"), F.col("block").alias("_block"), F.col("place").alias("q"), *[F.col(w).alias(f"_{w}") for w in words], F.col("tile").alias("_tb"), F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("_ta"))
    shared = sum((F.bit_count(F.col(w).bitwiseAND(F.col(f"_{w}"))) for w in words), F.lit(0))
    near = tiled(a, b, ["block"], "inner", F.col("p") < F.col("q")).select("a", "b", shared.cast("long").alias("common")).filter("common > 0")
    if dense <= 1 and not sparse:
        return near
    each = bits.filter(~is_dense).select("candidate", "block", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(w).alias("w")) for k, w in enumerate(words)]))).filter("w <> 0")
    each = each.select("candidate", "block", "k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("w"), i) == 1)).alias("i"))
    c, d = each.withColumnRenamed("candidate", "a"), each.withColumnRenamed("candidate", "b")
    far = c.join(d, ["block", "k", "i"]).filter("a < b").select("a", "b", F.lit(1).cast("long").alias("common"))
    return near.unionByName(far).groupBy("a", "b").agg(F.sum("common").alias("common"))


def dominated(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """Candidates that another one covers at no higher cost (equal ones: the later name).

    Whoever covers a candidate has its rarest element too, so only those that have are compared, element by element and tile
    by tile, by the bits of that element's block. Pairs are written only where there are more blocks, which are looked at
    after. A candidate with a null element is covered by none.
    """
    pairs = cut(pairs.select("candidate", "element"), "pairs")
    bits, width = bitsets(known_pairs(pairs))
    words = [f"w{k}" for k in range(width)]
    known = cut(pairs.groupBy("candidate").agg(F.count(F.lit(1)).alias("size"), F.bool_or(F.col("element").isNull()).alias("open")).join(costs, "candidate").select("candidate", "size", "open", "cost"), "known")
    last = bits.groupBy("candidate").agg(F.max_by(F.struct("block", "top", *words), "block").alias("x")).select("candidate", "x.*")
    own = last.join(known.filter("NOT open"), "candidate").select(F.col("candidate").alias("a"), "block", F.col("top").alias("rarest"), *words, F.col("size").alias("size_a"), F.col("cost").alias("cost_a"))
    asked = cut(own.groupBy("rarest", "block").agg(F.count(F.lit(1)).alias("n_a")), "asked")
    word = F.element_at(F.array(*[F.col(w) for w in words]), (F.floor(F.col("rarest") / 64) % WORDS + 1).cast("int"))
    has = bits.join(asked.drop("n_a"), "block").filter(F.call_function("getbit", word, (F.col("rarest") % 64).cast("int")) == 1)
    has = cut(has.join(known, "candidate").select(F.col("candidate").alias("b"), "rarest", *words, F.col("size").alias("size_b"), F.col("cost").alias("cost_b")), "has")
    many = cut(asked.join(has.groupBy("rarest").agg(F.count(F.lit(1)).alias("n_b")), "rarest").select("rarest", F.ceil(F.col("n_a") / TILE).alias("tiles_a"), F.ceil(F.col("n_b") / TILE).alias("tiles_b")), "tiles")
    from_ = lambda c, tiles: F.pmod(F.xxhash64(c), F.col(tiles))
    all_of = lambda tiles: F.explode(F.sequence(F.lit(0).cast("long"), F.col(tiles) - 1))
    x = own.join(many, "rarest").select("a", "rarest", *words, "size_a", "cost_a", from_("a", "tiles_a").alias("ta"), all_of("tiles_b").alias("tb"))
    y = has.join(many, "rarest").select("b", F.col("rarest").alias("_rarest"), *[F.col(w).alias(f"_{w}") for w in words], "size_b", "cost_b", from_("b", "tiles_b").alias("_tb"), all_of("tiles_a").alias("_ta"))
    holds = F.expr("size_b >= size_a AND cost_b <= cost_a AND (size_b > size_a OR cost_b < cost_a OR b < a)")
    for w in words:
        holds = holds & (F.col(w).bitwiseAND(F.bitwise_not(F.col(f"_{w}"))) == 0)
    if bits.filter("block > 0").isEmpty():
        return tiled(x, y, ["rarest"], "left_semi", holds).select(F.col("a").alias("candidate")).distinct()
    may = cut(tiled(x, y, ["rarest"], "inner", holds).select("a", "b").distinct(), "may")
    left = may.join(bits.select(F.col("candidate").alias("a"), "block", *words), "a").join(bits.select(F.col("candidate").alias("b"), "block", *[F.col(w).alias(f"_{w}") for w in words]), ["b", "block"], "left")
    misses = F.lit(False)
    for w in words:
        misses = misses | (F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))) != 0)
    return left.groupBy("a", "b").agg(F.bool_or(misses).alias("misses")).filter("NOT misses").select(F.col("a").alias("candidate")).distinct()


def known_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (candidate, element) without nulls, written once."""
    return cut(pairs.filter("candidate IS NOT NULL AND element IS NOT NULL").select("candidate", "element").distinct(), "pairs")


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores, ties by name."""
    return scores.orderBy(F.desc("score"), "name").limit(k)


#: Variables whose assignments are all listed, at most.
MOST_VARIABLES = 24


def qubo_energies(spark: SparkSession, linear: DataFrame, quadratic: DataFrame, n: int) -> DataFrame:
    """(assignment, energy) of all 2**n assignments; bit 0 is the most significant. linear: (i, v); quadratic: (i, j, v). The terms, n * (n + 1) / 2 at most, become one expression."""
    if n > MOST_VARIABLES:
        raise ValueError(f"{n} variables have too many assignments to list; {MOST_VARIABLES} at most")
    on = lambda k: F.call_function("shiftright", F.col("assignment"), F.lit(n - 1 - k)).bitwiseAND(F.lit(1))
    one = linear.groupBy("i").agg(F.sum("v").alias("v")).limit(n + 1).collect()
    two = quadratic.groupBy("i", "j").agg(F.sum("v").alias("v")).limit(n * n + 1).collect()
    terms = [on(r["i"]) * F.lit(r["v"]) for r in one] + [on(r["i"]) * on(r["j"]) * F.lit(r["v"]) for r in two]
    return spark.range(1 << n).select(F.col("id").alias("assignment"), sum(terms, F.lit(0).cast("long")).alias("energy"))


def qubo_minimum(spark: SparkSession, linear: DataFrame, quadratic: DataFrame, n: int) -> DataFrame:
    """The one row (assignment, energy) of least energy, of equal ones the smallest assignment."""
    return qubo_energies(spark, linear, quadratic, n).agg(F.min(F.struct("energy", "assignment")).alias("m")).select("m.assignment", "m.energy")


def top_qubo(scores: DataFrame, k: int, penalty: int) -> DataFrame:
    """(i, j, v), i = j being linear, of choosing exactly k of (i, score) with the highest sum: -score, and penalty * (sum - k)^2 without its constant."""
    own = scores.select("i", F.col("i").alias("j"), (F.lit(penalty * (1 - 2 * k)) - F.col("score")).alias("v"))
    other = scores.select(F.col("i").alias("j"))
    return own.unionByName(scores.select("i").join(other, F.col("i") < F.col("j")).select("i", "j", F.lit(2 * penalty).cast("long").alias("v")))


def ising(linear: DataFrame, quadratic: DataFrame) -> DataFrame:
    """(term, i, j, v) after x = (1 - s) / 2, in quarters: fields, couplings and the offset as whole numbers."""
    h = linear.select("i", (F.col("v") * -2).alias("v")).union(quadratic.select("i", -F.col("v"))).union(quadratic.select("j", -F.col("v")))
    fields = h.groupBy("i").agg(F.sum("v").alias("v")).select(F.lit("field").alias("term"), "i", F.lit(None).cast("int").alias("j"), "v")
    couplings = quadratic.select(F.lit("coupling").alias("term"), "i", "j", "v")
    offset = linear.select((F.col("v") * 2).alias("v")).union(quadratic.select("v")).agg(F.sum("v").alias("v")).select(F.lit("offset").alias("term"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), "v")
    return fields.unionByName(couplings).unionByName(offset)


def cover_qubo(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """(i, j, v) of exact-cover penalties: cost on the diagonal, and for each element penalty * (1 - sum)^2 without its constant; i = j is linear."""
    penalty = F.broadcast(costs.agg((F.sum("cost") + 1).alias("p")))  # one row
    once = known_pairs(pairs)
    both = in_common(once).crossJoin(penalty).select(F.col("a").alias("i"), F.col("b").alias("j"), (2 * F.col("p") * F.col("common")).alias("v"))
    size = once.groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).crossJoin(penalty).select("candidate", (-F.col("p") * F.col("n")).alias("v"))
    own = costs.select("candidate", F.col("cost").cast("long").alias("v")).unionByName(size).groupBy("candidate").agg(F.sum("v").alias("v"))
    return both.unionByName(own.select(F.col("candidate").alias("i"), F.col("candidate").alias("j"), "v")).filter("v <> 0")


def slack_bits(pairs: DataFrame) -> DataFrame:
    """(element, bit, weight): binary slack for `covered at least once`, of weights 1, 2, 4, ... and a last one that fills up to the number of an element's candidates less 1."""
    room = pairs.groupBy("element").agg((F.count(F.lit(1)) - 1).alias("room")).filter("room > 0").withColumn("bits", F.length(F.bin("room")))
    return room.select("element", "room", "bits", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bit")).select(
        "element", "bit", F.when(F.col("bit") < F.col("bits") - 1, F.expr("shiftleft(1L, bit)")).otherwise(F.col("room") - F.expr("shiftleft(1L, bits - 1)") + 1).alias("weight"))


def cover_slack_qubo(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """(a, b, v) of a cover in which elements may be covered more than once: cost on the diagonal, and for each element penalty * (candidates - slack - 1)^2 without its constant; a = b is linear. Variables are candidates and `slack/element/bit`."""
    once = known_pairs(pairs)
    slack = slack_bits(once).select("element", F.concat_ws("/", F.lit("slack"), "element", F.col("bit").cast("string")).alias("y"), (-F.col("weight")).alias("u"))
    penalty = F.broadcast(costs.agg((F.sum("cost") + 1).alias("p")))  # one row
    chosen = in_common(once).select("a", "b", F.col("common").alias("w"))
    mixed = once.join(slack, "element").select(F.least("candidate", "y").alias("a"), F.greatest("candidate", "y").alias("b"), F.col("u").alias("w"))  # a slack has one element
    other = slack.select("element", F.col("y").alias("x"), F.col("u").alias("w"))
    spare = other.join(slack, "element").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), (F.col("w") * F.col("u")).alias("w"))
    both = chosen.unionByName(mixed).unionByName(spare).crossJoin(penalty).select("a", "b", (2 * F.col("p") * F.col("w")).alias("v"))
    alone = once.groupBy(F.col("candidate").alias("x")).agg((-F.count(F.lit(1))).alias("w")).unionByName(slack.select(F.col("y").alias("x"), (F.col("u") * F.col("u") - 2 * F.col("u")).alias("w")))
    own = alone.crossJoin(penalty).select("x", (F.col("p") * F.col("w")).alias("v")).unionByName(costs.select(F.col("candidate").alias("x"), F.col("cost").cast("long").alias("v")))
    own = own.groupBy("x").agg(F.sum("v").alias("v")).select(F.col("x").alias("a"), F.col("x").alias("b"), "v")
    return both.unionByName(own).filter("v <> 0")


def features(programs: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts from each part (key, ...) beside each program; programs without rows count 0."""
    out = programs
    for name, rows in parts.items():
        out = out.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def train_risk(rows: DataFrame, columns: list[str], label: str, seed: int = 7):
    """A gradient-boosted classifier over feature columns; (model, area under the curve on a held-out fifth)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).withColumn("label", F.col(label).cast("double"))
    train, test = ready.randomSplit([0.8, 0.2], seed)
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=seed).fit(train)
    return model, BinaryClassificationEvaluator().evaluate(model.transform(test))


def risk_score(weights: dict[str, float]) -> Column:
    """A weighted sum of feature columns."""
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))

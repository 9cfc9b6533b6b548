"""The cheapest cover, proved: reductions to a fixpoint, then branch and bound over a table of open subtrees.

A node of the search is a row: what is still to be covered, what it has cost, what was
chosen. A round takes all open nodes at their rarest element to be covered and tries each
candidate that has it, as one join; nodes that leave the same to cover are one, the cheapest.
A bound (each element costs at least its cheapest share of a candidate) prunes against the
best cover so far, which begins as the greedy one and is the one number that the driver has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.cover import dominated, greedy_cover, in_common
from lodestrand.sources.scratch import cut


def _implied(pairs: DataFrame) -> DataFrame:
    """(element): elements that are covered whenever another one is, as all of that one's candidates have them; of equal ones all but the first."""
    turned = pairs.select(F.col("element").alias("candidate"), F.col("candidate").alias("element"))
    size = pairs.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    a, b = size.select(F.col("element").alias("a"), F.col("n").alias("n_a")), size.select(F.col("element").alias("b"), F.col("n").alias("n_b"))
    both = in_common(turned).join(a, "a").join(b, "b")
    wide = F.when((F.col("common") == F.col("n_a")) & (F.col("n_b") >= F.col("n_a")), F.col("b")).when(F.col("common") == F.col("n_b"), F.col("a"))
    return both.select(wide.alias("element")).filter("element IS NOT NULL").distinct()


def reduced(pairs: DataFrame, costs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, chosen): what is left of a problem when candidates that others replace, elements that others imply, and candidates that alone have an element are settled, again and again; chosen: (candidate) of the last kind."""
    price = costs.filter("cost IS NOT NULL").select("candidate", F.col("cost").cast("long").alias("cost"))
    left = cut(pairs.join(price, "candidate", "left_semi").select("candidate", "element").distinct(), "cover")
    chosen = cut(price.select("candidate").limit(0), "chosen")
    size = left.count()
    while size:
        sole = cut(left.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("candidate")).filter("n = 1").select("candidate").distinct(), "sole")
        chosen = cut(chosen.unionByName(sole), "chosen")
        left = left.join(left.join(sole, "candidate").select("element").distinct(), "element", "left_anti").select("candidate", "element")
        left = cut(left.join(_implied(cut(left, "cover")), "element", "left_anti").select("candidate", "element"), "cover")
        left = cut(left.join(dominated(left, price), "candidate", "left_anti"), "cover")
        size, before = left.count(), size
        if size == before:
            break
    return left, chosen


def exact_cover(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """(candidate, cost): a cover of all elements of pairs (candidate, element) of least cost; costs are whole and not below zero. An element that no candidate with a cost has is an error, as in greedy_cover."""
    price = costs.filter("cost IS NOT NULL").select("candidate", F.col("cost").cast("long").alias("cost"))
    greedy = cut(greedy_cover(pairs, costs).select("candidate"), "greedy")
    left, forced = reduced(pairs, costs)
    begin = forced.join(price, "candidate").agg(F.coalesce(F.sum("cost"), F.lit(0).cast("long"))).first()[0]
    best = greedy.join(price, "candidate").agg(F.coalesce(F.sum("cost"), F.lit(0).cast("long"))).first()[0]
    sizes = left.groupBy("candidate").agg(F.count(F.lit(1)).alias("size")).join(price, "candidate")
    share = left.join(sizes, "candidate").groupBy("element").agg(F.count(F.lit(1)).alias("often"), F.min(F.col("cost") / F.col("size")).alias("share"))
    one = F.struct("often", "element", "share")
    sets = cut(left.join(share, "element").join(price, "candidate").groupBy("candidate", "cost").agg(F.array_sort(F.collect_list(one)).alias("has")), "sets")
    at = cut(left.join(sets.select("candidate", F.col("cost").alias("own"), "has"), "candidate").select("element", "candidate", "own", "has"), "sets")
    nodes = share.agg(F.array_sort(F.collect_list(one)).alias("open")).select("open", F.lit(begin).cast("long").alias("cost"), F.array().cast("array<string>").alias("chosen"))
    nodes, found = cut(nodes.withColumn("chosen", F.col("chosen").cast(f"array<{dict(pairs.dtypes)['candidate']}>")), "nodes"), None
    while True:
        done = nodes.filter(F.size("open") == 0).agg(F.min(F.struct("cost", "chosen")).alias("m")).first()["m"]
        if done is not None and (done["cost"] < best or (found is None and done["cost"] <= best)):
            best, found = done["cost"], done["chosen"]
        least = F.col("cost") + F.ceil(F.aggregate("open", F.lit(0.0), lambda s, x: s + x["share"]) - 1e-9)
        live = nodes.filter((F.size("open") > 0) & (least < best)).withColumn("element", F.col("open")[0]["element"])
        if live.isEmpty():
            break
        step = live.join(at, "element").select(F.array_except("open", "has").alias("open"), (F.col("cost") + F.col("own")).alias("cost"), F.array_append("chosen", F.col("candidate")).alias("chosen"))
        nodes = cut(step.groupBy("open").agg(F.min(F.struct("cost", "chosen")).alias("m")).select("open", "m.cost", "m.chosen"), "nodes")
    if found is None:
        return greedy.join(price, "candidate")
    picked = pairs.sparkSession.createDataFrame([(c,) for c in found], forced.schema)  # the answer itself
    return picked.unionByName(forced).join(price, "candidate")

"""Comparing two snapshots of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(base: DataFrame, head: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(key, change, before, after) by one full outer join; facts are compared null-safe, where a fact came from is no fact."""
    a = base.select(F.col(key).alias("_a"), F.struct(*facts).alias("before"))
    b = head.select(F.col(key).alias("_b"), F.struct(*facts).alias("after"))
    both = a.join(b, a["_a"] == b["_b"], "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), "before", "after").filter("change IS NOT NULL")


def anchors(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where changed entities (id, parent) enter the graph: the node itself, else its parent's node, else a stub."""
    own, up = nodes.select(F.col("id").alias("_own")), nodes.select(F.col("id").alias("_up"))
    joined = changes.join(own, changes["id"] == own["_own"], "left").join(up, changes["parent"] == up["_up"], "left")
    return joined.select(*changes.columns, F.coalesce("_own", "_up", F.concat(F.lit("removed:"), F.col("id"))).alias("anchor"))

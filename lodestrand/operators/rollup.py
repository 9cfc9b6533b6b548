"""Scorecards, headline shares and rollups of a ledger, and digests of evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import canonical


def outcome(kind: Column, verdict: Column) -> Column:
    """What a verdict was worth, given what the change really was."""
    return (F.when(verdict == "inconclusive", "inconclusive").when(kind == "refactor", F.when(verdict == "equivalent", "proven").otherwise("false-alarm"))
            .when(kind == "defect", F.when(verdict == "equivalent", "missed").otherwise("caught")).otherwise(F.when(verdict == "equivalent", "missed").otherwise("confirmed")))


def scorecard(ledger: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """Measures over all rows and by each key alone: one grouping-sets aggregation."""
    sets = [[], *[[k] for k in keys]]
    return ledger.groupingSets(sets, *keys).agg(*measures)


def share(part: Column, whole: Column) -> Column:
    """`x of y (p%)`, or - of nothing."""
    return F.when(whole == 0, "-").otherwise(F.concat(part.cast("string"), F.lit(" of "), whole.cast("string"), F.lit(" ("), F.call_function("div", part * 100, whole).cast("string"), F.lit("%)")))


def digests(df: DataFrame, key: str, columns: list[str], bits: int = 384) -> DataFrame:
    """(key, digest) of the canonical JSON of columns."""
    return df.select(key, F.sha2(canonical(*columns), bits).alias("digest"))


def verified(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status): valid, invalid, or missing. Both: (key, digest)."""
    have = actual.select(F.col(key).alias("_k"), F.col("digest").alias("_d"))
    status = F.when(F.col("_k").isNull(), "missing").when(F.col("digest") == F.col("_d"), "valid").otherwise("invalid")
    return expected.join(have, expected[key] == have["_k"], "left").select(key, status.alias("status"))


def statement(subject: Column, kind: str, predicate: Column) -> Column:
    """An attestation statement as JSON."""
    return F.to_json(F.struct(F.lit("https://in-toto.io/Statement/v1").alias("_type"), subject.alias("subject"), F.lit(kind).alias("predicateType"), predicate.alias("predicate")))

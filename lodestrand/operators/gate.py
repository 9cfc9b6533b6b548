"""Policy rules over change facts, and the gate's decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def independent_approvals(people: DataFrame) -> DataFrame:
    """(change, independent): approvers that didn't implement the change, by exact id. people: (change, role, person)."""
    approvers, makers = people.filter("role = 'approver'"), people.filter("role = 'implementer'").select("change", "person")
    left = approvers.join(makers, ["change", "person"], "left_anti").groupBy("change").agg(F.countDistinct("person").alias("independent"))
    return people.select("change").distinct().join(left, "change", "left").select("change", F.coalesce("independent", F.lit(0).cast("long")).alias("independent"))


def rule_rows(changes: DataFrame, rule: str, applies: Column, deny: Column, warn: Column | None = None) -> DataFrame:
    """(change, rule, status): fail where denied, inconclusive where warned, else pass; not-evaluated where it doesn't apply."""
    status = F.when(~applies, "not-evaluated").when(deny, "fail").when(warn if warn is not None else F.lit(False), "inconclusive").otherwise("pass")
    return changes.select("change", F.lit(rule).alias("rule"), status.alias("status"))


def equivalence_rule(facts: DataFrame) -> DataFrame:
    """Adds verdict and status to facts (tests, and of these different and errors; untested programs): a difference fails; errors, untested programs or no test at all are neither failed nor passed."""
    verdict = F.when(F.col("different") > 0, "not-equivalent").when((F.col("errors") > 0) | (F.col("untested") > 0) | (F.col("tests") == 0), "inconclusive").otherwise("equivalent")
    status = F.when(F.col("verdict") == "not-equivalent", "fail").when(F.col("verdict") == "inconclusive", "inconclusive").otherwise("pass")
    return facts.withColumn("verdict", verdict).withColumn("status", status)


def gate(statuses: DataFrame, known: tuple[str, ...] | None = None) -> DataFrame:
    """(change, ok, failed): ok unless a rule failed; warnings and rules that weren't evaluated don't block. With `known`, a rule of another name is an error."""
    if known is not None and (other := statuses.filter(~F.col("rule").isin(*known)).select("rule").first()):
        raise ValueError(f"policy rule {other[0]!r} is not known ({', '.join(sorted(known))})")
    return statuses.groupBy("change").agg((F.count_if(F.col("status") == "fail") == 0).alias("ok"), F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.col("rule")))).alias("failed"))


def crypto_denied(before: tuple[Column, Column, Column], after: tuple[Column, Column, Column]) -> Column:
    """(algorithm, bits, vulnerable) twice: a vulnerable use is denied unless it was vulnerable before with the same algorithm and key size."""
    same = before[0].eqNullSafe(after[0]) & before[1].eqNullSafe(after[1]) & F.coalesce(before[2], F.lit(False))
    return F.coalesce(after[2], F.lit(False)) & ~same


def egress(settings: DataFrame, profiles: DataFrame) -> DataFrame:
    """All settings against all profiles, as the matrix asks for, with the rules each combination breaks; Spark chooses how by their sizes."""
    broken = F.filter(F.array(
        F.when((F.col("classification") == "secret") & (F.col("backend") == "remote"), "secret data stays"),
        F.when(F.col("region") != F.col("home"), "leaves its region"),
        F.when(F.col("tier") > F.col("most"), "tier too high"),
    ), lambda x: x.isNotNull())
    return settings.crossJoin(profiles).withColumn("broken", broken)


def controls(evidence: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(framework, control, needed, present): evidence kinds that each control needs and has."""
    wanted = frameworks.select("framework", "control", F.explode("needs").alias("kind"))
    have = evidence.select("kind").distinct().withColumn("here", F.lit(1))
    return wanted.join(have, "kind", "left").groupBy("framework", "control").agg(F.count(F.lit(1)).alias("needed"), F.count("here").alias("present"))

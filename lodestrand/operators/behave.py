"""Program behaviour before and after a change: inputs, outcomes, comparison, verdict."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary_pool(fields: DataFrame, literals: DataFrame, unit: Column) -> DataFrame:
    """Candidate values by field: 0, the top, and each literal with its neighbours a unit away, kept where the field can hold them.

    fields: (field, low, top); literals: (field, literal).
    """
    near = literals.withColumn("k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select("field", (F.col("literal") + F.col("k") * unit).alias("value"))
    ends = fields.select("field", F.explode(F.array("low", F.lit(0).cast("long"), "top")).alias("value"))
    return near.unionByName(ends).join(fields, "field").filter(F.col("value").between(F.col("low"), F.col("top"))).select("field", "value").distinct()


def variants(seeds: DataFrame, pool: DataFrame) -> DataFrame:
    """One-factor-at-a-time inputs: for each seed (seed, inputs map) and each (field, value), the seed with that field changed."""
    fields = seeds.select("seed", "inputs", F.explode(F.map_keys("inputs")).alias("field"))
    changed = F.transform_values("inputs", lambda k, v: F.when(k == F.col("field"), F.col("value")).otherwise(v))
    return fields.join(pool, "field").select("seed", "field", "value", changed.alias("inputs"))


def outcomes(runs: DataFrame, conditions: dict[str, Column], key: str = "test") -> DataFrame:
    """(key, covers): which way each condition went in each run."""
    ways = [F.concat(F.lit(name + ":"), F.when(c, "T").otherwise("F")) for name, c in conditions.items()]
    return runs.select(key, F.array(*ways).alias("covers"))


def first_of_each_path(runs: DataFrame, path: str, order: str) -> DataFrame:
    """(order, path) of the first run of each outcome path: the tests that a search keeps."""
    return runs.groupBy(path).agg(F.min(order).alias(order))


def text_candidates(fields: DataFrame, literals: DataFrame) -> DataFrame:
    """(field, value) for text fields (field, length): blanks, all Z, and each literal (field, literal), cut or filled to the length."""
    fixed = fields.select("field", "length", F.explode(F.array(F.lit(""), F.rpad(F.lit("Z"), F.col("length"), F.lit("Z")))).alias("value"))
    given = fields.join(literals, "field").select("field", "length", F.col("literal").alias("value"))
    return fixed.unionByName(given).select("field", F.rpad(F.col("value"), F.col("length"), F.lit(" ")).alias("value")).distinct()


def touched_lines(base: Column, head: Column) -> Column:
    """The line numbers of `base` that an edit to `head` touches: replaced and deleted lines, and both neighbours of an insertion. A text at a time, by the standard library's sequence matcher, whose choice of matches no expression gives. Null texts are empty."""
    @F.pandas_udf("array<int>")
    def touched(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            old, new, found = x.splitlines(), y.splitlines(), set()
            for kind, i, j, _, _ in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
                if kind == "insert":
                    found |= {n for n in (i, i + 1) if 0 < n <= len(old)}
                elif kind != "equal":
                    found |= set(range(i + 1, j + 1))
            out.append(sorted(found))
        return pd.Series(out)

    return touched(base, head)


def on_points(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """(test, field, value) where a run's input sits exactly on a literal that a condition it reached compares the field with. runs: (test, inputs map, covers array of outcomes `condition:way`); bounds: (condition, field, literal)."""
    put = runs.select("test", "covers", F.explode("inputs").alias("field", "value"))
    met = put.join(bounds, (put["field"] == bounds["field"]) & (put["value"] == bounds["literal"])).drop(bounds["field"])
    return met.filter(F.exists("covers", lambda c: F.split_part(c, F.lit(":"), F.lit(1)) == F.col("condition"))).select("test", "field", "value").distinct()


def in_set(rows: DataFrame, entity: str, changed: DataFrame) -> DataFrame:
    """The rows whose entity's owner (what stands between its kind and the first `.` or `#`) owns one of the changed entities (id)."""
    owner = lambda c: F.regexp_extract(c, r"^[^:]*:([^.#]*)", 1)
    return rows.join(changed.select(owner(F.col("id")).alias("_owner")).distinct(), owner(F.col(entity)) == F.col("_owner"), "left_semi")


def chosen_meet_all(needs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(need) that no chosen test (test) meets; needs: (test, need)."""
    met = needs.join(chosen.select("test"), "test", "left_semi").select("need")
    return needs.select("need").distinct().join(met.distinct(), "need", "left_anti")


def compare(base: DataFrame, head: DataFrame, key: str, output: str = "output", rc: str = "rc") -> DataFrame:
    """(key, result): same, different, or error where a side has no run; outputs and return codes are compared null-safe."""
    a, b = base.select(F.col(key).alias("_a"), F.struct(output, rc).alias("x")), head.select(F.col(key).alias("_b"), F.struct(output, rc).alias("y"))
    result = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "error").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("different")
    return a.join(b, a["_a"] == b["_b"], "full").select(F.coalesce("_a", "_b").alias(key), result.alias("result"))


def verdict(results: DataFrame, by: list[str], owners: DataFrame | None = None) -> DataFrame:
    """Counts and verdict by group: a difference decides; then errors, untested or no tests are inconclusive. owners: all groups, so that those without any test are there too."""
    n = lambda r: F.count_if(F.col("result") == r)
    counts = results.groupBy(*by).agg(F.count(F.lit(1)).alias("tests"), n("different").alias("different"), n("error").alias("errors"), n("untested").alias("untested"))
    if owners is not None:
        counts = owners.select(*by).distinct().join(counts, by, "left").na.fill(0, ["tests", "different", "errors", "untested"])
    return counts.withColumn("verdict", F.when(F.col("different") > 0, "not-equivalent").when((F.col("errors") > 0) | (F.col("untested") > 0) | (F.col("tests") == 0), "inconclusive").otherwise("equivalent"))


def unstable(first: DataFrame, second: DataFrame, key: list[str], value: str, owner: str) -> DataFrame:
    """(owner, readings, moved) of owners for which two readings of one key differ."""
    again = second.select(*key, F.col(value).alias("_again"))
    joined = first.join(again, key)
    moved = ~F.col(value).eqNullSafe(F.col("_again"))
    return joined.groupBy(owner).agg(F.count(F.lit(1)).alias("readings"), F.count_if(moved).alias("moved")).filter("moved > 0")


def obligations(tests: DataFrame, changed: DataFrame) -> DataFrame:
    """(test, need): outcomes of changed conditions and changed lines that a test reaches. tests: (test, covers, lines); changed: (kind, item)."""
    reach = tests.select("test", F.explode(F.concat(F.transform("covers", lambda c: F.concat(F.lit("outcome:"), c)), F.transform("lines", lambda n: F.concat(F.lit("line:"), n.cast("string"))))).alias("need"))
    wanted = changed.select(F.concat_ws(":", "kind", "item").alias("need"))
    return reach.join(wanted, "need", "left_semi").distinct()


def mutation_share(outputs: DataFrame, bug: str, old: str, new: str) -> DataFrame:
    """(bug, caught): whether any input tells a bug's version from the old one."""
    return outputs.groupBy(bug).agg(F.bool_or(~F.col(old).eqNullSafe(F.col(new))).alias("caught"))

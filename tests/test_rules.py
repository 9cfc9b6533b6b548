"""Decision grids and traps."""

import itertools

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import bank, behave, diff, gate, graph
from lodestrand.sources import lines as L


def test_verdict_grid(spark):
    for different, error, untested in itertools.product((0, 1), repeat=3):
        rows = [("p", "same")] + [("p", n) for n, k in (("different", different), ("error", error), ("untested", untested)) if k]
        got = behave.verdict(spark.createDataFrame(rows, "program string, result string"), ["program"]).first()["verdict"]
        assert got == ("not-equivalent" if different else "inconclusive" if error or untested else "equivalent")


def test_gate_ignores_what_was_not_evaluated(spark):
    rows = [(1, "a", "not-evaluated"), (1, "b", "inconclusive"), (2, "a", "fail"), (2, "b", "pass")]
    got = {r["change"]: (r["ok"], r["failed"]) for r in gate.gate(spark.createDataFrame(rows, "change int, rule string, status string")).collect()}
    assert got == {1: (True, []), 2: (False, ["a"])}


def test_two_postings_keep_the_last_only(spark):
    accounts = spark.createDataFrame([(1, 1000, 0)], "account long, balance long, overdraft long")
    posted = bank.post(spark.createDataFrame([(1, 1, "C", 100), (2, 1, "C", 7), (3, 1, "X", 5), (4, 9, "C", 1)], "seq long, account long, type string, amount long"), accounts)
    none = spark.createDataFrame([], "account long, interest long"), spark.createDataFrame([], "account long, fee long")
    assert bank.settle(accounts, none[0], posted, none[1]).first()["closing"] == 1000  # the rejected last posting writes the opening balance back
    assert bank.settle(accounts, none[0], posted, none[1], cumulative=True).first()["closing"] == 1107


def test_diff_of_equal_snapshots_is_empty_and_nulls_are_values(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 5)], "id int, kind string, v int")
    assert diff.diff(a, a, "id", ["kind", "v"]).count() == 0
    b = a.withColumn("v", F.coalesce("v", F.lit(0)))
    assert [r["id"] for r in diff.diff(a, b, "id", ["kind", "v"]).collect()] == [1]


def test_trailers_need_a_last_paragraph_of_trailers_only(spark):
    rows = [(["s", "", "A: b", "C: d"],), (["s", "", "A: b", "text"],), (["A: b"],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "l array<string>").select(T.trailers(F.col("l"))).collect()]
    assert got[:4] == [["A: b", "C: d"], [], [], []]


def test_people_match_by_address_or_name(spark):
    one = spark.createDataFrame([("Ann", "A@x", "Other", "a@X"), ("Ann", None, "ANN", "q@x"), ("Ann", "a@x", "Ann", "b@x")], "n string, e string, m string, f string")
    assert [r[0] for r in one.select(T.same_person(F.col("n"), F.col("e"), F.col("m"), F.col("f"))).collect()] == [True, True, False]


def test_longest_prefix_not_any(spark):
    rows = spark.createDataFrame([(1, "lib/ab/x"), (2, "lib/a"), (3, "bin"), (4, None)], "id int, path string")
    prefixes = spark.createDataFrame([("lib", 1), ("lib/a", 2), ("lib/ab", 3)], "prefix string, c int")
    assert {r["id"]: r["c"] for r in graph.longest_prefix(rows, "path", prefixes).collect()} == {1: 3, 2: 2, 3: None, 4: None}


def test_job_control_folding(spark):
    text = "//J JOB X\n//* note\n//S1 EXEC PGM=A,\n//   PARM=1\n//IN DD *\n//*\nDATA EXEC\n/*\n//O DD DSN=Q,DISP=(OLD,KEEP)"
    got = [(r["name"], r["kind"], r["operands"]) for r in L.jcl(L.to_lines(spark.createDataFrame([(1, text)], "f int, t string"), "f", "t")).orderBy("first").collect()]
    assert got == [("J", "JOB", "X"), ("S1", "EXEC", "PGM=A,PARM=1"), ("IN", "DD", "*"), ("O", "DD", "DSN=Q,DISP=(OLD,KEEP)")]


def test_entry_module_has_sql_for_queries_only():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())

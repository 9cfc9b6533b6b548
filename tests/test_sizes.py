"""Work that grows with the square of a table is dealt to many tasks and not written; results against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import cover, graph, program, steps, storage, walk
from lodestrand.plans import evidence, programs
from lodestrand.sources import lines as L


def plan(df):
    return df._jdf.queryExecution().toString()


def sets(n, elements, seed, least=1):
    r = random.Random(seed)
    return {f"c{k}": set(r.sample(range(elements), r.randint(least, min(elements, least + 9)))) for k in range(n)}


def rows_of(spark, given):
    return spark.createDataFrame([(c, e) for c, s in given.items() for e in s], "candidate string, element int")


@pytest.mark.parametrize(("n", "elements", "least"), [(150, 12, 3), (90, 2500, 40)])
def test_common_elements_in_tiles(spark, monkeypatch, n, elements, least):
    monkeypatch.setattr(cover, "TILE", 16, raising=False)
    given = sets(n, elements, 3, least)
    found = cover.in_common(rows_of(spark, given))
    want = {(a, b): len(given[a] & given[b]) for a in given for b in given if a < b and given[a] & given[b]}
    assert {(r["a"], r["b"]): r["common"] for r in found.collect()} == want
    if elements < 1000:  # one block: no aggregation by pair, and no task has most of the pairs
        assert not re.search(r"Aggregate\s*\[a#", plan(found))
        each = found.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in each) < len(want) / 2


def test_slack_terms_without_an_aggregation_by_pair(spark, monkeypatch):
    monkeypatch.setattr(cover, "TILE", 16, raising=False)
    given = sets(80, 10, 4)
    made = cover.cover_slack_qubo(rows_of(spark, given).withColumn("element", F.col("element").cast("string")), spark.createDataFrame([(c, 2) for c in given], "candidate string, cost long"))
    assert not re.search(r"Aggregate\s*\[a#\d+, b#", plan(made))
    chosen = {(r["a"], r["b"]): r["v"] for r in made.filter("a <> b AND a LIKE 'c%' AND b LIKE 'c%'").collect()}
    assert chosen == {(a, b): 2 * (2 * 80 + 1) * len(given[a] & given[b]) for a in given for b in given if a < b and given[a] & given[b]}


@pytest.mark.parametrize(("n", "elements", "least"), [(150, 8, 1), (120, 1500, 1)])
def test_dominated_candidates_in_tiles(spark, monkeypatch, tmp_path, n, elements, least):
    monkeypatch.setattr(cover, "TILE", 16, raising=False)
    given = sets(n, elements, 6, least)
    given["c0"], given["c1"], given["c2"] = set(range(elements)), {1, 2}, {2}
    cost = {c: k % 3 for k, c in enumerate(given)}
    pairs = rows_of(spark, given).union(spark.createDataFrame([("c5", None)], "candidate string, element int"))
    size = {c: len(s) + (c == "c5") for c, s in given.items()}
    want = {a for a in given if a != "c5" and any(b != a and given[a] <= given[b] and cost[b] <= cost[a] and (size[b] > size[a] or cost[b] < cost[a] or b < a) for b in given)}
    written = []
    cut = cover.cut
    monkeypatch.setattr(cover, "cut", lambda df, tag: written.append(tag) or cut(df, tag))
    found = cover.dominated(pairs, spark.createDataFrame(list(cost.items()), "candidate string, cost long"))
    assert sorted(r["candidate"] for r in found.collect()) == sorted(want)
    assert ("may" in written) == (elements > 1024)  # no table of pairs where one block holds all elements


@pytest.mark.parametrize("batch", [1, 40, 10_000])
def test_greedy_picks_many_a_round(spark, monkeypatch, batch):
    monkeypatch.setattr(cover, "BATCH", batch, raising=False)
    given = sets(40, 60, 8, 5)
    given["c0"] = set(range(0, 60, 2))
    given["c1"] = set(range(60))
    price = {c: k % 4 + 1 for k, c in enumerate(given)} | {"c1": 1000}
    left, want = {c: set(s) for c, s in given.items()}, []
    while any(left.values()):
        best = min((c for c in left if left[c]), key=lambda c: (price[c] / len(left[c]), c))
        want.append((len(want) + 1, best, price[best], len(left[best])))
        gone = set(left[best])
        left = {c: s - gone for c, s in left.items()}
    rounds = []
    cut = cover.cut
    monkeypatch.setattr(cover, "cut", lambda df, tag: rounds.append(tag) or cut(df, tag))
    got = cover.greedy_cover(rows_of(spark, given), spark.createDataFrame(list(price.items()), "candidate string, cost long"))
    assert [tuple(r) for r in got.orderBy("step").collect()] == want
    if batch == 10_000:
        assert rounds.count("gains") == 2 < len(want)  # all in one round, and one that finds nothing left


def test_qualified_names_by_kind_of_item(spark):
    """20,000 references to one name: pairs would be 400 million."""
    items = spark.range(20_000).selectExpr("id", "'N' AS name", "array('G' || id % 7, 'H' || id % 3) AS path").union(spark.sql("SELECT 90001L, 'N', array('ONLY', 'H1') UNION ALL SELECT 90002L, 'M', array('H1', 'G1', 'H1') UNION ALL SELECT NULL, 'M', array('H1', 'G1')"))
    refs = spark.range(20_000).selectExpr("id AS ref", "'N' AS name", "CASE id % 4 WHEN 0 THEN array('H1', 'ONLY') WHEN 1 THEN array('G1') WHEN 2 THEN array('NO') END AS qualifiers")
    more = spark.sql("SELECT 90001L AS ref, 'M' AS name, array('G1', 'H1') AS qualifiers UNION ALL SELECT 90002L, NULL, array('G1') UNION ALL SELECT 90003L, 'M', array()")
    found = program.qualified(refs.union(more), items)
    got = {r["ref"]: (r["target"], r["reason"]) for r in found.collect()}
    want = {0: (90001, None), 1: (None, "ambiguous"), 2: (None, "not found"), 3: (None, "not found"), 90001: (90002, None), 90002: (None, "not found"), 90003: (90002, None)}
    assert len(got) == 20_003 and all(got[k] == want[k if k > 20_000 else k % 4] for k in got)
    assert not re.search(r"\b_id#", plan(found))  # references meet kinds of items, not items


def test_fallback_takes_the_best_before_it_joins(spark):
    refs = spark.sql("SELECT * FROM VALUES (1L, 'a', 0L), (2L, 'a', 1L), (3L, 'b', 1L), (4L, 'z', 0L), (5L, NULL, 0L), (6L, 'c', 0L) AS t(ref, nation, class)")
    found = spark.sql("SELECT * FROM VALUES ('a', 0L, 20L), ('a', 0L, 10L), ('a', 3L, 5L), ('b', 2L, 7L), ('c', 0L, CAST(NULL AS BIGINT)), ('c', 1L, 9L) AS t(nation, class, k)")
    many = spark.range(100_000).selectExpr("'a' AS nation", "0L AS class", "id + 100 AS k")
    made = graph.ranked_fallback(refs, found.union(many), ["nation"], ["class"], ["k"], ["ref"])
    assert {r["ref"]: r["k"] for r in made.collect()} == {1: 10, 2: 5, 3: 7, 4: None, 5: None, 6: 9}


def test_fallback_keeps_orders_of_unknown_customers(spark, tmp_path):
    spark.sql("SELECT 1L AS o_orderkey, 7L AS o_custkey UNION ALL SELECT 2L, 8L").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 7L AS c_custkey, 3 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 5L AS s_suppkey, 3 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(tuple(r) for r in evidence.ranked_fallback(spark, str(tmp_path)).collect()) == [(1, 5), (2, None)]


@pytest.mark.parametrize("query", ["storage_layout", "storage_values", "storage_occurrences"])
def test_layouts_join_no_tables_on_the_driver(spark, query, monkeypatch):
    monkeypatch.setattr(storage, "ROWS", 50, raising=False)
    text = "01 R.\n 05 A PIC X(4) VALUE 'ab'.\n 05 B REDEFINES A PIC X(4).\n 05 T OCCURS 2.\n  10 C OCCURS 3 PIC 9(3) COMP-3.\n 05 D PIC X."
    lines = L.to_lines(spark.range(40).selectExpr("id AS f", f"'{text.replace(chr(39), chr(39) * 2)}' AS t"), "f", "t").repartition(2)
    monkeypatch.setattr(programs, "_records", lambda spark, d: lines)
    found = programs.QUERIES[query](spark, "")
    assert "BroadcastHashJoin" not in plan(found) and not re.search(r"Scan parquet|FileScan", plan(found))
    got = [tuple(r) for r in found.filter("file = 39").collect()]
    if query == "storage_layout":
        assert sorted(got) == [(39, 1, "R", 17, 17, 0, None), (39, 2, "A", 4, 4, 0, None), (39, 3, "B", 4, 4, 0, None), (39, 4, "T", 6, 12, 4, None), (39, 5, "C", 2, 6, 4, None), (39, 6, "D", 1, 1, 16, None)]
    elif query == "storage_values":
        assert got == [(39, 3, "B", "'AB'", 2, True)]
    else:
        assert sorted(x[3:5] for x in got if x[2] == "C") == [(f"{i},{j}", 4 + (i - 1) * 6 + (j - 1) * 2) for i in (1, 2) for j in (1, 2, 3)]
    assert found.count() == 40 * len(got)


def test_steps_gather_a_pair_of_nodes_once(spark):
    """The three modes of a node are one row in the aggregation, and walks that are told so don't gather steps again."""
    nodes = spark.sql("SELECT * FROM VALUES ('data:A', 'data'), ('data:G', 'data'), ('file:F', 'file'), ('program:P', 'program') AS t(id, kind)")
    edge = "CAST(NULL AS STRING) AS disp, false AS dynamic, CAST(NULL AS STRING) AS paragraph"
    edges = spark.sql(f"SELECT 'para:P.X' AS src, 'data:A' AS dst, 'uses-data' AS kind, true AS resolved, CAST(NULL AS STRING) AS command, {edge}, 'read' AS mode UNION ALL SELECT 'para:P.X', 'file:F', 'cics-file', true, 'READ', {edge}, NULL")
    found = steps.steps(nodes, edges, spark.sql("SELECT 'data:A' AS id, 'data:G' AS parent"))
    got = {(r["src"], r["dst"], r["tier"], r["label"]) for r in found.collect()}
    modes = ("node", "definition", "value")
    want = {(f"file:F|{m}", "para:P.X|node", 2, "read-by") for m in modes} | {(f"data:{x}|{m}", "para:P.X|node", 1, "read-by") for x in "AG" for m in modes if (x, m) != ("A", "definition")}
    want |= {("data:A|definition", "data:G|definition", 0, "part-of"), ("data:A|definition", "para:P.X|node", 0, "used-by")}
    assert got == want
    assert re.search(r"Generate explode[\s\S]*Aggregate \[id#", plan(found).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0])


def test_ways_over_stored_steps_write_them_once(spark, monkeypatch):
    spread = spark.sql("SELECT * FROM VALUES ('a|node', 'b|node', 0, 'used-by'), ('b|node', 'c|value', 1, 'runs'), ('a|node', 'c|value', 2, 'writes') AS t(src, dst, tier, label)")
    written, cut = [], steps.cut
    for module in (steps, walk):
        monkeypatch.setattr(module, "cut", lambda df, tag: written.append(tag) or cut(df, tag))
    found = steps.reached_by(spread, spark.sql("SELECT 'a' AS id, 'node' AS mode, CAST(NULL AS STRING) AS entry"), once=True)
    got = {r["id"]: (r["tier"], r["length"], [tuple(x) for x in r["via"]]) for r in found.collect()}
    assert got == {"a": (0, 0, []), "b": (0, 1, [("a", "b", "used-by")]), "c": (1, 2, [("a", "b", "used-by"), ("b", "c", "runs")])}
    assert written.count("steps") == 1 and "edges" not in written

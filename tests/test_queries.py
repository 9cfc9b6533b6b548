"""Every query of the library's own operators against its SQL on the smallest tables."""

import os
import random
from pathlib import Path

import duckdb
import pytest

from lodestrand.operators import cover
from __spark_entry__ import PLANS
from lodestrand.plans import business

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = {k: v for m in PLANS for k, v in m.QUERIES.items()}, {k: v for m in PLANS for k, v in m.SQL.items()}


def norm(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = db.sql(SQL[name])
    assert names == sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in names)
    assert norm(tuple(r) for r in df.select(*names).collect()) == norm(db.sql(f"SELECT {listed} FROM ({SQL[name]})").fetchall())


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_greedy_cover_against_brute_force(spark):
    pairs, costs = business._cover_parts(spark, DATA)
    left = {}
    for r in pairs.collect():
        left.setdefault(r["candidate"], set()).add(r["element"])
    price, want = {r["candidate"]: r["cost"] for r in costs.collect()}, []
    while any(left.values()):
        best = min((c for c in left if left[c]), key=lambda c: (price[c] / len(left[c]), c))
        want.append((best, len(left[best])))
        gone = set(left[best])
        left = {c: s - gone for c, s in left.items()}
    got = [(r["candidate"], r["gained"]) for r in business.cover_greedy(spark, DATA).orderBy("step").collect()]
    assert got == want


def test_greedy_cover_takes_all_rows(spark, db):
    [(n,)] = db.sql("SELECT count(DISTINCT l_partkey) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey").fetchall()
    assert sum(r["gained"] for r in business.cover_greedy(spark, DATA).collect()) == n


def test_greedy_cover_in_rounds(spark):
    r = random.Random(5)
    pairs = [(f"c{r.randrange(60)}", f"e{r.randrange(40) + 40 * (k % 3)}") for k in range(300)]
    pairs += [("null", None), ("c1", None)]
    price = {c: r.randint(1, 4) for c, _ in pairs}
    left, want = {c: {e for x, e in pairs if x == c} for c in price}, []
    while any(left.values()):
        best = min((c for c in left if left[c]), key=lambda c: (price[c] / len(left[c]), c))
        want.append((len(want) + 1, best, price[best], len(left[best])))
        gone = set(left[best])
        left = {c: s - gone for c, s in left.items()}
    df = spark.createDataFrame(pairs, "candidate string, element string")
    assert [tuple(x) for x in cover.greedy_cover(df, spark.createDataFrame(list(price.items()), "candidate string, cost long")).orderBy("step").collect()] == want
    assert cover.greedy_cover(df.limit(0), spark.createDataFrame([("a", 1)], "candidate string, cost long")).count() == 0

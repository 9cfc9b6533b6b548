"""The cheapest cover against enumeration by sets of elements."""

import os
import random

import pytest

from lodestrand.operators import exact_cover
from lodestrand.plans import business

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def least(pairs, cost):
    """The least cost, by what is covered."""
    elements = {e: k for k, e in enumerate(sorted({e for _, e in pairs}))}
    sets = {}
    for c, e in pairs:
        sets[c] = sets.get(c, 0) | 1 << elements[e]
    best = {0: 0}
    for c, s in sets.items():
        for covered, price in list(best.items()):
            now = covered | s
            if price + cost[c] < best.get(now, 1 << 60):
                best[now] = price + cost[c]
    return best[(1 << len(elements)) - 1]


def check(pairs, costs):
    rows, cost = [(r["candidate"], r["element"]) for r in pairs.collect()], {r["candidate"]: r["cost"] for r in costs.collect()}
    got = exact_cover.exact_cover(pairs, costs).collect()
    names = {r["candidate"] for r in got}
    assert len(names) == len(got) and {e for c, e in rows if c in names} == {e for _, e in rows}
    assert sum(r["cost"] for r in got) == sum(cost[c] for c in names) == least(rows, cost)


@pytest.mark.parametrize("candidates,elements,seed", [(6, 5, 0), (20, 15, 1)])
def test_random_problems(spark, candidates, elements, seed):
    r = random.Random(seed)
    pairs = {(f"c{r.randrange(candidates)}", e) for e in range(elements) for _ in range(4)}
    costs = [(f"c{k}", r.randint(1, 6)) for k in range(candidates)]
    check(spark.createDataFrame(sorted(pairs), "candidate string, element int"), spark.createDataFrame(costs, "candidate string, cost int"))


def test_greedy_is_beaten(spark):
    pairs = [("all-but", k) for k in range(4)] + [("a", 0), ("a", 1), ("a", 4), ("b", 2), ("b", 3), ("b", 5)]
    check(spark.createDataFrame(pairs, "candidate string, element int"), spark.createDataFrame([("all-but", 3), ("a", 2), ("b", 2)], "candidate string, cost int"))
    with pytest.raises(ValueError, match="9"):
        exact_cover.exact_cover(spark.createDataFrame([("a", 1), ("x", 9)], "candidate string, element int"), spark.createDataFrame([("a", 1)], "candidate string, cost int"))


def test_nations_that_buy_every_size(spark):
    pairs, costs = business._buyers(spark, DATA)
    got = business.cover_exact(spark, DATA).collect()
    rows, names = [(r["candidate"], r["element"]) for r in pairs.collect()], {r["candidate"] for r in got}
    assert {e for c, e in rows if c in names} == {e for _, e in rows}
    cost = {r["candidate"]: r["cost"] for r in costs.collect()}
    # no cheaper one: subsets by growing cost
    elements = {e: k for k, e in enumerate(sorted({e for _, e in rows}))}
    sets = {}
    for c, e in rows:
        sets[c] = sets.get(c, 0) | 1 << elements[e]
    full, total = (1 << len(elements)) - 1, sum(r["cost"] for r in got)
    order = sorted(sets)
    seen, todo = False, [(0, 0, 0)]
    while todo:
        k, covered, price = todo.pop()
        if covered == full:
            seen = seen or price < total
        elif k < len(order) and price + 2 < total:
            todo += [(k + 1, covered, price), (k + 1, covered | sets[order[k]], price + cost[order[k]])]
    assert not seen

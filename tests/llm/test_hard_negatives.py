"""Hard negatives against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int, q double"


def brute(rows, asks, label, positives=5, negatives=10, low=30, high=90, scale=256):
    """(anchor, positive, rank, negative, positive's score, negative's) of rows (id, vector, label) that take part."""
    part = [(i, [math.floor(scale * float(np.float32(c))) for c in v], label(i, y)) for i, v, y in rows]
    out = set()
    for i, q, y in part:
        if not asks(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, z) for j, p, z in part)
        for s, j, _ in [x for x in scores if x[2] == y and x[1] != i][:positives]:
            fits = [x for x in scores if x[2] != y and low * -s <= 100 * -x[0] <= high * -s]
            out |= {(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits[:negatives])}
    return out


def moved(i, y):
    return (y + 1) % 10 if i % 7 == 0 else y


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(6)
    near = r.standard_normal((10, 16))
    out = []
    for k in range(1500):
        y = int(r.integers(10))
        v = near[y] * 0.12 + r.standard_normal(16) * 0.1 * (3 if k % 50 == 0 else 1)
        out.append((k, [float(c) for c in v], y))
    out += [(3000 + 50 * k, out[100][1], 4) for k in range(30)]  # equal vectors, ties among anchors and candidates
    out += [(6000, [0.0] * 16, 3), (6001, [-c for c in out[100][1]], 4)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "s", 1, 0.5) for i, v, y in rows], SCHEMA).repartition(3)


ODD = [(7000, None, 1), (7001, [None] + [0.1] * 15, 1), (7100, [float("nan")] * 16, 2), (7200, [float("inf")] * 16, 2), (7300, [0.2] * 16, None), (None, [0.2] * 16, 1), (7400, [0.3, 0.4], 1), (7500, [], 2)]


def test_all_anchors(spark, rows, tmp_path):
    table(spark, rows + ODD).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op12_hard_negatives"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) > 500
    assert set(found) == brute(rows, lambda i: i % 100 == 0, moved)


def test_bundles_blocks_and_steps_change_nothing(spark, rows, monkeypatch):
    want = brute(rows, lambda i: i % 25 == 0, lambda i, y: y, 3, 4, 50, 100)
    for anchors, blocks, together, first in ((7, 3, 5, 1), (40, 1, 16, 700)):
        for name, value in {"ANCHORS": anchors, "LEAST_BLOCKS": blocks, "TOGETHER": together, "FIRST_STEP": first}.items():
            monkeypatch.setattr(hard_negatives, name, value)
        monkeypatch.setattr(hard_negatives.clustered, "__defaults__", (anchors,))
        got = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 25 == 0, F.col("label"), positives=3, negatives=4, low=50, high=100)
        assert {tuple(r) for r in got.collect()} == want


def test_no_rows_no_anchors_one_label_and_huge_entries(spark, rows):
    ask, label = F.col("vec_id") % 100 == 0, F.col("label")
    assert hard_negatives.hard_negatives(table(spark, rows).limit(0), ask, label).count() == 0
    assert hard_negatives.hard_negatives(table(spark, rows), F.lit(False), label).count() == 0
    assert hard_negatives.hard_negatives(table(spark, rows), ask, F.lit(1)).count() == 0
    big = spark.createDataFrame([(100, [1e30, 2.0], 1), (1, [5e5, 1.0], 1), (2, [2e5, 1.0], 2), (3, [-1e30, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in hard_negatives.hard_negatives(big, ask, label).collect()]
    most = 1 << 27
    own = [(most, 512), (512 * 250000, 256), (512 * 100000, 256)]
    assert got == [(100, 1, 1, 2, own[0][0] * own[1][0] + 512 * 256, own[0][0] * own[2][0] + 512 * 256)]


def test_bounds_hold_and_walks_end_early():
    r = np.random.default_rng(1)
    anchors = (r.standard_normal((40, 8)) * 6 + np.array([60] + [0] * 7)).astype(np.int64)
    rows = (r.standard_normal((4000, 8)) * 25).astype(np.int64)
    order, bound = hard_negatives.shared_list(anchors, rows)
    scores = anchors @ rows[order].T
    assert (scores <= np.linalg.norm(anchors, axis=1)[:, None] * bound[:-1]).all() and (np.diff(bound) <= 0).all()
    ends = [next(k for k in range(len(order)) if np.linalg.norm(a) * bound[k] < np.sort(s)[-5]) for a, s in zip(anchors, scores, strict=True)]
    assert max(ends) < len(order) / 4


def test_repeated_anchor_rows_ask_once(spark, rows):
    twice = rows + [rows[0], rows[100]]
    got = [tuple(r) for r in hard_negatives.hard_negatives(table(spark, twice), F.col("vec_id") == 100, F.col("label")).collect()]
    assert len(got) == len(brute([r for r in rows if r[0] != 0] + [rows[0]], lambda i: i == 100, lambda i, y: y))

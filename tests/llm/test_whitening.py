"""Whitening against a library's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from lodestrand.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, c string, n long"


def brute(rows, most=8):
    """The contract's values of rows (id, vector) by plain arithmetic and numpy's own decomposition."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[c - s / n for c, s in zip(v, total, strict=True)] for v in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return n, {r[0]: sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True)) for r, v in zip(rows, x, strict=True)}, y @ q, e, float(np.trace(y.T @ y / n))


def check(df, rows, most=8):
    n, deviation, projected, e, trace = brute(rows, most)
    got = whitening.whitened(df, most=most).collect()
    assert len(got) == len(rows) * len(e)
    table = {(r["id"], r["component"]): r for r in got}
    for k in range(len(e)):
        own = [table[r[0], k + 1] for r in rows]
        assert all(r["n"] == n and int(r["deviation"]) == deviation[i[0]] for r, i in zip(own, rows, strict=True))
        assert all(abs(r["explained"] - e[k] / trace) < 1e-9 for r in own)
        want, found = projected[:, k] / e[k] ** 0.5, np.array([r["whitened"] for r in own])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-6
        assert all(r["identity_error"] < 1e-9 for r in own)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    near = r.standard_normal((5, 12))
    return [(k, [float(c) for c in near[k % 5] * 0.3 + r.standard_normal(12) * 0.1 * np.arange(1, 13)]) for k in range(300)]


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", 3) for k, v in rows], SCHEMA).repartition(3)


def test_all_rows_that_take_part(spark, rows):
    odd = [(1000, None), (1001, [None] + [0.5] * 11), (1002, [float("nan")] + [0.5] * 11), (1003, [float("inf")] * 12), (1004, []), (1005, [0.5, 0.25])]
    check(table(spark, rows + odd), rows)
    check(table(spark, rows), rows, most=3)
    check(table(spark, rows), rows, most=40)


def test_query_over_a_folder(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op11_embedding_whitening"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert got.count() == 8 * len(rows)


def test_few_rows_repeated_rows_and_none(spark):
    assert whitening.whitened(table(spark, []).limit(0)).count() == 0
    one = whitening.whitened(table(spark, [(1, [0.5, 0.25, 1.0])])).collect()
    assert [(r["component"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(k, 0, None, None, None) for k in (1, 2, 3)]
    two = whitening.whitened(table(spark, [(1, [0.5, 0.25, 1.0]), (1, [0.5, 0.25, 1.0]), (None, [0.0, 0.25, 2.0])])).collect()
    assert len(two) == 9 and sum(r["whitened"] is None for r in two) == 6
    first = [r for r in two if r["component"] == 1]
    assert sorted(round(abs(r["whitened"]), 6) for r in first) == [round(0.5**0.5, 6)] * 2 + [round(2**0.5, 6)] and all(abs(r["explained"] - 1) < 1e-12 for r in first)


def test_entries_of_any_size_keep_sums_exact(spark):
    rows = [(k, [3.0e12 * (k % 7), 1.0 * k]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    want = {k: sum((40 * c - s) ** 2 for c, s in zip(v, total, strict=True)) for (k, _), v in zip(rows, x, strict=True)}
    assert {r["id"]: int(r["deviation"]) for r in whitening.whitened(df).collect()} == want
    assert whitening.whitened(spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).count() == 4


@pytest.mark.parametrize("kind", ["random", "repeated", "low rank", "diagonal", "wide"])
def test_components_of_symmetric_matrices(kind):
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        q = np.linalg.qr(r.standard_normal((n, n)))[0]
        e = {"random": r.random(n), "repeated": np.repeat([3.0, 1.0], n)[:n], "low rank": np.where(np.arange(n) < 3, 5.0 - np.arange(n), 0.0), "diagonal": np.arange(n) * 1.0, "wide": 10.0 ** -np.arange(n)}[kind]
        a = np.diag(e) if kind == "diagonal" else (q * e) @ q.T
        a = (a + a.T) / 2
        values, found = whitening.components(a, n)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-12 * max(1, np.abs(e).max()))
        assert np.abs(found.T @ found - np.eye(n)).max() < 1e-12 and np.abs(a @ found - found * values).max() < 1e-12 * max(1, np.abs(e).max())


def test_polar_factor():
    r = np.random.default_rng(4)
    a = r.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u @ u.T - np.eye(30)).max() < 1e-12
    assert np.linalg.eigvalsh((u @ a + (u @ a).T) / 2).min() > -1e-9

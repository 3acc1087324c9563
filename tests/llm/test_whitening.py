"""Whitening against numpy over the distinct vectors, and its edge rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import whitening
from ctxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def check(got, rows, counted=False):
    """``rows``: (key, vector) pairs that remain."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for _, v in rows]
    fit = sorted(set(x))
    weight = np.array([x.count(v) if counted else 1 for v in fit], float)
    n, d = int(weight.sum()), len(fit[0])
    sums = [sum(int(w) * v[i] for v, w in zip(fit, weight, strict=True)) for i in range(d)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    cov = (centred * weight[:, None]).T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(4, d)
    assert len(got) == k * len(rows)
    want = {v: (sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), c) for v, c in zip(fit, centred, strict=True)}
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r[0], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c in range(1, k + 1):
        sign = set()
        for key, v in zip([key for key, _ in rows], x, strict=True):
            dev, off = want[v]
            mine = [r for r in by[c][key] if r["deviation"] == dev]
            assert mine and all(r["n"] == n for r in mine)
            r = mine[0]
            assert math.isclose(r["explained"], values[c - 1] / values.sum(), rel_tol=1e-9, abs_tol=1e-12)
            z = off @ vectors[:, c - 1] / math.sqrt(values[c - 1])
            assert abs(abs(z) - abs(r["whitened"])) < 1e-6
            if abs(z) > 1e-3:
                sign.add(z * r["whitened"] > 0)
        assert len(sign) <= 1
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] <= 1e-9


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op13_multiplicity_whitening"](spark, SF).collect(), rows)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_copies_weigh_as_asked(spark, monkeypatch, weights):
    monkeypatch.setattr(whitening, "HOT", 7)
    monkeypatch.setattr(whitening, "SPLIT", 5)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(150)] + [(300 + i, rows[4][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = whitening.whiten(df, weights=weights)
    check(out.collect(), rows, weights == "count")


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25, 0.0]), (1, [0.5, -0.25, -0.0]), (None, [1.0, 2.0, 3.0]), (4, [-1.0, 0.1, 7.0]), (4, [9.0, 9.5, -3.0])]
    bad = [(6, None), (7, [None, 1.0, 1.0]), (8, [nan, 0.0, 0.0]), (9, [0.0, -inf, 0.0]), (10, []), (11, [1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    clash = df.select("*", *[F.lit("c").alias(c) for c in ("_x", "_key", "_rows", "_w", "_row", "n", "component", "deviation")])
    check(whitening.whiten(clash).collect(), good)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (6, 10)")).columns == whitening.whiten(df).columns


def test_directions_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [4.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    assert len(got) == 6 and all((got[k, 2]["whitened"], got[k, 2]["explained"]) == (None, 0.0) and abs(got[k, 1]["whitened"]) < 2 for k in (1, 2, 3))
    assert got[1, 1]["explained"] == 1.0 and got[1, 1]["identity_error"] < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, 0.0, None)] * 2


def test_large_values_stay_exact(spark):
    rows = [(1, [3.0e13, 1.0]), (2, [-2.0e13, 5.0]), (3, [1e300, 0.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1, 1]["n"] == 3 and all(r["deviation"] is None for r in got.values())
    x = np.array([[2**52 + 1, 2**53], [-3, 5]], np.int64)
    n, sums = 2, [int(v) for v in x.sum(0)]
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert whitening._deviation(x, n, sums).to_pylist() == [e if e < 2**63 else None for e in exact]
    assert Fraction(sums[0], n).denominator in (1, 2)

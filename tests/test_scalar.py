"""Scalar operators against brute force (P15 string cleanup, P18 loan estimate)."""

import re
import urllib.parse

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import scalar as S


def test_loan_estimate_is_the_nearest_of_the_whole_grid(spark):
    rows = [(1, 470790.0, 47041.0, 12), (2, 58500.0, 6597.0, 12), (3, 100000.0, 9500.0, 13), (4, 2e5, 2e4, 12),
            (5, 1000.0, 16.7, 12), (6, 1000.0, 999.0, 12), (7, 1000.0, 10.0, 12), (8, 1000.0, 50.0, 60), (9, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, pv double, p double, ns long")
    out = {r["id"]: r for r in S.loan_estimates(df, "pv", "p", "ns", t_apr=0.025).collect()}
    grid = np.arange(1, 100_000) / 100_000
    for i, pv, p, ns in rows:
        offers = []
        for n in range((ns // 6 + 1) * 6, 61, 6):
            if pv is not None and n * p >= pv:
                off = np.abs(pv * grid / (1 - (1 + grid) ** -n) - p)
                offers.append((grid[len(off) - 1 - off[::-1].argmin()], n))
        if not offers:
            assert out[i]["estimate_apr"] is None and out[i]["estimate_terms"] is None
            continue
        rate, term = min(offers, key=lambda o: (abs(o[0] - 0.025), -o[1]))
        assert abs(out[i]["estimate_apr"] - rate) < 1e-12 and out[i]["estimate_terms"] == term


def _clean(s):
    s = re.sub(r"%2522|%(25){0,}2B|%20|%(25){0,}28|%(25){0,}29|%(25){0,}2C", " ", s)
    s = urllib.parse.unquote(s)
    s = re.sub(r"-{1,}|(?<=[a-zA-Z\d])\+{1,}\s{0,}(?=[a-zA-Z\d])|_{1,}", " ", s)
    s = re.sub(r"\s{2,}", " ", s)
    s = re.sub(r"\(|\)", "", s).upper()
    return None if "%" in s else s


def test_device_cleanup_matches_python(spark):
    vals = ["HUAWEI%2520MATE-10", "iPhone%252B8+Plus", "OPPO_R11(s)", "vivo%2528X9%2529", "mi  note",
            "SM%2CG9", "a+b+c", "x%zz", "Redmi Note%25204", "100%25"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, s string")
    got = {r["i"]: r["c"] for r in df.select("i", S.clean_device_string("s").alias("c")).collect()}
    for i, v in enumerate(vals):
        assert got[i] == _clean(v), (v, got[i], _clean(v))


def test_row_stats_are_plain_arithmetic(spark):
    """No function per element (those run uncompiled and again inside each other)."""
    from tessera.operators.scalar import row_stats
    d = spark.createDataFrame([(1.0, 4.0, None, 2.0), (None, None, None, None), (3.0, None, None, None), (5.0, 1.0, 2.0, 9.0)],
                              "a double, b double, c double, d double")
    out = d.select(*row_stats(["a", "b", "c", "d"]))
    assert "lambda" not in out._jdf.queryExecution().toString()
    got = [[r.row_min, r.row_max, r.row_sum, r.row_median, r.row_var] for r in out.collect()]
    assert got[1] == [None, None, 0.0, None, None] and got[2] == [3.0, 3.0, 3.0, 3.0, None]
    assert got[0][:4] == [1.0, 4.0, 7.0, 2.0] and got[3][:4] == [1.0, 9.0, 17.0, 3.5]
    assert abs(got[0][4] - 7 / 3) < 1e-12

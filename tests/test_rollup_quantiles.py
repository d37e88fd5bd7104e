"""Medians and interquartile ranges of roll-ups without a buffer per group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import group as G
from tessera.operators import rollup as R
from tessera.plans.fuse import apply_parts


@pytest.fixture(scope="module")
def child(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 41 == 0 else int(rng.integers(6)) if i % 3 else 1, i % 4, None if i % 17 == 0 else float(rng.integers(50))) for i in range(2500)]
    return spark.createDataFrame(rows, "p long, s int, x double").cache()


def _want(child, keys, where=None):
    d = child.toPandas()
    d = d if where is None else d[where(d)]
    g = d.groupby(keys, dropna=False)["x"]
    return g.median(), g.quantile(0.75) - g.quantile(0.25)


def _key(v):
    return "none" if v is None or v != v else v


def test_recipe_dict_and_conditional_forms(child):
    med, iqr = _want(child, "p")
    med, iqr = ({_key(k): v for k, v in s.items()} for s in (med, iqr))
    t = R.recipe_aggregate(child, [(["p"], [("x", "median"), ("x", "iqr"), ("x", "mean")])])[("p",)]
    assert t.columns[0] == "p" and set(t.columns) == {"p", "p_median_x", "p_iqr_x", "p_mean_x"}
    d = R.dict_aggregate(child, "p", {"x": ["median", "max"]}, "C_")
    for r in t.collect():
        assert abs(r["p_median_x"] - med[_key(r["p"])]) < 1e-9 and abs(r["p_iqr_x"] - iqr[_key(r["p"])]) < 1e-9
    assert {(_key(r["p"]), r["C_x_MEDIAN"]) for r in d.collect()} == set(med.items())
    some, _ = _want(child, "p", lambda d: d.s == 2)
    c = R.conditional_aggregates(child, "p", {"x": ["median", "count"]}, {"TWO_": F.col("s") == 2, "NO_": F.col("s") == 9})
    for r in c.collect():
        assert abs(r["TWO_x_MEDIAN"] - {_key(k): v for k, v in some.items()}[_key(r["p"])]) < 1e-9
        assert r["NO_x_MEDIAN"] is None and r["NO_x_COUNT"] is None


def test_no_percentile_buffer_in_the_plans(child):
    plans = [R.recipe_aggregate(child, [(["p"], [("x", "median")])])[("p",)],
             apply_parts(child, G.group_relative(["p"], "x", "median", df=child))]
    for df in plans:
        text = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in text and "median(" not in text


def test_group_relative_median(child):
    parts = G.group_relative(["p", "s"], "x", "median", df=child)
    med, _ = _want(child, ["p", "s"])
    out = apply_parts(child, parts).collect()
    assert len(out) == 2500
    for r in out:
        if r["p"] is None or r["x"] is None:
            assert r[parts[0].name] is None
        else:
            assert abs(r[parts[0].name] - (r["x"] - med[(r["p"], r["s"])])) < 1e-9
    with pytest.raises(ValueError):
        G.group_relative(["p"], "x", "median")

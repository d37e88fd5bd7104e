"""The skew-safe positions engine against plain windows, with a hot key
that is forced across many chunks."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.positions import global_rank, with_positions, with_slices

from .conftest import SF01


def _events(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    # one user holds a third of all rows
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))


def test_hot_key_positions_match_window(spark):
    ev = _events(spark)
    p = with_positions(ev, ["user_id"], ["ts", "event_id"], sums=["value"], rows_per_chunk=250)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    ref = ev.select("event_id", (F.row_number().over(w) - 1).alias("rp"),
                    F.count("*").over(W.partitionBy("user_id")).alias("rn"),
                    F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("rc"))
    j = p.join(ref, "event_id")
    assert j.count() == ev.count()
    bad = j.where((F.col("_pos") != F.col("rp")) | (F.col("_n") != F.col("rn"))
                  | (F.abs(F.col("_cum_value") - F.col("rc")) > 1e-6))
    assert bad.count() == 0


def test_descending_and_global(spark):
    ev = _events(spark)
    d = with_positions(ev, ["user_id"], ["ts", "event_id"], rows_per_chunk=300, descending=True, pos="dp")
    wd = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    ref = ev.select("event_id", (F.row_number().over(wd) - 1).alias("rr"))
    assert d.join(ref, "event_id").where("rr != dp").count() == 0
    g = global_rank(ev, ["ts", "event_id"], total=None)
    ref = ev.select("event_id", (F.row_number().over(W.orderBy("ts", "event_id")) - 1).alias("rr"))
    assert g.join(ref, "event_id").where("rr != _rank").count() == 0


def test_no_window_over_key_alone(spark):
    """The plan never partitions a window by the key alone over the rows."""
    ev = _events(spark)
    p = with_positions(ev, ["user_id"], ["ts", "event_id"], rows_per_chunk=250)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan


def test_hot_key_leads_match_window(spark):
    ev = _events(spark).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    p = with_positions(ev, ["user_id"], ["ts", "event_id"], rows_per_chunk=200,
                       leads={"n2": ("t", 2), "p1": ("t", -1), "n5": ("t", 5)})
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    ref = ev.select("event_id", F.lead("t", 2).over(w).alias("r2"), F.lag("t", 1).over(w).alias("r1"),
                    F.lead("t", 5).over(w).alias("r5"))
    j = p.join(ref, "event_id")
    assert j.count() == ev.count()
    bad = j.where(~F.col("n2").eqNullSafe(F.col("r2")) | ~F.col("p1").eqNullSafe(F.col("r1"))
                  | ~F.col("n5").eqNullSafe(F.col("r5")))
    assert bad.count() == 0


def _awkward(spark):
    """NULLs, NaN, infinities, an outlier, heavy ties and a long common prefix."""
    rows = []
    for i in range(4000):
        x = [None, float("nan"), float("inf"), float("-inf"), 1e18, 5.0, 5.0, 5.0, i / 7.0][i % 9 if i % 4 == 0 else 8]
        rows.append((i, None if i % 11 == 0 else i % 3, x, f"Customer#{'0' * 12}{i:09d}", None if i % 5 == 0 else float(i)))
    return spark.createDataFrame(rows, "id long, k int, x double, s string, v double")


def test_nulls_ties_and_outliers_match_window(spark):
    df = _awkward(spark)
    for keys, order in ((["k"], ["x", "id"]), ([], ["s"]), (["k"], ["s"]), ([], ["x", "id"])):
        for desc in (False, True):
            p = with_positions(df, keys, order, sums=["v"], rows_per_chunk=160, descending=desc)
            o = [F.col(c).desc() if desc else F.col(c).asc() for c in order]
            w = W.partitionBy(*keys).orderBy(*o)
            ref = df.select("id", (F.row_number().over(w) - 1).alias("rp"),
                            F.count("*").over(W.partitionBy(*keys)).alias("rn"),
                            F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("rc"))
            j = p.join(ref, "id")
            assert j.count() == 4000
            assert j.where((F.col("_pos") != F.col("rp")) | (F.col("_n") != F.col("rn"))
                           | ~F.round("_cum_v", 3).eqNullSafe(F.round("rc", 3))).count() == 0, (keys, order, desc)


def test_leads_of_null_values_and_short_slices(spark):
    df = _awkward(spark)
    p = with_positions(df, ["k"], ["x", "id"], rows_per_chunk=24, leads={"a": ("v", 3), "b": ("v", -2)})
    w = W.partitionBy("k").orderBy("x", "id")
    ref = df.select("id", F.lead("v", 3).over(w).alias("ra"), F.lag("v", 2).over(w).alias("rb"))
    bad = p.join(ref, "id").where(~F.col("a").eqNullSafe(F.col("ra")) | ~F.col("b").eqNullSafe(F.col("rb")))
    assert bad.count() == 0


def test_slices_stay_small_and_build_runs_no_job(spark):
    df = _awkward(spark).select("*", F.lit(1).alias("one"))
    for order in (["x", "id"], ["s"], ["one", "id"]):
        sliced = with_slices(df, ["one"], order, 400)
        sizes = [r["count"] for r in sliced.groupBy("_chunk").count().collect()]
        assert max(sizes) <= 800 and len(sizes) > 20, order
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    with_positions(df, ["k"], ["x", "id"], sums=["v"], leads={"a": ("v", 1)}, rows_per_chunk=100)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def _brute_horizons(rows, h):
    """(prev, next, window) per id of (id, key, t); NULL times equal each other."""
    out = {}
    for i, k, t in rows:
        prev = nxt = win = 0
        for i2, k2, t2 in rows:
            if k2 != k or (t is None) != (t2 is None):
                continue
            same = t is None
            first = (0 if same else t2, i2) < (0 if same else t, i)
            prev += first and (same or t2 >= t - h)
            nxt += not first and i2 != i and (same or t2 <= t + h)
            win += same or t <= t2 <= t + h
        out[i] = (prev, nxt, win)
    return out


def test_horizons_across_slices_match_all_pairs(spark):
    """Short and long horizons, ties, NULL times, a hot key in many slices;
    whole and fractional times."""
    import random
    from tessera.operators import ordered as O
    rng = random.Random(9)
    rows = [(i, None if i % 40 == 0 else "hot" if i % 2 else f"k{i % 5}", None if i % 31 == 0 else rng.randrange(120)) for i in range(700)]
    old = spark.conf.get("tessera.positions.chunkRows", None)
    spark.conf.set("tessera.positions.chunkRows", "160")
    try:
        for kind, scale in (("long", 1), ("double", 0.5)):
            data = [(i, k, None if t is None else t * scale) for i, k, t in rows]
            df = spark.createDataFrame([(*r, "pass") for r in data], f"id long, k string, t {kind}, v string")
            hs = [3 * scale, 17 * scale, 500 * scale]
            got = O.horizon_counts(df, ["k"], F.col("t"), "id", ns=hs).collect()
            assert len(got) == len(rows) and all(r["v"] == "pass" for r in got)
            for h in hs:
                want = _brute_horizons(data, h)
                f = O._fmt(h)
                for r in got:
                    mine = tuple(r[f"count_{w}_{f}__k"] for w in ("prev", "next", "window"))
                    assert mine == ((None,) * 3 if r["k"] is None else want[r["id"]]), (kind, h, r)
    finally:
        spark.conf.set("tessera.positions.chunkRows", old) if old else spark.conf.unset("tessera.positions.chunkRows")


def test_the_input_runs_twice_at_most(spark):
    """After execution: one scan for the cuts, one for the rows; the reader for
    the slices reuses the exchange of the rows. Without cuts both go."""
    import re
    ev = _events(spark).select("event_id", "user_id", "ts", "value")

    def scans(rows_per_chunk):
        p = with_positions(ev, ["user_id"], ["ts", "event_id"], sums=["value"], rows_per_chunk=rows_per_chunk,
                           leads={"a": ("value", 3), "b": ("value", -2)})
        p.collect()
        plan = p._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        reused = len(re.findall("ReusedExchange", plan))
        return len(re.findall("Scan parquet", plan)), reused

    assert scans(200) == (2, 1)
    assert scans(10**9)[0] == 1

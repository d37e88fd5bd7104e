"""The streaming history scorer gives the same features as the batch F08/F09
operators on the same rows."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import group as G
from tessera.plans.fuse import apply_parts
from tessera.sources.io import shared_path
from tessera.streaming.feature_stream import score_stream

from .conftest import SF001


def test_stream_matches_batch(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").withColumn(
        "y", (F.col("event_type") == "purchase").cast("int"))
    hist, cur = ev.where(F.dayofmonth("ts") <= 15), ev.where(F.dayofmonth("ts") > 15)
    run = uuid.uuid4().hex
    src, sink, ck = (shared_path(spark, "stream", run, p) for p in ("src", "sink", "ck"))
    cur.write.parquet(src)
    q = score_stream(spark, src, cur.schema, hist, ["user_id"], "y", sink, ck)
    q.awaitTermination(120)
    got = spark.read.parquet(sink).select("event_id", "history_count", "history_mean")
    batch = apply_parts(cur, [G.history_count(hist, ["user_id"], name="history_count"),
                              G.history_mean(hist, ["user_id"], "y", name="history_mean")])
    want = batch.select("event_id", "history_count", "history_mean")
    assert got.count() == cur.count()
    assert got.exceptAll(want).count() == 0

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

# white space of every contract: space and the control characters 9 to 13
WS = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
# bytes.split() without argument cuts at exactly the same six characters
LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this run below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage at
    a point several consumers share, and survives a lost executor."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: bytes) -> list[bytes]:
    """Words of the contracts, A-Z lower-cased, other bytes as they are."""
    return text.translate(LOWER_BYTES).split()


def n_words(text: Column) -> Column:
    """Number of words; NULL and blank texts have none. Every word with the
    white space around it becomes one character, which are counted."""
    runs = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(r"[^\x20\x09-\x0D]"), F.length(F.regexp_replace(t, runs, "x"))) \
        .otherwise(F.lit(0)).cast("long")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(``node``, ``root``) of an undirected graph; the root is the smallest
    node id reachable (all of one comparable type).

    Alternating large-star / small-star rounds. Each round is two partially
    aggregated minima and two joins; a star whose centre touches a third of
    all nodes has one row per neighbour, and the skewed join side is the one
    AQE can split. The edges of every round are written to the shared folder,
    so the plan does not grow and nothing but two counters reaches the driver.
    """
    def clean(e: DataFrame) -> DataFrame:
        return (e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .where("u <> v").distinct())

    cur = materialise(clean(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    before = None
    while True:
        # large star: every neighbour above a node hangs on the node's minimum
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = clean(large)
        # small star: every neighbour below a node, and the node, hang on the minimum
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low2.select("u", F.col("m").alias("v")))
        cur = materialise(clean(small), "edges")
        sign = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            return cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root") \
                .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sign

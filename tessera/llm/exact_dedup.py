"""Operator 1: exact dedup by a stateful stream.

Rows are staged as (digest, identifier, content locator), without the text,
and a Structured Streaming aggregation keyed by the digest takes them in
micro-batches. Its RocksDB state has no watermark and so never expires: per
digest it retains the smallest identifier, the locator of that row and the
number of rows. The partial aggregation in front of the state merges a hot
group on the map side, so a group of a third of all rows costs one state row
per task. A later ``ingest`` into the same folder goes on from the kept state.

Hits (digests of more than one row) are then checked on full bytes: the texts
of hit rows, found again through their digest, are compared with the text of
the row the state points to. A digest with two different texts is split by
the text itself.

Defined cases: NULL text counts as empty; a NULL identifier sorts after all
others; repeated rows form a group of which one row stays (the first staged);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WS, materialise, work_dir

# disk-backed state; many small stores neither reserve megabytes of disk each
# nor grow the executor's memory together, and go soon after their stream
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
STAGED = "id long, sha string, digest string, uid long, file string"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


class DedupState:
    """Deduplication state in ``root`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, root: str | None = None,
                 digest: Callable[[Column], Column] = sha256,
                 max_bytes_per_batch: int = 32 << 30):
        self.spark, self.digest, self.batch = spark, digest, max_bytes_per_batch
        self.root = root or work_dir(spark, "dedup")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Stage ``docs`` and run the stream over everything not yet seen."""
        norm = normalise(F.col(text_col))
        sha = sha256(norm)
        (docs.select(F.col(id_col).cast("long").alias("id"), sha.alias("sha"),
                     (sha if self.digest is sha256 else self.digest(norm)).alias("digest"),
                     F.monotonically_increasing_id().alias("uid"), F.input_file_name().alias("file"))
         .write.mode("append").parquet(f"{self.root}/staged"))
        old = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            rows = (self.spark.readStream.schema(STAGED).option("maxBytesPerTrigger", str(self.batch))
                    .parquet(f"{self.root}/staged"))
            (rows.groupBy("digest")
             .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "uid")).alias("first"),
                  F.count(F.lit(1)).alias("n"))
             .writeStream.outputMode("update").format("noop")
             .option("checkpointLocation", f"{self.root}/stream")
             .trigger(availableNow=True).start().awaitTermination())
        finally:
            for k, v in old.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def staged(self) -> DataFrame:
        return self.spark.read.schema(STAGED).parquet(f"{self.root}/staged")

    def state(self) -> DataFrame:
        """(digest, first, n): the stream's keyed state after its last batch."""
        s = self.spark.read.format("statestore").load(f"{self.root}/stream")
        value = s.schema["value"].dataType.names
        return s.select("key.digest", F.col(f"value.`{value[0]}`").alias("first"),
                        F.col(f"value.`{value[1]}`").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                root: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``, ``locator`` (file of the row that stays)."""
    spark = docs.sparkSession
    book = DedupState(spark, root, digest)
    book.ingest(docs, id_col, text_col)
    state = materialise(book.state(), "dedup-state")

    # full bytes of hits against the row the state keeps
    hits = state.where("n > 1").select("digest", F.col("first.id").alias("keep"))
    norm = normalise(F.col(text_col))
    texts = materialise(
        docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"), digest(norm).alias("digest"))
        .join(hits, "digest"), "dedup-hits")
    # written before and after, so that nothing but the join needs a digest's rows
    # together, and those of a hot digest can be split
    first = materialise(texts.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("digest")
                        .agg(F.min("norm").alias("held")), "dedup-held")
    mixed = materialise(texts.join(first, "digest").where("norm <> held").select("digest"), "dedup-mixed").distinct()

    plain = (book.staged().join(mixed, "digest", "left_anti").join(state, "digest")
             .select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"),
                     F.col("n").alias("group_size"),
                     ((F.col("uid") == F.col("first.uid")) & (F.col("file") == F.col("first.file"))
                      & F.col("id").eqNullSafe(F.col("first.id"))).alias("kept"),
                     F.col("sha").alias("text_sha256"), F.col("first.file").alias("locator")))
    # digests that two texts share: by the text
    rows = texts.join(mixed, "digest", "left_semi").withColumn("uid", F.monotonically_increasing_id())
    rows = materialise(rows, "dedup-split")
    g = rows.groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first"),
        F.count(F.lit(1)).alias("n"))
    split = rows.join(g, ["digest", "norm"]).select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("first.uid")).alias("kept"), sha256(F.col("norm")).alias("text_sha256"),
        F.lit(None).cast("string").alias("locator"))
    return plain.unionByName(split)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Whole rows travel
    once, to the state of their digest; the byte check moves hits only."""
    book = DedupState(docs.sparkSession)
    book.ingest(docs, id_col, text_col)
    state = materialise(book.state(), "dedup-state")
    rid, norm = F.col(id_col).cast("long"), normalise(F.col(text_col))
    rows = materialise(docs.withColumn("__digest", sha256(norm)).join(
        state.select(F.col("digest").alias("__digest"), F.col("first.id").alias("__first"), F.col("n").alias("__n")),
        "__digest"), "dedup-rows")
    is_first = rid.eqNullSafe(F.col("__first"))

    hits = rows.where("__n > 1").select("__digest", norm.alias("norm"), is_first.alias("is_first"))
    held = materialise(hits.where("is_first").groupBy("__digest").agg(F.min("norm").alias("held")), "dedup-held")
    mixed = materialise(hits.join(held, "__digest").where("norm <> held").select("__digest"), "dedup-mixed").distinct()
    # rows that repeat the identifier of the row that stays: one of them stays
    again = materialise(rows.where(is_first & (F.col("__n") > 1)).groupBy("__digest").count().where("count > 1")
                        .select("__digest"), "dedup-again")
    whole = rows.where(is_first).join(mixed, "__digest", "left_anti")
    split = rows.join(mixed, "__digest", "left_semi").withColumn("__rank", F.row_number().over(
        Window.partitionBy("__digest", norm).orderBy(rid.asc_nulls_last()))).where("__rank = 1")
    parts = [whole.join(again, "__digest", "left_anti"),
             whole.join(again, "__digest", "left_semi").dropDuplicates(["__digest"]), split]
    return reduce(DataFrame.unionByName, [p.select(*docs.columns) for p in parts])

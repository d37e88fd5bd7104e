"""Scans, sources and sinks.

Everything is read with an explicit schema or from Parquet (projection and
filters reach the scan), and written under a shared folder: by default the
reliable checkpoint folder the session names (``spark.checkpoint.dir``),
never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the session's shared folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "tessera", *parts])


def train_test(train: DataFrame, test: DataFrame, split: str = "split") -> DataFrame:
    """Tag the split and concatenate by column name; columns missing on
    one side (the test label) become NULL."""
    return (train.withColumn(split, F.lit("train"))
            .unionByName(test.withColumn(split, F.lit("test")), allowMissingColumns=True))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, usecols: Sequence[str] | None = None,
                   nrows: int | None = None, header: bool = True, **options) -> DataFrame:
    """CSV with an explicit schema (no inference pass), a column subset
    (pruned at the scan) and an optional first-``nrows`` cap."""
    df = spark.read.schema(schema).option("header", str(header).lower()).options(**options).csv(path)
    if usecols is not None:
        df = df.select(*usecols)
    if nrows is not None:
        df = df.limit(nrows)
    return df


def write_csv(df: DataFrame, path: str, **options) -> str:
    df.write.mode("overwrite").option("header", "true").options(**options).csv(path)
    return path


class FeatureStore:
    """One Parquet dataset per feature set, keyed by the row id,
    partitioned by split. Assembly is an equi-join on the id (never by row
    position)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or shared_path(spark, "feature_store", uuid.uuid4().hex)).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame, split: str | None = "split") -> str:
        w = df.write.mode("overwrite")
        if split and split in df.columns:
            w = w.partitionBy(split)
        w.parquet(self.path(name))
        return self.path(name)

    def write_bucketed(self, name: str, df: DataFrame, id_col: str, buckets: int) -> str:
        """As a table bucketed and sorted by the row id: ``assemble_bucketed``
        joins such sets without an exchange. ``name`` is a catalog table."""
        (df.repartition(buckets, id_col).write.mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col)
         .option("path", self.path(name)).saveAsTable(name))
        return self.path(name)

    def assemble_bucketed(self, base: str, names: Sequence[str], id_col: str) -> DataFrame:
        out = self.spark.table(base)
        for n in names:
            out = out.join(self.spark.table(n), id_col, "left")
        return out

    def read(self, name: str, split_value: str | None = None, split: str = "split") -> DataFrame:
        d = self.spark.read.parquet(self.path(name))
        if split_value is not None:
            d = d.where(F.col(split) == split_value)   # partition pruning
        return d

    def assemble(self, base: DataFrame, names: Sequence[str], id_col: str, split: str = "split") -> DataFrame:
        out = base
        for n in names:
            feats = self.read(n)
            feats = feats.drop(split) if split in feats.columns else feats
            out = out.join(feats, id_col, "left")
        return out


def append_by_id(base: DataFrame, extra: DataFrame, id_col: str, check: bool = True) -> DataFrame:
    """Inner-join external features on the id and verify that no row is
    lost (every id of ``base`` is in ``extra``) or duplicated (once)."""
    if check:
        twice = extra.groupBy(id_col).count().where("count > 1").join(base, id_col, "left_semi").limit(1).collect()
        if twice:
            raise ValueError(f"append by {id_col}: {twice[0][id_col]} occurs {twice[0]['count']} times")
        lost = base.join(extra, id_col, "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"append by {id_col}: {lost[0][id_col]} has no row to append")
    return base.join(extra, id_col, "inner")


def append_metrics(spark: SparkSession, path: str, rows: Sequence[Mapping]) -> DataFrame:
    """Append run rows (params as JSON, metrics) to a Parquet report."""
    import json
    recs = [(str(r["run"]), json.dumps(r.get("params", {}), sort_keys=True), str(r["metric"]), float(r["value"]))
            for r in rows]
    df = spark.createDataFrame(recs, "run string, params string, metric string, value double")
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)

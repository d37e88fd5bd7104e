"""Operator 6: mixing sources to target weights, in DataFrame operations only.

Targets: sources in code point order (NULL last) weigh 5, 2, 1, 5, ... and
share all words; a target stops at ``cap`` times its source's size and the
excess is shared again by weight until none is above. Each round is one
aggregate over the table of sources; only totals reach the driver.

Draw: every document gets a hash-random key (md5 of its id and the seed). The
keys are uniform, so cutting the key range of a source into equal slices, one
per ``slice_rows`` documents, gives even slices without sampling. Words are
summed along the key inside each slice, slice totals are summed along the
slices, and together they are the distributed prefix sum of the source. A
target of e full passes and a rest takes every document e times, and once
more the documents whose prefix lies within the rest; the document on the
edge is cut at the exact word.

Defined cases: NULL text has size 0; a NULL source is a source of its own; a
source without words gets target 0; equal keys (repeated rows) are ordered by
id, then size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, n_words

WEIGHTS = (5, 2, 1)


def random_key(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``rows`` to the same with ``target``.
    ``sizes`` has one row per source."""
    # code point rank without one task for all sources: sort by range, number
    # inside the partitions, add the rows of the partitions before
    ranged = (sizes.repartitionByRange(F.col("source").asc_nulls_last())
              .withColumn("part", F.spark_partition_id()))
    ranged = materialise(ranged, "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    shift = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select(
        "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    local = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    rank = ranged.withColumn("pos", F.row_number().over(local) - 1).join(shift, "part")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.col("pos") + F.col("shift")) % len(weights) + 1).cast("int"))
    s = materialise(rank.select("source", "source_size", "rows", weight.alias("w"),
                                (F.col("source_size") * cap).alias("cap")), "mix-weights")
    total, weight_sum = s.agg(F.sum("source_size"), F.sum("w")).first()
    left, share = total or 0, weight_sum or 0
    full = F.lit(False)
    while share:
        # sources at their cap under the present share of one unit of weight
        unit = float(left) / float(share)
        full = F.col("w") * F.lit(unit) > F.col("cap")
        capped, w = s.where(full).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if (total - capped, weight_sum - w) == (left, share):
            break
        left, share = total - capped, weight_sum - w
    unit = float(left) / float(share) if share else 0.0
    return s.select("source", "source_size", "rows",
                    F.when(full, F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(unit)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 6, slice_rows: int = 5_000) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``source``."""
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                                   n_words(F.col(text_col)).alias("size"),
                                   random_key(F.col(id_col), seed).alias("key")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = materialise(source_targets(sizes, weights, cap), "mix-targets").withColumnRenamed("source", "src")
    frac = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    cut = rows.join(targets, F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn(
        "slice", F.floor(frac * F.ceil(F.col("rows") / slice_rows)))
    along = Window.partitionBy("source", "slice").orderBy(F.col("key"), F.col("doc_id"), F.col("size")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("upto", F.sum("size").over(along))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.join(targets, F.col("source").eqNullSafe(F.col("src"))).groupBy(
        "source", F.floor(frac * F.ceil(F.col("rows") / slice_rows)).alias("slice")).agg(F.sum("size").alias("words"))
    slices = slices.select(F.col("source").alias("src"), F.col("slice").alias("sl"),
                           F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    out = cut.join(slices, F.col("source").eqNullSafe(F.col("src")) & (F.col("slice") == F.col("sl")))
    budget = F.floor("target").cast("long")
    size = F.when(F.col("source_size") > 0, F.col("source_size"))
    epochs = F.coalesce(F.floor(budget / size), F.lit(0))
    rest = budget - epochs * F.col("source_size")
    start = F.col("offset") + F.col("upto") - F.col("size")
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return out.select("doc_id", "size", "source_size", "target",
                      (epochs * F.col("size") + once_more).cast("long").alias("taken"), "source")

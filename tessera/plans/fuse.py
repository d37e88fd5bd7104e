"""Fusion of many group features into few shuffles.

A feature that aggregates over a key set is an ``AggPart``: aggregate
expressions for ``groupBy(keys)`` plus a ``post`` expression evaluated on the
joined row. Parts are bucketed by (source, keys): each bucket is ONE
aggregate (partial + final hash aggregate, one exchange of already-combined
rows) and ONE left join back to the rows. Several key sets over the same
source share ONE ``groupingSets`` pass (one scan of the source), persisted
(already aggregated, so small) and read by every key set. The joined side is
one row per key; AQE turns the join into a broadcast when the measured side is
small and splits a skewed key of the row side otherwise. Joins keep Spark's
default of partitioning on the full key set: co-partitioning on a shorter,
low-cardinality prefix would funnel the rows into a few tasks.

``post`` expressions run after all joins, so a feature may combine
aggregates of several key sets (count ratios).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark import StorageLevel


@dataclass
class AggPart:
    name: str                       # output feature column
    keys: tuple[str, ...]
    aggs: list[Column]              # aliased aggregate expressions
    post: Column                    # final value on the joined row
    source: DataFrame | None = None  # None: aggregate the rows themselves
    frame: DataFrame | None = None   # multi-level: a ready table keyed by ``keys``
    helpers: list[str] = field(default_factory=list)  # columns to drop at the end


def _bucket_key(p: AggPart):
    src = id(p.source) if p.source is not None else 0
    frm = id(p.frame) if p.frame is not None else 0
    return (src, frm, tuple(p.keys))


def _has_distinct(cols) -> bool:
    return any("DISTINCT" in str(c).upper() for c in cols)


def _grouping_sets_tables(source: DataFrame, buckets: list[tuple[tuple[str, ...], list[AggPart]]]) -> dict:
    """Several key sets over the same rows: ONE ``groupingSets`` aggregate
    (one scan, one exchange of partially aggregated rows) instead of one
    aggregate (and one scan) per key set. ``grouping_id`` tells the sets
    apart, so NULL keys of the data stay distinct from rolled-up columns."""
    allkeys: list[str] = []
    for keys, _ in buckets:
        for k in keys:
            if k not in allkeys:
                allkeys.append(k)
    aggs = [a for _, ps in buckets for p in ps for a in p.aggs]
    sets = [[F.col(k) for k in keys] for keys, _ in buckets]
    g = source.groupingSets(sets, *[F.col(k) for k in allkeys]).agg(*aggs, F.grouping_id().alias("_gid"))
    # computed once: every key set reads the same (already aggregated) rows;
    # without this each branch is pruned differently and re-scans the source.
    # A lost block is recomputed from the (deterministic) aggregate.
    g = g.persist(StorageLevel.MEMORY_AND_DISK)
    n = len(allkeys)
    out = {}
    for keys, ps in buckets:
        gid = sum(1 << (n - 1 - i) for i, k in enumerate(allkeys) if k not in keys)
        names = source.groupBy(*keys).agg(*[a for p in ps for a in p.aggs]).columns[len(keys):]  # analysis only
        out[tuple(keys)] = g.where(F.col("_gid") == gid).select(*keys, *names)
    return out


def apply_parts(df: DataFrame, parts: Sequence[AggPart], grouping_sets: bool = False) -> DataFrame:
    """Append every part's feature column to ``df`` (row grain preserved).

    ``grouping_sets`` computes all key sets of a source in one grouping-sets
    pass: one scan instead of one per key set, at the price of one copy of
    each row per key set before the partial aggregate. The caller chooses;
    the plan does not depend on the size of the data."""
    names = [p.name for p in parts]
    if len(set(names)) < len(names):
        raise ValueError(f"feature names occur twice: {sorted({n for n in names if names.count(n) > 1})}")
    buckets: dict = {}
    for p in parts:
        buckets.setdefault(_bucket_key(p), []).append(p)
    # key sets over the same source with plain aggregates share one grouping-sets pass
    fused_tables: dict = {}
    if grouping_sets:
        by_source: dict = {}
        for (src, frm, keys), ps in buckets.items():
            if frm or _has_distinct([a for p in ps for a in p.aggs]) or not any(p.aggs for p in ps):
                continue
            by_source.setdefault(src, []).append((keys, ps))
        for src, bl in by_source.items():
            if len(bl) < 2:
                continue
            source = bl[0][1][0].source if bl[0][1][0].source is not None else df
            for keys, t in _grouping_sets_tables(source, bl).items():
                fused_tables[(src, keys)] = t
    out = df
    helpers: list[str] = []
    for (src, frm, keys), ps in sorted(buckets.items(), key=lambda kv: (len(kv[0][2]), kv[0][2])):
        if frm:
            table = ps[0].frame
        elif (src, keys) in fused_tables:
            table = fused_tables[(src, keys)]
        else:
            source = ps[0].source if ps[0].source is not None else df
            aggs = [a for p in ps for a in p.aggs]
            table = source.groupBy(*keys).agg(*aggs)
        # drop names already present (a re-used aggregate) to keep joins unambiguous
        new_cols = [c for c in table.columns if c not in keys and c not in out.columns]
        table = table.select(*keys, *new_cols)
        helpers += new_cols
        out = out.join(table, list(keys), "left")
    posts = {p.name: p.post for p in parts}
    keep = [c for c in out.columns if c not in helpers and c not in posts]
    out = out.select(*keep, *[v.alias(k) for k, v in posts.items()])
    return out


def agg_alias(name: str, what: str) -> str:
    return f"_{what}__{name}"

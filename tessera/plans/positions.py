"""Positions, running sums and lead/lag inside ordered key groups, without a
one-task-per-key window.

``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task;
if one key holds a third of the table, that task holds a third of the table.

Here every key group is cut into contiguous slices of its order, whatever its
size. The cuts are rows of the group itself: a row is a cut if a hash of its
key and its whole order tuple falls into a fixed residue class, which picks one
row in ``chunk_rows / 8``. So slices follow the distribution of the data
(outliers, ties in the leading columns and long common prefixes do not matter:
cuts compare the whole tuple, NULLs first and NaN last like the window does),
a slice has ``chunk_rows / 8`` rows on average and more than ``chunk_rows`` with
probability e^-8, and small groups mostly have no cut at all.

A row finds its slice by binary search in the sorted cuts of its key and is
dealt by ``(keys, slice)``, once. One window over that exchange numbers the
rows locally, keeps running sums and takes leads/lags. The same exchange is
read a second time by an aggregate per slice (both readers ask for the same
columns, so Spark keeps one exchange and runs its input once): size, sums and
the first and last ``|n|`` rows of every slice of a group with cuts. From these
one small table has, per slice, what lies outside of it: the rows and sums
before it, the rows of the whole group, the next ``n`` and the previous ``n``
values across any number of short slices. Every row joins its slice's entry.

So the input is read twice, whatever the leads and sums: for the cuts (keys and
order only) and for the rows. Select the columns you need before: all that are
passed are dealt.

The cuts and the slice table have one entry (with ``|n|`` values for leads) per
``chunk_rows / 8`` rows: 4 million for 10^12 rows at the default, which is what
bounds their broadcast; a larger ``tessera.positions.chunkRows`` shrinks them.

There is one algorithm at every size, nothing runs while the query is built,
and everything is a deterministic function of the data (no partition ids), so
a lost executor recomputes the same slices and every branch agrees on them.
With no keys this is the distributed global rank (H02).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

CHUNK_ROWS_CONF = "tessera.positions.chunkRows"
DEFAULT_CHUNK_ROWS = 2_000_000
# slices per chunk_rows rows on average
SLICES = 8


def _on(left: str, right: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return cond


def chunk_rows(spark) -> int:
    return int(spark.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))


def with_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_chunk: int,
                descending: bool = False, at: Mapping[str, tuple[Column, bool]] | None = None) -> DataFrame:
    """``df`` with ``_chunk`` (slice number along the order) and ``_hot`` (does
    the key group have cuts). ``at`` adds, by name, the slice in which a value
    of the first order column falls: after all rows below it, or (True) after
    all rows up to it."""
    mean = max(1, rows_per_chunk // SLICES)
    tuple_ = F.struct(*[F.col(o) for o in order])
    cuts = (df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(mean)) == 0)
            .groupBy(*keys).agg(F.sort_array(F.collect_set(tuple_)).alias("_cuts")))
    j = df.alias("_b").join(F.broadcast(cuts).alias("_h"), _on("_b", "_h", keys), "left")
    n = F.size("_h._cuts")

    def below(passes) -> Column:
        """Number of leading cuts that pass, bit by bit from the highest."""
        return F.aggregate(
            F.transform(F.sequence(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(0)), lambda b: F.pow(F.lit(2), b).cast("int")),
            F.lit(0), lambda k, step: F.when(
                (k + step <= n) & passes(F.get(F.col("_h._cuts"), k + step - 1)), k + step).otherwise(k))

    mine = F.struct(*[F.col(f"_b.{o}") for o in order])
    own = below(lambda cut: cut <= mine)
    extra = []
    for name, (value, up_to) in (at or {}).items():
        x = F.struct(value.alias(order[0]))
        where = below(lambda cut, x=x, u=up_to: (F.struct(cut[order[0]]) <= x) if u else (F.struct(cut[order[0]]) < x))
        extra.append(F.when(F.col("_h._cuts").isNotNull(), where).otherwise(F.lit(0)).cast("long").alias(name))
    chunk = F.when(F.col("_h._cuts").isNotNull(), (n - own) if descending else own).otherwise(F.lit(0))
    return j.select("_b.*", chunk.cast("long").alias("_chunk"), F.col("_h._cuts").isNotNull().alias("_hot"), *extra)


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   sums: Sequence[str] = (), pos: str = "_pos", total: str | None = "_n",
                   leads: Mapping[str, tuple[str, int]] | None = None,
                   rows_per_chunk: int | None = None, descending: bool = False,
                   sum_totals: bool = False) -> DataFrame:
    """Add ``pos`` (0-based rank of the row inside its key group by ``order``),
    ``total`` (rows in the group), ``_cum_<c>`` (inclusive running sum of each
    column in ``sums``; with ``sum_totals`` also ``_all_<c>``, the sum over the
    group) and, for each ``name -> (column, n)`` in ``leads``, the
    value of ``column`` at position ``pos + n`` of the same group (NULL if
    none; n < 0 looks back).

    ``order`` lists column names sorted ascending (NULLs first), or all
    descending (NULLs last) with ``descending=True``; it must be a total order
    (end it with a unique id). ``keys`` are column names; rows with NULL keys
    form their own group, callers NULL their features out if needed.
    """
    keys = list(keys)
    leads = dict(leads or {})
    if leads and descending:
        raise ValueError("leads need an ascending order")
    out_cols = list(df.columns)
    if not keys:
        # whole table = one group; a constant key keeps every join an equi-join
        df = df.withColumn("_g", F.lit(0))
        keys = ["_g"]
    kcols = [F.col(k) for k in keys]
    ocols = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    b = with_slices(df, keys, order, rows_per_chunk or chunk_rows(df.sparkSession), descending)
    dealt = b.repartition(*kcols, F.col("_chunk"))
    # zero, but needs every column: keeps the exchange of both readers the same
    same = F.xxhash64(*[F.col(f.name) for f in b.schema if "map<" not in f.dataType.simpleString()]).bitwiseAND(F.lit(0))

    # --- first reader: one window over (keys, slice) -----------------------
    w = Window.partitionBy(*kcols, F.col("_chunk")).orderBy(*ocols)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grp = Window.partitionBy(*kcols, F.col("_chunk"))
    local = [(F.row_number().over(w) - 1).alias("_lpos")]
    if total or leads:
        local.append(F.count(F.lit(1)).over(grp).alias("_lcnt"))
    loc = dealt.select("*", *local)
    mine = [F.sum(c).over(run).alias(f"_lcum_{c}") for c in sums]
    mine += [F.sum(c).over(grp).alias(f"_lall_{c}") for c in sums if sum_totals]
    mine += [(F.lead(c, n) if n > 0 else F.lag(c, -n)).over(w).alias(f"_ll_{name}") for name, (c, n) in leads.items()]
    rows = loc.select("*", same.alias("_same"), *mine).alias("_r")

    # --- second reader: what every slice of a group with cuts holds --------
    values = sorted({c for c, _ in leads.values()})
    ahead, back = max([0, *(n for _, n in leads.values())]), max([0, *(-n for _, n in leads.values())])
    entry = F.struct("_lpos", *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    edge = [F.collect_list(F.when(F.col("_hot") & (F.col("_lpos") < ahead), entry)).alias("_head")] if ahead else []
    edge += [F.collect_list(F.when(F.col("_hot") & (F.col("_lpos") >= F.col("_lcnt") - back), entry)).alias("_tail")] if back else []
    slices = (loc if leads else dealt).groupBy(*kcols, "_chunk").agg(
        F.count(F.lit(1)).alias("_csz"), *[F.sum(c).alias(f"_csum_{c}") for c in sums], F.max("_hot").alias("_cut"),
        F.max(same).alias("_same"), *edge).where("_cut")

    # --- what lies outside of a slice: a window over the slices of a key ---
    wk = Window.partitionBy(*kcols).orderBy("_chunk")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    outside = [(F.coalesce(F.sum("_csz").over(before), F.lit(0)) + F.col("_same")).alias("_off"),
               F.sum("_csz").over(Window.partitionBy(*kcols)).alias("_tot"),
               *[F.sum(f"_csum_{c}").over(before).alias(f"_coff_{c}") for c in sums],
               *[F.sum(f"_csum_{c}").over(Window.partitionBy(*kcols)).alias(f"_call_{c}") for c in sums if sum_totals]]
    if ahead:  # every slice has a row, so the next ``ahead`` slices have enough
        near = F.flatten(F.collect_list(F.array_sort("_head")).over(wk.rowsBetween(1, ahead)))
        outside.append(F.slice(near, 1, ahead).alias("_after"))
    if back:
        outside.append(F.flatten(F.collect_list(F.array_sort("_tail")).over(wk.rowsBetween(-back, -1))).alias("_before"))
    o = F.broadcast(slices.select(*keys, "_chunk", *outside)).alias("_o")

    j = rows.join(o, _on("_r", "_o", keys + ["_chunk"]), "left")
    lpos = F.col("_r._lpos")
    cols = [F.col(f"_r.{c}") for c in out_cols]
    cols.append((lpos + F.coalesce(F.col("_o._off"), F.lit(0)) + F.col("_r._same")).alias(pos))
    if total:
        cols.append(F.coalesce(F.col("_o._tot"), F.col("_r._lcnt")).alias(total))
    for c in sums:
        # a slice without a value yet goes on with the sum of the slices before
        here, earlier = F.col(f"_r._lcum_{c}"), F.col(f"_o._coff_{c}")
        cols.append(F.coalesce(here + earlier, here, earlier).alias(f"_cum_{c}"))
        if sum_totals:
            cols.append(F.coalesce(F.col(f"_o._call_{c}"), F.col(f"_r._lall_{c}")).alias(f"_all_{c}"))
    for name, (c, n) in leads.items():
        at = (lpos + n).cast("int")
        far = (F.get(F.col("_o._after"), at - F.col("_r._lcnt").cast("int")) if n > 0
               else F.get(F.col("_o._before"), F.size("_o._before") + at))
        outside_slice = at >= F.col("_r._lcnt") if n > 0 else at < 0
        cols.append(F.when(outside_slice, far[f"v{values.index(c)}"]).otherwise(F.col(f"_r._ll_{name}")).alias(name))
    return j.select(*cols)


def global_rank(df: DataFrame, order: Sequence[str], pos: str = "_rank",
                total: str | None = "_n", descending: bool = False) -> DataFrame:
    """0-based rank of every row over the whole table, computed in
    slices (never a single-task window)."""
    return with_positions(df, [], order, pos=pos, total=total, descending=descending)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, **aggs: Column) -> DataFrame:
    """One row per different ``value`` of a key group: ``_cnt`` rows hold it,
    ``_upto`` hold it or a smaller one, ``_rows`` are in the group, and
    ``aggs`` (by name) over the rows that hold it. The rows are counted with
    partial aggregation and only the different values are ordered, so ties,
    however many, cost one row. Ranks, quantiles, AUC and every other score of
    (value, label) follow from these. The counts are written once: they are
    read for the cuts, the rows and the slices."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"), *[a.alias(n) for n, a in aggs.items()])
    counts = written(counts, "value-counts")
    ranked = with_positions(counts, keys, [value], sums=["_cnt"], pos="_nth", total=None, sum_totals=True)
    return ranked.select(*keys, value, "_cnt", *aggs, F.col("_cum__cnt").alias("_upto"), F.col("_all__cnt").alias("_rows"))


def average_rank() -> Column:
    """1-based rank of a row of ``value_ranks``, ties sharing the mean."""
    return F.col("_upto") - (F.col("_cnt") - 1) / 2

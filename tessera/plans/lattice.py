"""Aggregate lattice: many key sets of one table from its finest ones.

F15 asks for counts, moments and distinct counts over every combination of
columns. A coarser key set is the sum of a finer one, so only the maximal key
sets are aggregated from the rows, all in one grouping-sets pass (one scan,
one exchange of partially aggregated rows), and written. Every other set is
derived from its smallest superset, a table that is already aggregated:

* counts add up;
* moments add up as (n, mean, squared deviations) shifted to a common centre;
* distinct values of a column are the rows of the set with that column;
* the spread of counts (F05) is a second aggregate over the finer set.

Features of a coarse set are joined to the table of one maximal set that holds
its keys, at the grain of that table. The rows meet the maximal tables only: one
join per maximal set, not one per feature set. NULL keys keep their meaning: a
row with a NULL among a feature's keys gets NULL, and still finds its other
features (the joins of the rows are NULL-safe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import all_not_null, safe_div
from tessera.session import written
from tessera.spec import FeatureSpec

Keys = tuple[str, ...]
FUNCTIONS = ("count", "unique_count", "unique_count_ratio", "variance", "mean", "sum", "count_std_over_mean", "count_ratio")


def _needs(s: FeatureSpec) -> list[Keys]:
    """Key sets whose tables a spec reads; the first is the set of the feature."""
    cols = tuple(s.cols)
    if s.function == "count":
        return [cols]
    if s.function == "count_ratio":
        return [cols, cols[:-1]]
    if s.function in ("unique_count", "unique_count_ratio", "count_std_over_mean"):
        return [cols[:-1], cols]
    return [cols[:-1]]


class Lattice:
    def __init__(self, df: DataFrame, specs: Sequence[FeatureSpec]):
        unknown = {s.function for s in specs} - set(FUNCTIONS)
        if unknown:
            raise ValueError(f"no lattice form for {sorted(unknown)}")
        self.df, self.specs = df, list(specs)
        order = {c: i for i, c in enumerate(df.columns)}
        self.sets = {self._sorted(k, order) for s in specs for k in _needs(s)}
        self.order = order
        self.maximal = sorted(k for k in self.sets if not any(set(k) < set(o) for o in self.sets))
        self.dummies = sorted({s.p["dummy"] for s in specs if s.p.get("dummy")})
        self.values = sorted({s.cols[-1] for s in specs if s.function in ("variance", "mean", "sum")})
        self.centre: dict[str, float] = {}
        self._tables: dict[Keys, DataFrame] = {}
        self._finest()

    @staticmethod
    def _sorted(keys: Sequence[str], order: dict[str, int]) -> Keys:
        return tuple(sorted(keys, key=order.__getitem__))

    def _finest(self) -> None:
        """One pass over the rows for all maximal sets."""
        keys = sorted({c for k in self.maximal for c in k}, key=self.order.__getitem__)
        aggs = [F.count(F.lit(1)).alias("_n"), *[F.count(d).alias(f"_n_{d}") for d in self.dummies]]
        for v in self.values:
            x = F.col(v).cast("double")
            aggs += [F.count(x).alias(f"_c_{v}"), F.avg(x).alias(f"_m_{v}"), (F.var_pop(x) * F.count(x)).alias(f"_q_{v}")]
        rows = self.df.select(*dict.fromkeys([*keys, *self.dummies, *self.values]))
        # key columns apart from measured ones: a grouping set blanks its absent keys
        rows = rows.select("*", *[F.col(c).alias(f"_k_{c}") for c in keys])
        sets = [[F.col(f"_k_{c}") for c in k] for k in self.maximal]
        table = rows.groupingSets(sets, *[F.col(f"_k_{c}") for c in keys]).agg(*aggs, F.grouping_id().alias("_gid"))
        table = written(table, "lattice")
        if self.values:
            first = self._of(table, self.maximal[0], keys)
            got = first.agg(*[(F.sum(F.col(f"_c_{v}") * F.col(f"_m_{v}")) / F.sum(f"_c_{v}")).alias(v) for v in self.values]).first()
            self.centre = {v: got[v] or 0.0 for v in self.values}
        for k in self.maximal:
            t = self._of(table, k, keys)
            shifted = []
            for v in self.values:
                d = F.coalesce(F.col(f"_m_{v}") - F.lit(self.centre[v]), F.lit(0.0))
                n, q = F.col(f"_c_{v}"), F.coalesce(F.col(f"_q_{v}"), F.lit(0.0))
                shifted += [(n * d).alias(f"_s_{v}"), (q + n * d * d).alias(f"_t_{v}")]
            self._tables[k] = t.select(*k, "_n", *[f"_n_{d}" for d in self.dummies], *[f"_c_{v}" for v in self.values], *shifted)

    def _of(self, table: DataFrame, k: Keys, keys: list[str]) -> DataFrame:
        gid = sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in k)
        return table.where(F.col("_gid") == gid).withColumnsRenamed({f"_k_{c}": c for c in k})

    def table(self, keys: Sequence[str]) -> DataFrame:
        """The states of a key set, from its smallest superset."""
        k = self._sorted(keys, self.order)
        if k not in self._tables:
            parent = min((o for o in self.sets if set(k) < set(o)), key=lambda o: (len(o), o))
            states = ["_n", *[f"_n_{d}" for d in self.dummies], *[f"_{a}_{v}" for v in self.values for a in "cst"]]
            self._tables[k] = self.table(parent).groupBy(*k).agg(*[F.sum(s).alias(s) for s in states])
        return self._tables[k]

    def _count(self, s: FeatureSpec) -> Column:
        return F.col(f"_n_{s.p['dummy']}") if s.p.get("dummy") else F.col("_n")

    def features(self) -> dict[Keys, DataFrame]:
        """Per key set one table: the keys and the features over them."""
        per: dict[Keys, list[FeatureSpec]] = {}
        for s in self.specs:
            per.setdefault(self._sorted(_needs(s)[0], self.order), []).append(s)
        out = {}
        for k, specs in per.items():
            t, done = self.table(k), []
            for s in specs:
                name, v = s.feature_name, s.cols[-1]
                if s.function == "count":
                    done.append(self._count(s).alias(name))
                elif s.function in ("variance", "mean", "sum"):
                    n, one, two = F.col(f"_c_{v}"), F.col(f"_s_{v}"), F.col(f"_t_{v}")
                    c = F.lit(self.centre[v])
                    value = {"variance": lambda: F.when(n > 1, F.greatest(two - one * one / n, F.lit(0.0)) / (n - 1)).otherwise(F.lit(0.0)),
                             "mean": lambda: F.when(n > 0, c + one / n), "sum": lambda: F.when(n > 0, one + n * c)}[s.function]()
                    done.append(value.alias(name))
                else:
                    t = self._joined(t, k, s)
                    done.append(F.col(name))
            out[k] = t.select(*k, *done)
        return out

    def _joined(self, t: DataFrame, k: Keys, s: FeatureSpec) -> DataFrame:
        """``t`` with a feature that reads a second table."""
        name, cols = s.feature_name, tuple(s.cols)
        if s.function == "count_ratio":
            den = self.table(cols[:-1]).select(*cols[:-1], self._count(s).alias("_den"))
            return t.join(den, list(cols[:-1]), "left").withColumn(name, safe_div(self._count(s), F.col("_den"))).drop("_den")
        fine = self.table(cols)
        if s.function == "count_std_over_mean":
            spread = safe_div(F.stddev_samp("_x"), F.avg("_x"))
            per = fine.withColumn("_x", self._count(s)).groupBy(*k).agg(spread.alias("_v"))
            value = F.coalesce(F.lit(int(float(s.p.get("coefficient", 1)))) * F.col("_v"), F.lit(-1.0))
        else:
            per = fine.groupBy(*k).agg(F.count(cols[-1]).alias("_v"))
            value = F.col("_v") if s.function == "unique_count" else safe_div(F.col("_v"), self._count(s))
        same = F.lit(True)
        per = per.select(*[F.col(c).alias(f"_j_{c}") for c in k], "_v")
        for c in k:
            same = same & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
        return t.join(per, same, "left").withColumn(name, value).drop("_v", *[f"_j_{c}" for c in k])

    def rows(self) -> DataFrame:
        """``df`` with every feature."""
        tables = self.features()
        held: dict[Keys, list[Keys]] = {m: [] for m in self.maximal}
        for k in tables:
            held[min((m for m in self.maximal if set(k) <= set(m)), key=lambda m: (len(m), m))].append(k)
        out = self.df
        for m, sets in held.items():
            if not sets:
                continue
            wide = self.table(m).select(*m)
            names = []
            for k in sorted(sets, key=len):
                f = tables[k]
                names += [c for c in f.columns if c not in k]
                if k == m:  # the features of a set with a NULL key are NULL
                    f = f.select(*k, *[F.when(all_not_null(k), F.col(c)).alias(c) for c in f.columns if c not in k])
                wide = wide.join(f, list(k), "left")
            wide = wide.select(*[F.col(c).alias(f"_j_{c}") for c in m], *names)
            same = F.lit(True)
            for c in m:
                same = same & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
            out = out.join(wide, same, "left").drop(*[f"_j_{c}" for c in m])
        # F05 is -1 wherever it is undefined, a NULL key included
        return out.select(*self.df.columns, *[
            F.coalesce(F.col(s.feature_name), F.lit(-1.0)).alias(s.feature_name) if s.function == "count_std_over_mean"
            else F.col(s.feature_name) for s in self.specs])


def lattice_features(df: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """``df`` with one column per spec (``FUNCTIONS``), aggregated as a lattice."""
    return Lattice(df, specs).rows()

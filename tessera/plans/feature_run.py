"""Feature runs: one list of mixed specs, few passes.

A run takes ``FeatureSpec`` s of any kind, registered functions and the
user's own, and appends one column per spec. The specs are grouped by what
they need from the rows, and every group is one pass:

* ``row`` functions are columns: one projection;
* ``group`` functions (F*) are aggregates: one aggregate and one join per key set;
* ``target`` functions (E*) read the label: one table per key set with the
  counts and label sums of every fold, whatever the statistics asked for, joined
  with the same join as the ``group`` functions where the keys agree;
* ``ordered`` functions (T01-T07, T11) are positions, running sums and leads:
  one pass per key set, sums and leads of all its specs together;
* ``horizon`` functions (T08-T10) are counts in time windows: one pass per key
  set for all horizons;
* ``table`` functions return a table by row id: one join each.

Register a function with ``feature(name, kind)``; what it returns is said at
each kind below. Registered names can be replaced by a later registration.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import null_unless_keys
from tessera.operators import group as G
from tessera.operators.ordered import horizon_counts
from tessera.plans.fuse import AggPart, apply_parts
from tessera.plans.positions import with_positions
from tessera.spec import FeatureSpec

KINDS = ("row", "group", "target", "ordered", "horizon", "table")
REGISTRY: dict[str, tuple[str, Callable]] = {}


@dataclass(frozen=True)
class Run:
    """What the specs of a run share: the row id, the order inside a key
    (ending in the id), a numeric time column, label and fold columns."""

    id: str
    order: tuple[str, ...] = ()
    time: str | None = None
    label: str | None = None
    fold: str | None = None


@dataclass
class Ordered:
    """What an ``ordered`` function returns: the keys, the columns to sum and
    the (column, n) to lead by name, and the value on the finished row: a
    function of ``_pos`` (0-based), ``_n`` (rows of the key), the running sums
    by column and the leads by name."""

    keys: Sequence[str]
    value: Callable[[Mapping[str, Column]], Column]
    sums: Sequence[str] = ()
    leads: Mapping[str, tuple[str, int]] = field(default_factory=dict)


@dataclass
class Target:
    """What a ``target`` function returns: the keys and the value from (rows,
    label sum) of the key without the row's own fold, and of all rows without it."""

    keys: Sequence[str]
    value: Callable[[Column, Column, Column, Column], Column]


def feature(name: str, kind: str) -> Callable[[Callable], Callable]:
    """Register ``f`` under ``name``. Signatures: row ``f(spec, run) -> Column``;
    group ``f(df, spec, run) -> [AggPart]`` (the last named as the spec); target
    ``f(spec, run) -> Target``; ordered ``f(spec, run) -> Ordered``; horizon
    ``f(spec, run) -> (keys, which, n)``; table ``f(df, spec, run) ->
    DataFrame`` of the row id and one column."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")

    def add(f: Callable) -> Callable:
        REGISTRY[name] = (kind, f)
        return f

    return add


for _name, _f in G.GROUP_FUNCTIONS.items():
    REGISTRY[_name] = ("group", lambda df, s, run, f=_f: f(df, s))


@feature("cumulative_count", "ordered")
def _cumulative(s: FeatureSpec, run: Run) -> Ordered:
    return Ordered(s.cols, lambda c: c["_pos"])


@feature("reverse_cumulative_count", "ordered")
def _reverse(s: FeatureSpec, run: Run) -> Ordered:
    return Ordered(s.cols, lambda c: c["_n"] - 1 - c["_pos"])


@feature("time_to_n_next", "ordered")
def _next(s: FeatureSpec, run: Run) -> Ordered:
    """``n`` < 0 looks back; missing -> ``fill``."""
    n, fill = int(s.p.get("n", 1)), s.p.get("fill")
    return Ordered(s.cols, lambda c: F.coalesce(c["next"] - F.col(run.time), F.lit(fill)) if fill is not None
                   else c["next"] - F.col(run.time), leads={"next": (run.time, n)})


@feature("running_mean", "ordered")
def _running(s: FeatureSpec, run: Run) -> Ordered:
    """Mean of the last column over the rows of the key before this one."""
    v = s.cols[-1]
    return Ordered(s.cols[:-1], lambda c: F.try_divide((c[v] - F.col(v)).cast("double"), c["_pos"].cast("double")), sums=[v])


@feature("count_in_previous", "horizon")
def _previous(s: FeatureSpec, run: Run) -> tuple[Sequence[str], str, int]:
    return s.cols, "prev", s.p["n"]


@feature("count_in_next", "horizon")
def _following(s: FeatureSpec, run: Run) -> tuple[Sequence[str], str, int]:
    return s.cols, "next", s.p["n"]


@feature("target_mean", "target")
def _target_mean(s: FeatureSpec, run: Run) -> Target:
    """``smooth`` rows of the overall mean are added to every key."""
    a = float(s.p.get("smooth", 0))
    return Target(s.cols, lambda n, y, alln, ally: F.try_divide(y + F.lit(a) * ally / alln, n + F.lit(a)))


@feature("woe", "target")
def _woe(s: FeatureSpec, run: Run) -> Target:
    """Log of the key's share of positives over its share of negatives."""
    def value(n: Column, y: Column, alln: Column, ally: Column) -> Column:
        return F.when(n > 0, F.log(((y + 0.5) / (ally + 0.5)) / ((n - y + 0.5) / (alln - ally + 0.5))))

    return Target(s.cols, value)


def _target_parts(df: DataFrame, run: Run, specs: Sequence[tuple[FeatureSpec, Target]]) -> list[AggPart]:
    """One table per key set: totals and a map of the folds."""
    y, fold = F.col(run.label).cast("double"), F.col(run.fold)
    labelled = df.where(F.col(run.label).isNotNull() & fold.isNotNull())
    per_fold = labelled.groupBy(fold.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y")).collect()
    every_n, every_y = sum(r["n"] for r in per_fold), sum(r["y"] for r in per_fold)
    # all rows but a fold: a literal per fold
    without = {r["f"]: (every_n - r["n"], every_y - r["y"]) for r in per_fold}

    def rest(i: int) -> Column:
        out = F.lit(float((every_n, every_y)[i]))
        for f, v in without.items():
            out = F.when(fold == F.lit(f), F.lit(float(v[i]))).otherwise(out)
        return out

    frames: dict[tuple[str, ...], DataFrame] = {}
    parts = []
    for s, t in specs:
        keys = tuple(t.keys)
        tag = "_".join(keys)
        if keys not in frames:
            folds = labelled.groupBy(*keys, fold.alias("_f")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y"))
            frames[keys] = folds.groupBy(*keys).agg(
                F.sum("_n").alias(f"_tn__{tag}"), F.sum("_y").alias(f"_ty__{tag}"),
                F.map_from_entries(F.collect_list(F.struct("_f", F.struct("_n", "_y")))).alias(f"_tf__{tag}"))
        own = F.element_at(F.col(f"_tf__{tag}"), fold)
        n = F.col(f"_tn__{tag}") - F.coalesce(own["_n"], F.lit(0))
        pos = F.col(f"_ty__{tag}") - F.coalesce(own["_y"], F.lit(0.0))
        value = F.when(n > 0, t.value(n.cast("double"), pos, rest(0), rest(1)))
        parts.append(AggPart(s.feature_name, keys, [], value, frame=frames[keys]))
    return parts


def build_features(df: DataFrame, specs: Sequence[FeatureSpec], run: Run,
                   functions: Mapping[str, tuple[str, Callable]] | None = None) -> DataFrame:
    """``df`` with one column per spec, in the order of ``specs``.
    ``functions`` adds to (or replaces in) the registry for this run."""
    known = {**REGISTRY, **(functions or {})}
    missing = sorted({s.function for s in specs} - set(known))
    if missing:
        raise ValueError(f"no feature function {missing}")
    names = [s.feature_name for s in specs]
    twice = sorted({n for n in names if names.count(n) > 1 or n in df.columns})
    if twice:
        raise ValueError(f"feature names occur twice: {twice}")
    of = {k: [(s, known[s.function][1]) for s in specs if known[s.function][0] == k] for k in KINDS}

    out = df.select("*", *[f(s, run).alias(s.feature_name) for s, f in of["row"]])
    parts = [p for s, f in of["group"] for p in f(df, s, run)]
    parts += _target_parts(df, run, [(s, f(s, run)) for s, f in of["target"]]) if of["target"] else []
    if parts:
        out = apply_parts(out, parts)
        out = out.drop(*[p.name for p in parts if p.name not in names])

    ordered: dict[tuple[str, ...], list[tuple[FeatureSpec, Ordered]]] = {}
    for s, f in of["ordered"]:
        o = f(s, run)
        ordered.setdefault(tuple(o.keys), []).append((s, o))
    for keys, group in ordered.items():
        sums = sorted({c for _, o in group for c in o.sums})
        wanted = sorted({v for _, o in group for v in o.leads.values()})
        lead = {v: f"_lead{i}" for i, v in enumerate(wanted)}
        have = out.columns
        out = with_positions(out, list(keys), list(run.order), sums=sums, leads={lead[v]: v for v in wanted})
        cols = []
        for s, o in group:
            at = {"_pos": F.col("_pos"), "_n": F.col("_n"), **{c: F.col(f"_cum_{c}") for c in o.sums},
                  **{name: F.col(lead[v]) for name, v in o.leads.items()}}
            cols.append(null_unless_keys(o.value(at), list(keys)).alias(s.feature_name))
        out = out.select(*have, *cols)

    horizons: dict[tuple[str, ...], list[tuple[FeatureSpec, str, int]]] = {}
    for s, f in of["horizon"]:
        keys, which, n = f(s, run)
        horizons.setdefault(tuple(keys), []).append((s, which, n))
    for keys, group in horizons.items():
        have, ns = out.columns, sorted({n for *_, n in group})
        out = horizon_counts(out, list(keys), F.col(run.time), run.id, which=sorted({w for _, w, _ in group}), ns=ns, prefix="_h")
        out = out.select(*have, *[F.col(f"count_{w}_{str(n).replace('.', 'p')}___h").alias(s.feature_name) for s, w, n in group])

    for s, f in of["table"]:
        t = f(df, s, run)
        value = next(c for c in t.columns if c != run.id)
        out = out.join(t.select(run.id, F.col(value).alias(s.feature_name)), run.id, "left")
    return out.select(*df.columns, *names)

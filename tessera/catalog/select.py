"""Registered feature-selection queries (L01-L14) on the modelling frame."""

from __future__ import annotations

import itertools

from tessera.catalog.modeling import EVX, FEATS, evx
from tessera.catalog.registry import register
from tessera.functions.columns import rnd
from tessera.operators import sampling as H
from tessera.operators import select as L

L01_FEATS = FEATS


def _l01_sql():
    pairs = list(itertools.combinations(L01_FEATS, 2))
    aggs = ", ".join(f"corr({a}, {b}) AS c_{a}__{b}" for a, b in pairs)
    parts = []
    for j, fj in enumerate(L01_FEATS):
        prev = [f"abs(c_{fi}__{fj})" for fi in L01_FEATS[:j]]
        if not prev:
            parts.append(f"SELECT '{fj}' AS feature, CAST({j} AS BIGINT) AS position, CAST(NULL AS DOUBLE) AS max_abs_corr, "
                         f"false AS \"drop\" FROM c")
        else:
            g = f"greatest({', '.join(prev)})" if len(prev) > 1 else prev[0]
            parts.append(f"SELECT '{fj}', CAST({j} AS BIGINT), RND({g}), {g} > 0.9 FROM c")
    return f"WITH c AS (SELECT {aggs} FROM {EVX}) " + " UNION ALL ".join(parts)


@register("L01_correlation_cut", sql=_l01_sql())
def l01(spark, sf):
    out = L.correlation_cut(evx(spark, sf), L01_FEATS, 0.9)
    return out.select("feature", "position", rnd("max_abs_corr").alias("max_abs_corr"), "drop")


def _unpivot(expr_tmpl, feats, alias):
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {expr_tmpl.format(f=f)} AS {alias} FROM {EVX}" for f in feats)


@register("L02_target_correlation", sql=f"""
WITH s AS ({_unpivot('abs(corr({f}, y))', FEATS, 'abs_corr')})
SELECT feature, RND(abs_corr) AS abs_corr, row_number() OVER (ORDER BY abs_corr DESC, feature) AS rank FROM s""")
def l02(spark, sf):
    out = L.target_correlation(evx(spark, sf), FEATS, "y")
    return out.select("feature", rnd("abs_corr").alias("abs_corr"), "rank")


_LONG = f"(SELECT event_id, y, unnest(['{chr(39) + ', '.join(FEATS)}']) AS feature FROM {EVX})"


def _long_sql():
    return " UNION ALL ".join(f"SELECT event_id, y, '{f}' AS feature, {f} AS value FROM {EVX}" for f in FEATS)


@register("L03_chi2_top_k", sql=f"""
WITH l AS ({_long_sql()}),
p AS (SELECT feature, sum(CASE WHEN y = 1 THEN value ELSE 0 END) AS o1, sum(CASE WHEN y = 0 THEN value ELSE 0 END) AS o0,
        sum(value) AS tot, avg(CAST(y AS DOUBLE)) AS p1 FROM l GROUP BY feature),
c AS (SELECT feature, (o1 - p1 * tot) * (o1 - p1 * tot) / (p1 * tot) + (o0 - (1 - p1) * tot) * (o0 - (1 - p1) * tot) / ((1 - p1) * tot) AS chi2 FROM p)
SELECT feature, RND(chi2) AS chi2 FROM c ORDER BY chi2 DESC, feature LIMIT 3""")
def l03(spark, sf):
    ev = evx(spark, sf)
    long = L.long_format(ev, "event_id", FEATS, "y").where("value <> 0")  # zeros may be left out
    out = L.top_k(L.chi2_scores(long, "y", ev), "chi2", 3)
    return out.select("feature", rnd("chi2").alias("chi2"))


@register("L04_anova_f_percentile", sql=f"""
WITH l AS ({_long_sql()}),
g AS (SELECT feature, y, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM l GROUP BY ALL),
t AS (SELECT feature, sum(n) AS "N", sum(s) AS "S", sum(ss) AS "SS", count(*) AS k, sum(s * s / n) AS "B" FROM g GROUP BY feature),
f AS (SELECT feature, (("B" - "S" * "S" / "N") / (k - 1)) / (("SS" - "B") / ("N" - k)) AS f FROM t)
SELECT feature, RND(f) AS f, f >= (SELECT quantile_cont(f, 0.1) FROM f) AS keep FROM f""")
def l04(spark, sf):
    ev = evx(spark, sf)
    long = L.long_format(ev, "event_id", FEATS, "y").where("value <> 0")
    out = L.percentile_keep(L.anova_f(long, "y", ev), "f", 90)
    return out.select("feature", rnd("f").alias("f"), "keep")


@register("L05_feature_auc", sql=f"""
WITH l AS ({_long_sql()}),
r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value)
        + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM l),
s AS (SELECT feature, sum(rk) FILTER (WHERE y = 1) AS s, count(*) FILTER (WHERE y = 1) AS n1,
        count(*) FILTER (WHERE y = 0) AS n0 FROM r GROUP BY feature)
SELECT feature, RND((s - n1 * (n1 + 1) / 2.0) / (n1 * n0)) AS auc FROM s""", headline=True)
def l05(spark, sf):
    long = L.long_format(evx(spark, sf), "event_id", FEATS, "y")
    return L.feature_auc(long, "y", "event_id").select("feature", rnd("auc").alias("auc"))


IG_FEATS = ["hr", "k", "day"]


def _h_sql(p, n):
    t = f"(({p}) + ({n}))"
    return (f"(-((1e-10 + ({p})) / {t}) * log2((1e-10 + ({p})) / {t}) - (({n}) / {t}) * log2((1e-10 + ({n})) / {t}))")


@register("L06_information_gain", sql=f"""
WITH l AS ({' UNION ALL '.join(f"SELECT y, '{f}' AS feature, {f} AS value FROM {EVX}" for f in IG_FEATS)}),
tot AS (SELECT CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM {EVX}),
g AS (SELECT feature, value, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS t FROM l GROUP BY ALL)
SELECT feature, RND(any_value({_h_sql('tot.p', 'tot.n - tot.p')}) - sum(g.t / tot.n * {_h_sql('g.p', 'g.t - g.p')}))
  AS info_gain FROM g, tot GROUP BY feature""")
def l06(spark, sf):
    out = L.information_gain(evx(spark, sf), IG_FEATS, "y")
    return out.select("feature", rnd("info_gain").alias("info_gain"))


def _cv_frame(spark, sf, k=3):
    return H.kfold(evx(spark, sf), "event_id", k, seed=42, label="y")


@register("L07_correlation_clusters")
def l07(spark, sf):
    return L.correlation_clusters(evx(spark, sf), FEATS, k=3)


@register("L08_importance_intersection")
def l08(spark, sf):
    return L.importance_intersection(evx(spark, sf), FEATS, "y", top_n=4)


SMALL = ["value", "hr", "user_n", "k_n"]


@register("L08_importance_search")
def l08_search(spark, sf):
    return L.importance_search(_cv_frame(spark, sf), FEATS, "y", "fold", "event_id", 3, top=[3, 5])


@register("L11_forward_rounds")
def l11_rounds(spark, sf):
    return L.forward_rounds(_cv_frame(spark, sf), SMALL, "y", "fold", "event_id", 3, max_rounds=2)


@register("L09_drop_one_report")
def l09(spark, sf):
    return L.drop_one_report(_cv_frame(spark, sf), SMALL, "y", "fold", "event_id", 3)


@register("L10_backward_elimination")
def l10(spark, sf):
    return L.backward_elimination(_cv_frame(spark, sf), SMALL, "y", "fold", "event_id", 3)


@register("L11_forward_selection")
def l11(spark, sf):
    d = _cv_frame(spark, sf)
    return L.forward_selection(d.where("day_i <= 24"), SMALL, "y", "fold", "event_id", 3,
                               holdout=d.where("day_i > 24"))


@register("L12_recursive_elimination")
def l12(spark, sf):
    return L.recursive_elimination(evx(spark, sf), FEATS, "y", n_keep=3)


@register("L13_variance_threshold", sql=f"""
{' UNION ALL '.join(f"SELECT '{f}' AS feature, RND(var_pop({f})) AS variance, var_pop({f}) <= 0.0 AS \"drop\" FROM {EVX}"
                    for f in FEATS + ['one'])}""")
def l13(spark, sf):
    out = L.variance_threshold(evx(spark, sf), FEATS + ["one"], 0.0)
    return out.select("feature", rnd("variance").alias("variance"), "drop")


@register("L14_cumulative_importance", sql=f"""
WITH s AS ({_unpivot('abs(corr({f}, y))', FEATS, 'abs_corr')}),
n AS (SELECT feature, abs_corr, abs_corr / sum(abs_corr) OVER () AS normalized FROM s),
c AS (SELECT *, sum(normalized) OVER (ORDER BY abs_corr DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS cumulative FROM n)
SELECT feature, RND(abs_corr) AS abs_corr, RND(normalized) AS normalized, RND(cumulative) AS cumulative,
  cumulative <= 0.9 AS keep FROM c""")
def l14(spark, sf):
    imp = L.target_correlation(evx(spark, sf), FEATS, "y").select("feature", "abs_corr")
    out = L.cumulative_importance(imp, "feature", "abs_corr", 0.9)
    return out.select("feature", rnd("abs_corr").alias("abs_corr"), rnd("normalized").alias("normalized"),
                      rnd("cumulative").alias("cumulative"), "keep")

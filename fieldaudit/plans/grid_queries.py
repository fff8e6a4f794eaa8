"""Queries on the evaluation grid: probes at two strengths, scored linearly per dataset, and policies against their random controls."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldaudit.operators import grid, metrics, order, probes
from fieldaudit.operators import ledger as L
from fieldaudit.plans.column_queries import rounded
from fieldaudit.plans.panel_queries import _FUTURE, _PLAIN, S, _noise
from fieldaudit.plans.tables import FEATURES, PANEL, melted, melted_sql, panel, u_sql

QUERIES, ORACLE = {}, {}
# Two of the protocol's strengths
STRENGTHS = {"S2": 0.3, "S4": 0.7}
# The kinds of dataset, in turn by number
ARCHETYPES = ("linear", "interaction", "nonlinear", "sparse", "drifting")
SHARE, SEEDS = 0.25, [1, 2, 3]
_PARTS = {"M01": ["m01"], "M02": ["m02"], "M04": ["m04"], "M06": ["m06_0", "m06_1", "m06_2"], "M07": ["m07"], "M09": ["m09_0", "m09_1", "m09_2", "m09_3"], "M10": ["m10_copy", "m10"], "M11": ["m11_0", "m11_1", "m11_2"]}
CELLS = [grid.Cell(m, s, [f"{c}_{s}" for c in own], [f"{c}_{s}" for c in own if c != "m10_copy"], m if len(own) > 1 else None) for m, own in _PARTS.items() for s in STRENGTHS]
ADDED = [c for cell in CELLS for c in cell.columns]


def injected(s, d):
    """The panel with its split and the columns of every cell, each probe rounded to six places.

    Positions, priors and future means are computed once for all strengths, from the panel as packed columns. The columns of the cells are made
    where they are read, from the row alone: they are many times the panel, so they aren't written down, and the sides that are joined are
    small.
    """
    p = order.stored(panel(s, d).select(F.unhex("row_id").alias("row_id"), "dataset_id", "ts", "y", *FEATURES)).withColumn("row_id", F.lower(F.hex("row_id")))
    p = probes.source_places(order.time_split(p), S).select("row_id", "dataset_id", "ts", "split", "y", probes.PLACE, *FEATURES)
    p = probes.loo_prior(p, probes.PRIOR)
    p = probes.future_window(p, F.lit(1), F.greatest(F.lit(2), F.floor(F.col("_n") * 0.05)), "_f", "_k").drop("ts", "_k")
    made = [c for own in _PARTS.values() for c in own]
    p = probes.with_draws(p, S, [*(c for c in made if c[:3] in ("m02", "m04", "m06", "m07", "m11")), "m10"], ["M01", "M07", "M09u"])
    keep, prior, added = p.columns, F.col(probes.PRIOR), []
    simple = (probes.label_copy, probes.noisy_proxy, probes.redundant, probes.subgroup, probes.projections, probes.source_assignment)
    for name, x in STRENGTHS.items():
        p = p.withColumn("m04", prior + F.lit(x) * (F.coalesce("_f", prior) - prior) + probes.noise("m04", S, df=p))
        p = probes.compose(p, *(lambda q, f=f, x=x: f(q, x, S) for f in simple), lambda q, x=x: probes.mixed_group(q, x, S, "x_quantity"))
        p = p.select(*keep, *added, *(F.col(c).cast("double").alias(f"{c}_{name}") for c in made))
        added += [f"{c}_{name}" for c in made]
    # a loop over the columns, as the code for each of them in a row would be too long for the JVM to compile; rounded as the SQL does
    six = F.transform(F.array(*added), lambda v: F.signum(v) * F.floor(F.abs(v) * 1e6 + 0.5) / 1e6)
    p = p.select("row_id", "dataset_id", "split", "y", *FEATURES, six.alias("_six"))
    return p.select("row_id", "dataset_id", "split", "y", *FEATURES, *(F.get("_six", F.lit(added.index(c))).alias(c) for c in ADDED))


def book(s, d):
    """(columns of all cells with weight and score, runs, areas): what the queries below are read from, each computed once. The fit reads the
    train rows and the areas the test rows."""
    rows = injected(s, d)
    fit = grid.fitted(melted(rows.where("split = 'train'"), [*FEATURES, *ADDED], ["dataset_id", "y"]))
    columns = fit.join(F.broadcast(grid.registry(s, FEATURES, CELLS)), "feature_id").checkpoint()
    chosen = grid.selections(columns, SHARE, SEEDS, len(FEATURES)).checkpoint()
    return columns, chosen, grid.areas(rows.where("split = 'test'"), chosen, FEATURES, CELLS, "row_id").checkpoint()


_odds = lambda x, y: [math.exp((3 if y else -3) * x * (-1 + 2 * i / 3)) for i in range(4)]
_named = [sorted(range(4), key=lambda i: (i * 7 + S * 3) % 5).index(i) for i in range(4)]


def _drawn(x, y):
    odds = _odds(x, y)
    return "CASE " + " ".join(f"WHEN u < CAST({sum(odds[: i + 1]) / sum(odds)!r} AS DOUBLE) THEN {i}" for i in range(3)) + " ELSE 3 END"


def _columns_sql(name, x):
    source = f"{_named}[CAST(CASE WHEN k9 <= 20 THEN (k9 - 1) % 4 WHEN y = 1 THEN {_drawn(x, 1)} ELSE {_drawn(x, 0)} END AS INT) + 1]"
    proxy = lambda c, std=probes.NOISE, w=x: f"CAST({w!r} AS DOUBLE) * (y - prior) + {_noise(c, std)}"
    of = {
        "m01": f"CASE WHEN {u_sql(f'''{S}|M01|'''.join(("'", "' || row_id")))} < CAST(0.5 AS DOUBLE) * (1 - CAST({x!r} AS DOUBLE)) THEN 1 - y ELSE y END", "m02": proxy("m02"),
        "m04": f"prior + CAST({x!r} AS DOUBLE) * (coalesce(f, prior) - prior) + {_noise('m04')}", "m10_copy": "x_quantity", "m10": proxy("m10"),
        "m07": f"CASE WHEN {u_sql(f'''{S}|M07|'''.join(("'", "' || row_id")))} < 0.3 THEN {proxy('m07')} ELSE 0 END",
        **{f"m06_{i}": proxy(f"m06_{i}", probes.NOISE * (1 + i / 3)) for i in range(3)}, **{f"m09_{i}": f"CAST({source} = {i} AS INT)" for i in range(4)},
        **{f"m11_{i}": proxy(f"m11_{i}", w=x * w) for i, w in enumerate(probes.projection_weights(S, 3))},
    }
    return ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {c}_{name}" for c, v in of.items())


_text = lambda v: "NULL" if v is None else f"'{v}'"
_CELLS = ", ".join(f"({k}, '{c.mechanism}', '{c.strength}', '{f}', {i}, {f in c.leaks}, {_text(c.group if f in c.columns else None)})" for k, c in enumerate(CELLS) for i, f in enumerate([*FEATURES, *c.columns]))
_BY = "PARTITION BY dataset_id, cell"
_K = f"greatest(1, ceil(round({SHARE} * count(*) OVER ({_BY}), 9)))"
GRID = PANEL + _FUTURE.format(**_PLAIN) + f""",
nine AS (SELECT row_id, row_number() OVER (PARTITION BY y ORDER BY md5('{S}M09|' || row_id), row_id) AS k9, {u_sql(f"'{S}|M09u|' || row_id")} AS u FROM panel),
wide AS (SELECT dataset_id, row_id, split, y, {", ".join(FEATURES)}, {", ".join(_columns_sql(n, x) for n, x in STRENGTHS.items())} FROM splitted JOIN f USING (ts) JOIN nine USING (row_id)),
gl AS ({melted_sql("wide", [*FEATURES, *ADDED], "dataset_id, row_id, split, y")}),
ft AS (SELECT dataset_id, feature_id, avg(value) FILTER (y = 1) AS a, avg(value) FILTER (y = 0) AS b, var_pop(value) AS v, corr(value, y) AS c FROM gl WHERE split = 'train' GROUP BY ALL),
cc AS (SELECT dataset_id, r.*, coalesce(CAST(CASE WHEN v > 1e-12 THEN round((a - b) / v * {grid.WEIGHT}) END AS BIGINT), 0) AS weight, CASE WHEN v > 1e-12 THEN coalesce(round(abs(c), 6), 0) ELSE 0 END AS score
       FROM (SELECT * FROM (VALUES {_CELLS}) t(cell, mechanism, strength, feature_id, position, is_leak, group_id)) r JOIN ft USING (feature_id)),
se AS (SELECT * REPLACE (-1 AS cell), 'strict' AS run, position >= {len(FEATURES)} AS removed FROM cc WHERE cell = 0
       UNION ALL SELECT *, 'strict', is_leak FROM cc WHERE mechanism = 'M10' UNION ALL SELECT *, 'full', false FROM cc
       UNION ALL SELECT *, 'p3', row_number() OVER ({_BY} ORDER BY score DESC, position DESC) <= {_K} FROM cc
       {" ".join(f"UNION ALL SELECT *, 'p2_{k}', row_number() OVER ({_BY} ORDER BY md5('{k}|' || dataset_id || '|' || cell || '|' || feature_id), feature_id) <= {_K} FROM cc" for k in SEEDS)}),
lin AS (SELECT dataset_id, cell, run, row_id, any_value(y) AS y, sum(CASE WHEN removed THEN 0 ELSE weight END * CAST(round(value * {grid.VALUE}) AS BIGINT)) AS s FROM gl JOIN se USING (dataset_id, feature_id) WHERE split = 'test' GROUP BY ALL),
flat AS (SELECT dataset_id, cell, run, s, sum(y) AS p, sum(1 - y) AS q FROM lin GROUP BY ALL),
won AS (SELECT *, sum(q) OVER (PARTITION BY dataset_id, cell, run ORDER BY s ROWS UNBOUNDED PRECEDING) - q / 2.0 AS below FROM flat),
auc AS (SELECT dataset_id, cell, run, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * below) / CAST(sum(p) * sum(q) AS DOUBLE) END AS auroc FROM won GROUP BY ALL),
fl AS (SELECT dataset_id, cell, score, count(*) AS n, sum(CAST(is_leak AS INT)) AS t FROM cc GROUP BY ALL),
hp AS (SELECT *, t * sum(t) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS h FROM fl WINDOW w AS ({_BY} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT dataset_id, cell, sum(t) AS n_leak, sum(h) / sum(t) AS diagnostic_ap FROM hp GROUP BY ALL),
tk AS (SELECT dataset_id, cell, mechanism, strength, count(*) FILTER (is_leak AND k <= 5) / CAST(count(*) FILTER (is_leak) AS DOUBLE) AS top_k_recall FROM (SELECT *, row_number() OVER ({_BY} ORDER BY score DESC, position DESC) AS k FROM cc) GROUP BY ALL),
bk AS (SELECT *, CASE WHEN mechanism = 'M10' THEN own_auc ELSE base_auc END AS clean_auc, full_auc - clean_auc AS paired_harm FROM tk JOIN ap USING (dataset_id, cell) LEFT JOIN (SELECT dataset_id, cell, auroc AS full_auc FROM auc WHERE run = 'full') USING (dataset_id, cell)
       LEFT JOIN (SELECT dataset_id, auroc AS base_auc FROM auc WHERE run = 'strict' AND cell = -1) USING (dataset_id)
       LEFT JOIN (SELECT dataset_id, cell, auroc AS own_auc FROM auc WHERE run = 'strict' AND cell >= 0) USING (dataset_id, cell)),
rm AS (SELECT dataset_id, cell, run, count(*) FILTER (removed AND is_leak) AS n_hit, count(*) FILTER (removed AND is_leak) / CAST(count(*) FILTER (is_leak) AS DOUBLE) AS recall,
              count(*) FILTER (removed AND is_leak) / CAST(count(*) FILTER (removed) AS DOUBLE) AS deletion_precision, count(*) FILTER (NOT removed AND NOT is_leak) / CAST(count(*) FILTER (NOT is_leak) AS DOUBLE) AS legitimate_retention,
              count(*) FILTER (removed AND group_id IS NOT NULL) BETWEEN 1 AND count(group_id) - 1 AS partial FROM se WHERE run LIKE 'p%' GROUP BY ALL),
rp AS (SELECT *, abs(full_auc - clean_auc) - abs(governed_auc - clean_auc) AS sdr, CASE WHEN abs(full_auc - clean_auc) <= 1e-12 THEN 0 ELSE greatest(sign(full_auc - clean_auc) * (governed_auc - clean_auc), 0) + 0 END AS residual,
              CASE WHEN abs(full_auc - clean_auc) <= 1e-12 THEN 0 ELSE greatest(-sign(full_auc - clean_auc) * (governed_auc - clean_auc), 0) + 0 END AS over,
              CASE WHEN abs(full_auc - clean_auc) <= 1e-12 THEN 0 ELSE abs(full_auc - clean_auc) - residual END AS repair
       FROM rm JOIN (SELECT dataset_id, cell, run, auroc AS governed_auc FROM auc) USING (dataset_id, cell, run) JOIN bk USING (dataset_id, cell)),
fr0 AS (SELECT *, round(a.sdr - b.sdr, 9) AS d_sdr, round(a.recall - b.recall, 9) AS d_recall, round(a.residual - b.residual, 9) AS d_residual, round(a.over - b.over, 9) AS d_over, round(a.legitimate_retention - b.retention, 9) AS d_retention, round(a.repair - b.repair, 9) AS d_repair
        FROM (SELECT * FROM rp WHERE run = 'p3') a JOIN (SELECT dataset_id, cell, avg(sdr) AS sdr, avg(recall) AS recall, avg(residual) AS residual, avg(over) AS over, avg(legitimate_retention) AS retention, avg(repair) AS repair FROM rp WHERE run <> 'p3' GROUP BY ALL) b USING (dataset_id, cell)),
fr AS (SELECT dataset_id, cell, mechanism, strength, d_sdr, d_repair, d_residual, d_over, d_recall, d_retention, d_sdr > 0 AS gain, round(sdr, 9) > 0 AS own_gain, d_sdr > 0 AND d_recall <= 0 AS fr1, round(sdr, 9) > 0 AND n_hit = 0 AS fr2, d_sdr > 0 AND d_residual >= 0 AS fr3,
              d_sdr > 0 AND d_over > 0 AS fr4, d_sdr > 0 AND d_retention < 0 AS fr5, d_sdr > 0 AND partial AND mechanism = 'M09' AS fr6 FROM fr0)"""


def add(name, run, sql):
    QUERIES[name], ORACLE[name] = run, GRID + "\n" + sql


KEY = ["dataset_id", "mechanism", "strength"]
_AUC = ["clean_auc", "full_auc", "paired_harm", "diagnostic_ap", "top_k_recall"]
_r = lambda *cols: ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)


def _ledger(s, d):
    columns, _, auc = book(s, d)
    return grid.ledger(auc, columns)


def _repairs(s, d):
    columns, chosen, auc = book(s, d)
    return grid.repairs(grid.ledger(auc, columns), auc, chosen)


add("l6_score_ledger", lambda s, d: rounded(_ledger(s, d).withColumn("run_id", L.run_id(*KEY)), [*KEY, "run_id", "status", "n_leak"], *_AUC),
    f"SELECT dataset_id, mechanism, strength, substr(sha256(concat_ws('|', dataset_id, mechanism, strength)), 1, 20) AS run_id, CASE WHEN paired_harm IS NULL THEN 'FAILURE' ELSE 'SUCCESS' END AS status, CAST(n_leak AS BIGINT) AS n_leak, {_r(*_AUC)} FROM bk")
_E9 = ["governed_auc", "strict_distance_reduction", "same_side_residual", "overcorrection", "recall", "deletion_precision", "legitimate_retention"]
add("e9_policy_grid", lambda s, d: rounded(_repairs(s, d), [*KEY, "run", "partial"], *_E9),
    f"SELECT dataset_id, mechanism, strength, run, partial, {_r(*_E9)} FROM (SELECT * RENAME (sdr AS strict_distance_reduction, residual AS same_side_residual, over AS overcorrection) FROM rp)")
_FLAGS = ["gain", "own_gain", "fr1", "fr2", "fr3", "fr4", "fr5", "fr6"]
add("e12_false_repair_audit", lambda s, d: grid.false_repairs(_repairs(s, d)).select(*KEY, *_FLAGS), f"SELECT dataset_id, mechanism, strength, {', '.join(_FLAGS)} FROM fr")


def _flag_counts(s, d):
    """Counts of each flag and of the keys where it could arise: over all keys, per mechanism, per strength and per archetype of dataset."""
    flagged = grid.false_repairs(_repairs(s, d)).withColumn("gain_grouped", F.col("gain") & (F.col("mechanism") == "M09"))
    flagged = flagged.withColumn("archetype", F.element_at(F.array(*map(F.lit, ARCHETYPES)), F.pmod("dataset_id", F.lit(len(ARCHETYPES))) + 1))
    return L.scopes(flagged, ["mechanism", "strength", "archetype"], {c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in [*_FLAGS, "gain_grouped"]})


_ARCHETYPE = f"{list(ARCHETYPES)}[dataset_id % 5 + 1]"
_SUMS = ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in _FLAGS) + ", count(*) FILTER (gain AND mechanism = 'M09') AS gain_grouped"
add("e12_false_repair_flags", _flag_counts, " UNION ALL ".join(f"SELECT '{n}' AS scope, {lv} AS level, count(*) AS n, {_SUMS} FROM fr {g}" for n, lv, g in (("overall", "'all'", ""), ("mechanism", "mechanism", "GROUP BY mechanism"), ("strength", "strength", "GROUP BY strength"), ("archetype", _ARCHETYPE, "GROUP BY dataset_id % 5"))))
add("g16_baseline", lambda s, d: rounded(grid.baseline(_repairs(s, d)), KEY, "clean_auc", "full_auc"), f"SELECT dataset_id, mechanism, strength, {_r('clean_auc', 'full_auc')} FROM rp WHERE run = 'p3'")
add("e6_grid_harm", lambda s, d: rounded(_ledger(s, d).groupBy("mechanism", "strength").agg(F.count("paired_harm").alias("n"), F.avg("paired_harm").alias("harm"), F.avg((F.col("paired_harm") > 0.01).cast("int")).alias("harm_rate"), F.avg("diagnostic_ap").alias("detectability"), F.avg(metrics.exploitation_ratio(F.col("full_auc"), F.col("clean_auc"))).alias("exploitation")), ["mechanism", "strength", "n"], "harm", "harm_rate", "detectability", "exploitation"),
    """SELECT mechanism, strength, count(paired_harm) AS n, round(avg(paired_harm), 6) AS harm, round(avg(CAST(paired_harm > 0.01 AS INT)), 6) AS harm_rate, round(avg(diagnostic_ap), 6) AS detectability,
    round(avg(least(1.0, (full_auc - clean_auc) / greatest(0.001, 1 - clean_auc))), 6) AS exploitation FROM bk GROUP BY ALL""")  # fmt: skip

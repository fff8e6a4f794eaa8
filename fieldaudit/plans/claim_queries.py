"""Claims about the evaluation grid, decided by tables of rules from intervals over drawn datasets and exact tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldaudit.operators import claims, grid, stats
from fieldaudit.plans.grid_queries import GRID, KEY, _ledger, _repairs
from fieldaudit.plans.panel_queries import S
from fieldaudit.plans.stats_queries import _FLIP, REPS
from fieldaudit.plans.tables import CATEGORIES, categories, u_sql

QUERIES, ORACLE = {}, {}
#: Effects of the ranked removal against its random controls, and what the rules call them.
EFFECTS = {
    "d_sdr": "strict_distance_reduction", "d_repair": "directional_repair", "d_residual": "same_side_residual", "d_recall": "leak_recall", "d_over": "overcorrection", "d_retention": "legitimate_retention",
}
#: The mechanisms whose localization is compared: hidden in a subgroup, and a plain copy.
HIDDEN, PLAIN = "M07", "M01"
# The level of the exact test, and what the grid is asked
ALPHA = 0.05
RULES: list[claims.Rule] = [
    ("simple_vs_structured", 0, "SUPPORTED", "simple_structured.low", ">", 0.0), ("simple_vs_structured", 0, "SUPPORTED", "simple_structured.p_holm", "<=", ALPHA),
    ("simple_vs_structured", 1, "NOT_SUPPORTED", "simple_structured.mean", ">", float("-inf")),
    ("hidden_localization", 0, "SEPARATED_DESCRIPTIVE", f"ap.{HIDDEN}.high", "<", f"ap.{PLAIN}.low"), ("hidden_localization", 1, "DESCRIPTIVE_ONLY", f"ap.{HIDDEN}.mean", ">=", 0.0),
    ("hidden_exploitation", 0, "POSITIVE_DESCRIPTIVE", f"harm.{HIDDEN}.low", ">", 0.0), ("hidden_exploitation", 1, "DESCRIPTIVE_ONLY", f"harm.{HIDDEN}.mean", ">", float("-inf")),
    ("counterexample", 0, "DESCRIPTIVE_ONLY", "harm.M09.mean", ">", "harm.M04.mean"),
]


def _stack(df, keep, names):
    """keep, effect, value: a row for each named column that isn't null."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("effect"), F.col(c).cast("double").alias("value")) for c, n in names.items()))).alias("_e")
    return df.select(*keep, each).select(*keep, "_e.*").where("value IS NOT NULL")


def gate(s, d):
    """Whether the ranked removal repairs scores at each strength: ten conditions on means and interval ends over drawn datasets."""
    effects = _stack(grid.false_repairs(_repairs(s, d)), ["dataset_id", "strength"], EFFECTS).checkpoint()
    ends = stats.interval(stats.unit_bootstrap(effects, "dataset_id", "value", ["strength", "effect"], REPS, S), ["strength", "effect"], "stat")
    seen = effects.groupBy("strength", "dataset_id", "effect").agg(F.avg("value").alias("value")).groupBy("strength", "effect").agg(F.avg("value").alias("mean"))
    summary = claims.figures(ends.join(seen, ["strength", "effect"]), ["strength"], "effect", {"mean": "mean", "low": "low", "high": "high"})
    return claims.decide(summary.withColumn("value", F.round("value", 9)), ["strength"], claims.GATE, "MIXED")


def decided(s, d):
    """Claims on categories and mechanisms of the grid, from its ledger."""
    book = _ledger(s, d).where("status = 'SUCCESS'").select(*KEY, "paired_harm", "diagnostic_ap").checkpoint()
    each = _stack(book, ["dataset_id", "mechanism"], {"paired_harm": "harm", "diagnostic_ap": "ap"}).withColumn("effect", F.concat_ws(".", "effect", "mechanism"))
    by_category = book.join(F.broadcast(categories(s)), "mechanism").groupBy("dataset_id", "category").agg(F.avg("paired_harm").alias("h"))
    wide = by_category.groupBy("dataset_id").pivot("category", ["simple", "structured", "boundary"]).agg(F.first("h"))
    contrast = lambda a, b: F.round(F.col(a) - F.col(b), 9)
    task = wide.withColumns({"x": contrast("simple", "structured"), "y": contrast("simple", "boundary"), "z": contrast("boundary", "structured")})
    task = _stack(task, ["dataset_id"], {"x": "simple_structured", "y": "simple_boundary", "z": "boundary_structured"}).checkpoint()
    drawn = each.select("dataset_id", "effect", "value").unionByName(task.select("dataset_id", "effect", "value")).checkpoint()
    ends = stats.interval(stats.unit_bootstrap(drawn, "dataset_id", "value", ["effect"], REPS, S), ["effect"], "stat")
    tested = stats.holm(stats.halved_sign_flip(task, ["effect"], "value"), "p").select("effect", "p_holm")
    seen = drawn.groupBy("dataset_id", "effect").agg(F.avg("value").alias("value")).groupBy("effect").agg(F.avg("value").alias("mean"))
    summary = claims.figures(ends.join(seen, "effect").join(tested, "effect", "left"), [], "effect", {"mean": "mean", "low": "low", "high": "high", "p_holm": "p_holm"})
    return claims.decide(summary.withColumn("value", F.round("value", 9)), [], RULES, "DESCRIPTIVE_ONLY")


_BOOT = f""", un AS (SELECT dataset_id, row_number() OVER (ORDER BY dataset_id) - 1 AS unit, count(*) OVER () AS n FROM (SELECT DISTINCT dataset_id FROM lg)),
dr AS (SELECT rep, slot, CAST(floor({u_sql(f"'{S}|' || rep || '|' || slot")} * n) AS BIGINT) AS unit FROM (SELECT any_value(n) AS n FROM un), range({REPS}) r(rep), range(1000) s(slot) WHERE slot < n),
um AS (SELECT dataset_id, g, effect, avg(value) AS m FROM lg GROUP BY ALL), sb AS (SELECT rep, g, effect, avg(m) AS stat FROM dr JOIN un USING (unit) JOIN um USING (dataset_id) GROUP BY ALL),
iv AS (SELECT g, effect, round(quantile_cont(stat, 0.025), 9) AS low, round(quantile_cont(stat, 0.975), 9) AS high FROM sb GROUP BY ALL),
sm AS (SELECT g, effect, round(avg(m), 9) AS mean, low, high FROM um JOIN iv USING (g, effect) GROUP BY ALL)"""


def _decide_sql(table, by, more=""):
    """The rules as SQL over sm: figures by name, one CASE a status, the first that holds."""
    figure = lambda m: f"max({m.rsplit('.', 1)[1]}) FILTER (effect = '{m.rsplit('.', 1)[0]}')"
    text = lambda t: ("CAST('-infinity' AS DOUBLE)" if t == float("-inf") else repr(t)) if isinstance(t, float) else figure(t)
    out = []
    for claim in dict.fromkeys(r[0] for r in table):
        own = [r for r in table if r[0] == claim]
        held = {k: [f"coalesce({figure(m)} {op} {text(t)}, false)" for _, r, _, m, op, t in own if r == k] for k in sorted({r[1] for r in own})}
        names = {r[1]: r[2] for r in own}
        cases = " ".join(f"WHEN {' AND '.join(c)} THEN '{names[k]}'" for k, c in held.items())
        every = [c for group in held.values() for c in group]
        out.append(f"SELECT {by}'{claim}' AS claim_id, CASE {cases} ELSE '{more}' END AS status, CAST({' + '.join(f'CAST({c} AS INT)' for c in every)} AS BIGINT) AS n_held, CAST({len(every)} AS BIGINT) AS n_conditions FROM sm{' GROUP BY g' if by else ''}")
    return " UNION ALL ".join(out)


QUERIES |= {"c8_joint_gate": gate, "c4_claims": decided}
ORACLE["c8_joint_gate"] = GRID + ", lg AS (" + " UNION ALL ".join(f"SELECT dataset_id, strength AS g, '{n}' AS effect, CAST({c} AS DOUBLE) AS value FROM fr WHERE {c} IS NOT NULL" for c, n in EFFECTS.items()) + ")" + _BOOT + " " + _decide_sql(claims.GATE, "g AS strength, ", "MIXED")
ORACLE["c4_claims"] = GRID + f""", ok AS (SELECT dataset_id, mechanism, paired_harm, diagnostic_ap FROM bk WHERE paired_harm IS NOT NULL),
cat AS (SELECT dataset_id, category, avg(paired_harm) AS h FROM ok JOIN {CATEGORIES} USING (mechanism) GROUP BY ALL),
cw AS (SELECT dataset_id, max(h) FILTER (category = 'simple') AS a, max(h) FILTER (category = 'structured') AS b, max(h) FILTER (category = 'boundary') AS c FROM cat GROUP BY 1),
tk9 AS (SELECT dataset_id, 'simple_structured' AS effect, round(a - b, 9) AS value FROM cw UNION ALL SELECT dataset_id, 'simple_boundary', round(a - c, 9) FROM cw UNION ALL SELECT dataset_id, 'boundary_structured', round(c - b, 9) FROM cw),
lg AS (SELECT dataset_id, 0 AS g, 'harm.' || mechanism AS effect, paired_harm AS value FROM ok UNION ALL SELECT dataset_id, 0, 'ap.' || mechanism, diagnostic_ap FROM ok UNION ALL SELECT dataset_id, 0, effect, value FROM tk9),
gv AS (SELECT effect AS g, list(value ORDER BY dataset_id) AS v FROM tk9 WHERE value IS NOT NULL GROUP BY 1)""" + _FLIP + """,
hl AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS a FROM sf), hm AS (SELECT g AS effect, round(least(1.0, max(a) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM hl)""" + _BOOT.replace("sm AS (", "sm0 AS (") + ", sm AS (SELECT * FROM sm0 LEFT JOIN hm USING (effect)) " + _decide_sql(RULES, "", "DESCRIPTIVE_ONLY")  # fmt: skip

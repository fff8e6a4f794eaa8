"""A grid of cells over one panel: each cell adds its own columns to the same base columns, and runs of it are scored with some of them removed.

The learner is a fixed linear score without iterations: each column weighs by the difference of the classes' means over its variance on train
rows. Weights and values are whole numbers, so a row's score is exact whatever order it is summed in. A weight doesn't depend on the other
columns: all runs of all cells are one pass over the test rows, and equal runs are scored once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.operators import metrics, policies, scored

#: What values and weights are multiplied with before they are rounded to whole numbers.
VALUE, WEIGHT = 10**6, 10**9
RUN = ["dataset_id", "cell", "run"]
#: The cell of the run on base columns alone.
BASE = -1
LEAST = 1e-12


@dataclass(frozen=True)
class Cell:
    """A mechanism at a strength, the columns that it adds, those of them that leak, and the group that they form, if any."""

    mechanism: str
    strength: str
    columns: list[str]
    leaks: list[str] = field(default_factory=list)
    group: str | None = None


def registry(spark: SparkSession, base: list[str], cells: list[Cell]) -> DataFrame:
    """cell (its place), mechanism, strength, feature_id, position, is_leak, group_id, own_strict: the columns of each cell, base first.

    own_strict: the cell adds a sound column, which its strict view keeps, so it has a strict run of its own; the others share that of the base.
    """
    rows = [
        (k, c.mechanism, c.strength, f, i, f in c.leaks, c.group if f in c.columns else None, len(c.leaks) < len(c.columns))
        for k, c in enumerate(cells) for i, f in enumerate([*base, *c.columns])
    ]
    return spark.createDataFrame(rows, "cell int, mechanism string, strength string, feature_id string, position int, is_leak boolean, group_id string, own_strict boolean")


def fitted(train: DataFrame) -> DataFrame:
    """dataset_id, feature_id, weight, score (absolute correlation) of melted train rows; 0 for a column without spread or a dataset of one class."""
    of = lambda y: F.avg(F.when(F.col("y") == y, F.col("value")))
    out = train.groupBy("dataset_id", "feature_id").agg(of(1).alias("_a"), of(0).alias("_b"), F.var_pop("value").alias("_v"), F.stddev_pop("y").alias("_d"))
    weight = F.when(F.col("_v") > LEAST, F.round((F.col("_a") - F.col("_b")) / F.col("_v") * WEIGHT)).cast("long")
    correlation = F.when(F.col("_v") > LEAST, F.round(F.abs(F.col("_a") - F.col("_b")) * F.col("_d") / F.sqrt("_v"), 6))  # Pearson's, of a label of 0 and 1
    return out.select("dataset_id", "feature_id", F.coalesce(weight, F.lit(0)).alias("weight"), F.coalesce(correlation, F.lit(0.0)).alias("score"))


def selections(columns: DataFrame, share: float, seeds: list[int], n_base: int) -> DataFrame:
    """columns (dataset_id, cell, registry, weight, score) by run, with removed: strict (leaks go; base columns alone as cell BASE, once for
    all cells that keep nothing of their own, and a run for each cell that does), full, p3 (the budget by score) and p2_<seed> (the same budget
    by chance)."""
    by = ["dataset_id", "cell"]
    base = columns.where("cell = 0").withColumns({"cell": F.lit(BASE), "is_leak": F.col("is_leak") | (F.col("position") >= F.lit(n_base))})
    runs = {"strict": policies.oracle(base.unionByName(columns.where("own_strict"))), "full": policies.keep_all(columns), "p3": policies.fields(columns, by, share)}
    runs |= {f"p2_{k}": policies.random(columns, by, share, k) for k in seeds}
    out = None
    for name, df in runs.items():
        df = df.withColumn("run", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def areas(rows: DataFrame, chosen: DataFrame, base: list[str], cells: list[Cell], key: str | None = None) -> DataFrame:
    """dataset_id, cell, run, auroc of the linear score that each run of selections() leaves, on rows (dataset_id, y and all columns).

    Runs that leave the same weights are scored once, all of a dataset's in one product of whole numbers in the tasks; scored.areas() then
    shuffles packed scores. key: a column that differs by row, by which it samples.
    """
    names = list(dict.fromkeys([*base, *(c for cell in cells for c in cell.columns)]))
    whole = lambda v: (F.signum(v) * F.floor(F.abs(v) * VALUE + 0.5)).cast("long")
    x = rows.select(F.col("dataset_id").alias("unit"), "y", F.transform(F.array(*(F.col(c).cast("double") for c in names)), whole).alias("x"), *([key] if key else []))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("feature_id")).cast("int") - 1
    kept = F.when(~F.col("removed") & (F.col("weight") != 0), F.struct(place.alias("p"), F.col("weight").alias("w")))
    runs = chosen.groupBy(*RUN).agg(F.array_sort(F.collect_list(kept)).alias("_w")).checkpoint()
    fits = runs.select("dataset_id", "_w").distinct().withColumn("fit", F.monotonically_increasing_id()).checkpoint()
    own: dict[int, list] = {}
    for r in fits.collect():  # some columns' weights for each different run, as Spark's own models are kept
        own.setdefault(r.dataset_id, []).append((r.fit, [k.p for k in r._w], [k.w for k in r._w]))
    weights = {}
    for unit, told in own.items():
        w = np.zeros((len(names), len(told)), np.int64)
        for k, (_, at, v) in enumerate(told):
            w[at, k] = v
        weights[unit] = np.array([t[0] for t in told]), w
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def score(unit: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit, w = shared.value.get(unit, (np.zeros(0, np.int64), np.zeros((len(names), 0), np.int64)))
        if w.size and (np.abs(x.astype(float)).max(0) @ np.abs(w.astype(float))).max() >= 2**63:
            raise OverflowError("a score is larger than a whole number of 64 bits")
        return fit, x @ w

    found = scored.areas(x, score, key).select(F.col("fit"), "auroc").checkpoint()
    return runs.join(fits, ["dataset_id", "_w"]).join(found, "fit").select(*RUN, "auroc")


def ledger(auc: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per dataset and cell: clean_auc, full_auc, paired_harm, diagnostic_ap, top_k_recall, n_leak and status; a cell without an area
    (a class is missing among its rows) stays, as FAILURE."""
    by = ["dataset_id", "cell"]
    strict = auc.where("run = 'strict'")
    clean, own = strict.where(F.col("cell") == BASE).select("dataset_id", F.col("auroc").alias("_base")), strict.where(F.col("cell") != BASE).select(*by, F.col("auroc").alias("_own"))
    full = auc.where("run = 'full'").select(*by, F.col("auroc").alias("full_auc"))
    found = metrics.localization(columns, by).select(*by, F.col("ap").alias("diagnostic_ap"), "top_k_recall", F.col("n_true").alias("n_leak"))
    names = columns.select("cell", "mechanism", "strength", "own_strict").distinct()
    out = found.join(full, by, "left").join(clean, "dataset_id", "left").join(own, by, "left").join(F.broadcast(names), "cell")
    out = out.withColumn("clean_auc", F.when(F.col("own_strict"), F.col("_own")).otherwise(F.col("_base"))).drop("_own", "_base", "own_strict")
    out = out.withColumn("paired_harm", F.col("full_auc") - F.col("clean_auc"))
    return out.withColumn("status", F.when(F.col("paired_harm").isNull(), "FAILURE").otherwise("SUCCESS"))


def repairs(book: DataFrame, auc: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per cell of the ledger and governed run: governed_auc, what it repaired and damaged, what it removed, and partial (some but not
    all columns of the cell's group went)."""
    by = ["dataset_id", "cell"]
    governed = auc.where("run LIKE 'p%'").withColumnRenamed("auroc", "governed_auc")
    part = F.col("removed") & F.col("group_id").isNotNull()
    groups = chosen.groupBy(*RUN).agg(F.sum(part.cast("int")).alias("_gone"), F.count("group_id").alias("_size"))
    groups = groups.select(*RUN, ((F.col("_gone") > 0) & (F.col("_gone") < F.col("_size"))).alias("partial"))
    out = governed.join(book, by).join(metrics.removal(chosen, RUN).select(*RUN, "recall", "deletion_precision", "legitimate_retention", "n_hit"), RUN).join(groups, RUN)
    return metrics.directional_repair(metrics.utility(out, "clean_auc", "full_auc", "governed_auc"), "clean_auc", "full_auc", "governed_auc")


def false_repairs(repaired: DataFrame, grouped: str = "M09") -> DataFrame:
    """Per dataset and cell: the p3 run less the mean of its p2 controls (d_ columns), the conditions that make a flag possible, and flags 1 to 6.

    1: the distance to the strict score shrinks more, recall doesn't rise; 2: p3's own distance shrinks though no leak went; 3: more distance
    gained, residual no better; 4: more overcorrection; 5: less retention; 6: a group of mechanism `grouped` went in part.
    """
    by = ["dataset_id", "cell", "mechanism", "strength"]
    what = {"sdr": "strict_distance_reduction", "recall": "recall", "residual": "same_side_residual", "over": "overcorrection", "retention": "legitimate_retention"}
    if "directional_repair" in repaired.columns:
        what["repair"] = "directional_repair"
    p3 = repaired.where("run = 'p3'").select(*by, "n_hit", "partial", *(F.col(c).alias(f"p3_{k}") for k, c in what.items()))
    p2 = repaired.where("run LIKE 'p2%'").groupBy(*by).agg(*(F.avg(c).alias(f"p2_{k}") for k, c in what.items()))
    out = p3.join(p2, by).withColumns({f"d_{k}": F.round(F.col(f"p3_{k}") - F.col(f"p2_{k}"), 9) for k in what})
    gain = F.col("d_sdr") > 0
    return out.withColumns({
        "gain": gain, "own_gain": F.round("p3_sdr", 9) > 0, "fr1": gain & (F.col("d_recall") <= 0), "fr2": (F.round("p3_sdr", 9) > 0) & (F.col("n_hit") == 0), "fr3": gain & (F.col("d_residual") >= 0),
        "fr4": gain & (F.col("d_over") > 0), "fr5": gain & (F.col("d_retention") < 0), "fr6": gain & F.col("partial") & (F.col("mechanism") == grouped),
    })


def baseline(repaired: DataFrame, run: str = "p3") -> DataFrame:
    """dataset_id, mechanism, strength, clean_auc, full_auc of the one row per key that carries them; raises if a key has more or none."""
    from fieldaudit.operators.ledger import duplicates, missing_keys, require

    key = ["dataset_id", "mechanism", "strength"]
    carrier = repaired.where(F.col("run") == run)
    require(duplicates(carrier, key), f"a key has more than one {run} row")
    require(missing_keys(carrier, repaired, key), f"a key has no {run} row")
    return carrier.select(*key, "clean_auc", "full_auc")

"""Queries that fit learners: no SQL can check their digits; tests hold the directions of the learners and rankers that they call."""

from __future__ import annotations

from fieldaudit.operators import models
from fieldaudit.plans import grid_queries
from fieldaudit.plans.column_queries import COLUMNS, LEAKS, probed
from fieldaudit.plans.tables import FEATURES

ORACLE: dict[str, str] = {}


def _rows(s, d):
    """Features, probes and labels of all datasets, once computed for the fits that go over them again and again."""
    return probed(s, d).select("row_id", "dataset_id", "split", "y", *COLUMNS).checkpoint()


def _paired(name):
    return lambda s, d: models.paired_scores(_rows(s, d), FEATURES, list(LEAKS), name, ["dataset_id"])


QUERIES = {
    "l1_logistic_scores": _paired("lr"),
    "l2_forest_scores": _paired("rf"),
    "l3_boosted_scores": _paired("gbt"),
    "d3_coefficient_rank": lambda s, d: models.coefficient_rank(_rows(s, d), COLUMNS),
    "d4_permutation_rank": lambda s, d: models.permutation_rank(_rows(s, d), COLUMNS),
    "l5_evaluation_grid": lambda s, d: models.evaluation_grid(grid_queries.injected(s, d).drop("row_id").checkpoint(), FEATURES, grid_queries.CELLS, ["lr"], ["dataset_id"]),
}

"""Queries that grow forests; SQL cannot express them, so tests hold them against identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.forest import CompetingRisksForestTV, SurvivalForestTV
from hazardframe.operators import importance
from hazardframe.operators import models as lm
from hazardframe.plans.cohort import orders_cp
from hazardframe.plans.registry import query

SMALL = {"n_estimators": 20, "ntime": 50, "max_bins": 32, "random_state": 1}


def _cp(spark, sf_dir, features=("price", "acctbal", "segment")):
    cp = orders_cp(spark, sf_dir)
    return cp.with_df(cp.df, features=features)


@query("survival_forest_risk")
def survival_forest_risk(spark, sf_dir):
    cp = _cp(spark, sf_dir)
    return SurvivalForestTV(**SMALL).fit(cp).predict_risk(cp.df, ["id", "start"], 365.0)


@query("survival_forest_oob")
def survival_forest_oob(spark, sf_dir):
    forest = SurvivalForestTV(**SMALL, oob_score=True).fit(_cp(spark, sf_dir))
    return forest.oob_prediction_.select("id", "start", "mortality", "n_trees")


@query("competing_forest_cif")
def competing_forest_cif(spark, sf_dir):
    cp = _cp(spark, sf_dir)
    return CompetingRisksForestTV(**SMALL).fit(cp).predict_cumulative_incidence(cp.df, ["id", "start"], [365.0, 730.0])


@query("landmark_forest_risk")
def landmark_forest_risk(spark, sf_dir):
    cp = _cp(spark, sf_dir)
    model = lm.LandmarkCompetingRisksForest(horizon=365.0, history_features=("price", ("price", "mean"), ("price", "count")), landmarks=[0.0, 365.0, 730.0], forest=CompetingRisksForestTV(**SMALL))
    return model.fit(cp).predict_risk(cp, 1095.0)


@query("landmark_cv_scores")
def landmark_cv_scores(spark, sf_dir):
    cp = _cp(spark, sf_dir)
    binary = cp.with_df(cp.df.withColumn("event", (F.col("event") != 0).cast("long")))
    model = lm.LandmarkSurvivalForest(horizon=200.0, history_features=("price", ("price", "count")), landmarks=[200.0 * k for k in range(7)], forest=SurvivalForestTV(**SMALL | {"n_estimators": 5}))
    return lm.landmark_cross_validate(model, binary, n_splits=2, test_size=200.0, gap=200.0, scoring=("brier",))


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    cp = _cp(spark, sf_dir, ("price", "acctbal"))
    fitted = SurvivalForestTV(**SMALL | {"n_estimators": 5}).fit(cp)
    return importance.permutation_importance(fitted, cp, windows=4, n_repeats=2, n_bootstrap=5)


@query("drop_column_importance")
def drop_column_importance(spark, sf_dir):
    cp = _cp(spark, sf_dir, ("price", "acctbal"))
    return importance.drop_column_importance(SurvivalForestTV(**SMALL | {"n_estimators": 3}), cp, cv=2, windows=4)

"""Survival and competing-risks forests: growth in an Arrow kernel, models and predictions as DataFrames."""

from hazardframe.forest.estimator import CompetingRisksForestTV, SurvivalForestTV

__all__ = ["CompetingRisksForestTV", "SurvivalForestTV"]

"""Landmark forests, and cross-validation over landmarks."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.errors import ValidationError
from hazardframe.forest.estimator import CompetingRisksForestTV, Parameters, SurvivalForestTV
from hazardframe.frame import CountingProcess
from hazardframe.operators import landmark as lm
from hazardframe.operators import metrics, resample
from hazardframe.operators.reshape import censor_at


class _LandmarkForest(Parameters):
    """A forest on a landmark stack, on the clock that starts at the landmark."""

    defaults = {"horizon": None, "history_features": (), "landmarks": None, "step": None, "forest": None, "categorical": None}
    family: type = SurvivalForestTV

    def fit(self, cp: CountingProcess):
        self._check_rows(cp)
        if not self.horizon or self.horizon <= 0:
            raise ValueError("horizon must be positive")
        specs = list(self.history_features)
        self.features_ = ["landmark", *lm.feature_names(specs)]
        stack = lm.landmark_stack(cp, self.horizon, specs, self.landmarks, self.step)
        return self.fit_stack(stack)

    def fit_stack(self, stack: DataFrame):
        """Fit on a stack made by :func:`landmark_stack`."""
        self.features_ = [c for c in stack.columns if c not in ("id", "start", "stop", "event")]
        forest = (self.forest or self.family()).clone()
        block = None
        if forest.resample_unit == "block":
            block = "landmark"
            if forest.block_length * forest.oob_buffer < self.horizon:
                warnings.warn("blocks within the buffer are shorter than the horizon; out-of-bag rows share outcomes", stacklevel=2)
        stacked = CountingProcess(stack, features=tuple(self.features_))
        self.forest_ = forest.fit(stacked, categorical=self.categorical, layout="stacked", block_time=block)
        return self

    def _check_rows(self, cp: CountingProcess) -> None:
        return None

    def _features(self, cp: CountingProcess, s: float) -> DataFrame:
        return lm.landmark_features(cp, float(s), list(self.history_features))

    def _ask(self, times: list[float]) -> list[float]:
        if min(times) < 0 or max(times) > self.horizon:
            raise ValueError("times must lie within the horizon")
        return [float(t) for t in times]

    def predict_survival_function(self, cp: CountingProcess, s: float, times: list[float]) -> DataFrame:
        """``id, landmark, t, surv`` of those at risk at ``s``, ``t`` counted from it."""
        return self.forest_.predict_survival_function(self._features(cp, s), ["id", "landmark"], self._ask(times))


class LandmarkSurvivalForest(_LandmarkForest):
    """Dynamic predictions of any event within a horizon."""

    def _check_rows(self, cp: CountingProcess) -> None:
        if cp.df.where(F.col(cp.event) > 1).limit(1).count():
            raise ValidationError("labels above 1 are causes; use LandmarkCompetingRisksForest")

    def predict_risk(self, cp: CountingProcess, s: float, horizon: float | None = None) -> DataFrame:
        """``id, landmark, risk``."""
        w = self._ask([horizon if horizon is not None else self.horizon])[0]
        return self.forest_.predict_risk(self._features(cp, s), ["id", "landmark"], w)


class LandmarkCompetingRisksForest(_LandmarkForest):
    """Dynamic predictions of a cause within a horizon."""

    defaults = {**_LandmarkForest.defaults, "causes": None, "score_cause": None}
    family = CompetingRisksForestTV

    def fit_stack(self, stack: DataFrame):
        forest = (self.forest or self.family()).clone()
        if self.causes is not None:
            forest.set_params(causes=self.causes)
        if self.score_cause is not None:
            forest.set_params(score_cause=self.score_cause)
        self.forest = forest
        return super().fit_stack(stack)

    @property
    def causes_(self) -> list[int]:
        return self.forest_.causes_

    def predict_cumulative_incidence(self, cp: CountingProcess, s: float, times: list[float], cause: int | None = None) -> DataFrame:
        """``id, landmark, t, cause, cif``."""
        return self.forest_.predict_cumulative_incidence(self._features(cp, s), ["id", "landmark"], self._ask(times), cause)

    def predict_risk(self, cp: CountingProcess, s: float, horizon: float | None = None, cause: int | None = None) -> DataFrame:
        """``id, landmark, risk`` of ``cause`` (the first by default)."""
        w = self._ask([horizon if horizon is not None else self.horizon])[0]
        return self.forest_.predict_risk(self._features(cp, s), ["id", "landmark"], w, cause)


#: Scores of a table ``id, landmark, start, stop, event, risk`` at a horizon, per landmark where the name says so.
SCORERS: dict[str, Callable] = {
    "brier": lambda df, w, cause: metrics.brier(df, w, cause, by=["landmark"]).select("landmark", F.col("brier").alias("score")),
    "cindex_cumulative": lambda df, w, cause: _each_landmark(df, lambda x: metrics.auc_cumulative(x, w, cause).select(F.col("auc").alias("score"))),
    "cindex_incident": lambda df, w, cause: _each_landmark(df, lambda x: metrics.cindex_incident(x, w, cause).select(F.col("concordance").alias("score"))),
}


def integrated_brier_scorer(fitted, cp: CountingProcess, test: list[float], w: float, cause: int | None, n_times: int = 10) -> DataFrame:
    """``landmark, score``: the integrated Brier score of predicted curves at ``n_times`` even times up to the horizon."""
    times = [w * (k + 1) / n_times for k in range(n_times)]
    stack = lm.landmark_stack(cp, w, list(fitted.history_features), test)
    key = ["id", "landmark"]
    if cause is None:
        curves = fitted.forest_.predict_survival_function(stack, key, times).withColumnRenamed("surv", "v")
    else:
        curves = fitted.forest_.predict_cumulative_incidence(stack, key, times, cause).withColumnRenamed("cif", "v")
    arrays = curves.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: p.v).alias("curve"))
    rows = stack.select(*key, "start", "stop", "event").join(arrays, key)
    return _each_landmark(rows, lambda x: metrics.integrated_brier(x, "curve", times, cause).select(F.col("ibs").alias("score")))


def _each_landmark(df: DataFrame, score: Callable) -> DataFrame:
    """One plan over the few landmarks of a test window."""
    out = None
    for r in df.select("landmark").distinct().orderBy("landmark").collect():
        one = score(df.where(F.col("landmark") == r.landmark)).select(F.lit(r.landmark).alias("landmark"), "score")
        out = one if out is None else out.unionAll(one)
    return out


def _candidates(grid: dict[str, list] | None) -> list[dict]:
    if not grid:
        return [{}]
    names = sorted(grid)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*(grid[n] for n in names))]


def landmark_cross_validate(
    model: _LandmarkForest,
    cp: CountingProcess,
    n_splits: int = 3,
    test_size: float | None = None,
    gap: float = 0.0,
    scoring: tuple[str | Callable, ...] = ("brier",),
    horizon: float | None = None,
    cause: int | None = None,
    param_grid: dict[str, list] | None = None,
    refit: str = "brier",
    return_predictions: bool = False,
):
    """Rolling-origin validation over landmarks: ``fold, landmark, scorer, score``.

    ``scoring`` names scorers or gives functions of (table, horizon, cause) that
    return ``landmark, score``. The stack is built once. A fold trains on the ids known at its training
    cutoff, with their follow-up censored there, so that nothing after it is
    used, and scores each test landmark. With ``param_grid`` the last training
    landmarks choose the parameters of the forest by the mean of ``refit``.
    """
    w = float(horizon or model.horizon)
    if gap < w:
        raise ValidationError("the gap between training and test landmarks must cover the horizon")
    unknown = [s for s in scoring if not callable(s) and s not in (*SCORERS, "integrated_brier")]
    if unknown:
        raise ValueError(f"unknown scorers {unknown}")
    spark = cp.df.sparkSession
    times = lm.landmark_times(cp, model.landmarks, model.step)
    size = float(test_size if test_size is not None else times[-1] - times[-2])
    landmarks = spark.createDataFrame([(t,) for t in times], "landmark double")
    rows, tables = [], []
    for fold, lo, hi in resample.fold_windows(landmarks, "landmark", n_splits, size):
        test = [t for t in times if lo < t <= hi]
        train = [t for t in times if test and t <= test[0] - gap]
        if not test or not train:
            raise ValidationError(f"fold {fold} has no training or test landmarks")
        known = cp.with_df(censor_at(cp, test[0]))
        best = model
        candidates = _candidates(param_grid)
        if len(candidates) > 1:
            best = _choose(model, known, train, w, candidates, refit, cause)
        fitted = best.clone().set_params(landmarks=train).fit(known)
        scored = _scored(fitted, cp, test, w, cause).persist()
        for name in scoring:
            if name == "integrated_brier":
                table = integrated_brier_scorer(fitted, cp, test, w, cause)
            else:
                table = (name if callable(name) else SCORERS[name])(scored, w, cause)
            rows += [(fold, r.landmark, name if isinstance(name, str) else name.__name__, r.score) for r in table.collect()]
        if return_predictions:
            tables.append(scored.withColumn("fold", F.lit(fold)))
        else:
            scored.unpersist()
    out = spark.createDataFrame(rows, "fold int, landmark double, scorer string, score double")
    if not return_predictions:
        return out
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    return out, union


def _scored(fitted: _LandmarkForest, cp: CountingProcess, test: list[float], w: float, cause: int | None) -> DataFrame:
    """Outcomes and predicted risks of all test landmarks in one plan."""
    stack = lm.landmark_stack(cp, w, list(fitted.history_features), test)
    key = ["id", "landmark"]
    risk = fitted.forest_.predict_risk(stack, key, w) if cause is None else fitted.forest_.predict_risk(stack, key, w, cause)
    return stack.select(*key, "start", "stop", "event").join(risk, key)


def _choose(model, cp, train, w, candidates, refit, cause):
    """The candidate with the least mean loss (or greatest mean concordance) on the last training landmark."""
    inner_test, inner_train = train[-1:], [t for t in train if t <= train[-1] - w]
    if not inner_train:
        return model.clone().set_params(forest=(model.forest or model.family()).clone().set_params(**candidates[0]))
    best, value = None, None
    for given in candidates:
        forest = (model.forest or model.family()).clone().set_params(**given)
        fitted = model.clone().set_params(forest=forest, landmarks=inner_train).fit(cp.with_df(censor_at(cp, inner_test[0])))
        scores = [r.score for r in SCORERS[refit](_scored(fitted, cp, inner_test, w, cause), w, cause).collect() if r.score is not None]
        if not scores:
            continue
        mean = sum(scores) / len(scores) * (1 if refit == "brier" else -1)
        if value is None or mean < value:
            best, value = forest, mean
    return model.clone().set_params(forest=best or model.forest)

"""Permutation and drop-column importance by the piecewise-exponential score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.errors import ValidationError
from hazardframe.frame import CountingProcess
from hazardframe.operators import estimators as est
from hazardframe.operators import metrics, resample
from hazardframe.operators.landmark import feature_names, landmark_stack
from hazardframe.operators.reshape import noise_column, quantile_codes


def resolve_units(features: list[str], groups: dict[str, list[str]] | None) -> dict[str, list[str]]:
    """Units to judge: the given groups of features, or each feature by itself; groups must not overlap."""
    if not groups:
        return {f: [f] for f in features}
    seen: set[str] = set()
    for name, members in groups.items():
        if not members or set(members) - set(features) or seen & set(members):
            raise ValidationError(f"group {name!r} is empty, unknown or overlaps another")
        seen |= set(members)
    return dict(groups)


def null_curves(fitted, edges: list[float]) -> list[list[float]]:
    """The fitted baseline of each cause at the edges."""
    spark = fitted.baseline_cumhaz_.sparkSession
    asked = spark.createDataFrame([(float(e),) for e in edges], "t double")
    names = [f"h{j}" for j in range(1, len(fitted.causes_) + 1)]
    return [[r[h] for r in est.step_lookup(asked, fitted.baseline_cumhaz_, h, 0.0).orderBy("t").collect()] for h in names]


def with_curves(fitted, rows: DataFrame, key: str, edges: list[float], oob: bool = False) -> DataFrame:
    """``key`` and array columns ``H1``... of cumulative hazards at the edges.

    ``oob`` rows hold encoded features and the ``trees`` that may predict them.
    """
    what = "cause_cumhaz" if len(fitted.causes_) > 1 else ("survival" if fitted.aggregate == "survival" else "cumhaz")
    made = fitted._predict(rows, [key], what, edges, "trees" if oob else None, encoded=oob)
    n = len(edges)
    return made.select(key, *(F.slice("_value", j * n + 1, n).alias(f"H{j + 1}") for j in range(len(fitted.causes_))))


def _keyed(cp: CountingProcess, fitted) -> DataFrame:
    """Rows with ``row_key`` and the event as a code of the fitted causes."""
    code = F.lit(0)
    if getattr(fitted, "competing", False) or len(fitted.causes_) > 1:
        for j, c in enumerate(fitted.causes_, 1):
            code = F.when(F.col(cp.event) == c, j).otherwise(code)
    else:
        code = (F.col(cp.event) != 0).cast("int")
    rows = cp.df.select(F.col(cp.id).alias("id"), F.col(cp.start).alias("start"), F.col(cp.stop).alias("stop"), code.alias("event"), *cp.features)
    return rows.withColumn("row_key", F.xxhash64("id", "start", "stop", *cp.features))


def _score(rows: DataFrame, curves: DataFrame, fitted, edges: list[float], null: list[list[float]], alpha: float, by: str = "total") -> DataFrame:
    causes = list(range(1, len(fitted.causes_) + 1))
    both = rows.select("row_key", "id", "start", "stop", "event").join(curves, "row_key")
    return metrics.piecewise_exponential(both, edges, [f"H{j}" for j in causes], null, causes, alpha, by)


def permutation_importance(
    fitted,
    cp: CountingProcess | None = None,
    groups: dict[str, list[str]] | None = None,
    windows: int | list[float] = 8,
    alpha: float = 0.01,
    strata: list[str] | str = "time",
    n_strata: int = 10,
    n_repeats: int = 5,
    n_bootstrap: int = 20,
    random_state: int = 0,
    oob: bool = False,
) -> DataFrame:
    """``unit, importance, se, share_of_gain``: the drop of the score per event when a unit's columns are permuted.

    Values move between rows of the same stratum: quantile bins of the start
    (``"time"``), or the combinations of the given columns. With ``oob`` the fitted
    rows are judged by the trees that have not seen them, and ``cp`` is not needed.
    All repeats of a unit are one plan; only rows whose donor differs are predicted
    anew. The error is the deviation over resampled ids of the per-id drops. An
    ignored column has importance 0.
    """
    if oob:
        features = list(fitted.encoder_.features)
        rows = fitted.oob_rows().where(F.size("trees") > 0).persist()
        columns = {f: [f"x{i}" for i in fitted.encoder_.expand([f])] for f in features}
        judged = CountingProcess(rows)
    else:
        features = list(cp.features)
        rows = _keyed(cp, fitted).persist()
        columns = {f: [f] for f in features}
        judged = cp
    edges = est.event_windows(judged, windows) if isinstance(windows, int) else [float(w) for w in windows]
    null = null_curves(fitted, edges)
    if strata == "time":
        coded = quantile_codes(rows, "start", n_strata).select("row_key", F.col("code").alias("stratum"))
    else:
        coded = rows.select("row_key", F.struct(*strata).alias("stratum"))
    base = with_curves(fitted, rows, "row_key", edges, oob).persist()
    whole = _score(rows, base, fitted, edges, null, alpha).first()
    n_events = whole.n_events
    gain = (whole.score - whole.null_score) / n_events
    intact = _score(rows, base, fitted, edges, null, alpha, "id").select("id", F.col("score").alias("intact"))
    ids = resample.bootstrap_ids(rows, "id", random_state, n_bootstrap).persist()
    causes = list(range(1, len(fitted.causes_) + 1))
    out = []
    for k, (unit, named) in enumerate(resolve_units(features, groups).items()):
        members = [c for f in named for c in columns[f]]
        pairs = resample.donors(coded, "row_key", ["stratum"], random_state + 1 + k, n_repeats)
        moved = pairs.where("donor != row_key")
        values = rows.select(F.col("row_key").alias("donor"), *members)
        changed = moved.join(values, "donor").join(rows.drop(*members), "row_key").withColumn("_pair", F.struct("row_key", "repeat"))
        fresh = with_curves(fitted, changed, "_pair", edges, oob)
        curves = [c for c in fresh.columns if c != "_pair"]
        fresh = fresh.select("_pair.row_key", "_pair.repeat", *curves)
        same = pairs.where("donor = row_key").select("row_key", "repeat").join(base, "row_key").select("row_key", "repeat", *curves)
        scored = rows.select("row_key", "id", "start", "stop", "event").join(fresh.unionByName(same), "row_key")
        per = metrics.piecewise_exponential(scored, edges, curves, null, causes, alpha, "id")  # summed over repeats
        drops = intact.join(per.select("id", (F.col("score") / n_repeats).alias("permuted")), "id").select("id", (F.col("intact") - F.col("permuted")).alias("drop")).persist()
        mean = drops.agg(F.sum("drop")).first()[0] / n_events
        reps = ids.join(drops, "id").groupBy("rep").agg((F.sum("drop") / n_events).alias("m"))
        se = reps.agg(F.stddev_samp("m")).first()[0]
        drops.unpersist()
        share = mean / gain if gain > 1e-12 * max(1.0, abs(whole.null_score / n_events)) else None
        out.append((unit, float(mean), float(se) if se is not None else None, share))
    session = rows.sparkSession
    rows.unpersist()
    base.unpersist()
    ids.unpersist()
    return session.createDataFrame(out, "unit string, importance double, se double, share_of_gain double")


def landmark_units(specs: list) -> dict[str, list[str]]:
    """The history features that come from each raw column."""
    out: dict[str, list[str]] = {}
    for name, (column, _) in feature_names(specs).items():
        out.setdefault(column, []).append(name)
    return out


def landmark_permutation_importance(model, cp: CountingProcess, landmarks: list[float], scoring: str = "pe", cause: int | None = None, n_repeats: int = 5, random_state: int = 0, **given) -> DataFrame:
    """Importance of raw columns for a fitted landmark model, permuted within each landmark.

    ``scoring="pe"`` as :func:`permutation_importance` on the stack;
    ``scoring="brier"`` gives ``unit, importance``, the rise of the Brier score at
    the horizon, averaged over landmarks and repeats.
    """
    specs = list(model.history_features)
    stack = landmark_stack(cp, model.horizon, specs, landmarks)
    stacked = CountingProcess(stack, features=tuple(model.features_))
    groups = landmark_units(specs)
    if scoring == "pe":
        return permutation_importance(model.forest_, stacked, groups, strata=["landmark"], n_repeats=n_repeats, random_state=random_state, **given)
    if scoring != "brier":
        raise ValueError("scoring must be 'pe' or 'brier'")
    w = float(model.horizon)
    rows = stack.withColumn("row_key", F.xxhash64("id", "landmark")).persist()
    ask = lambda df, key: model.forest_.predict_risk(df, key, w) if cause is None else model.forest_.predict_risk(df, key, w, cause)
    outcome = rows.select("row_key", "id", "landmark", "start", "stop", "event")
    mean = lambda scored, by: metrics.brier(scored, w, cause, by=by).agg(F.avg("brier")).first()[0]
    intact = mean(outcome.join(ask(rows, ["row_key"]), "row_key"), ["landmark"])
    out = []
    for k, (unit, members) in enumerate(groups.items()):
        pairs = resample.donors(rows, "row_key", ["landmark"], random_state + 1 + k, n_repeats)
        values = rows.select(F.col("row_key").alias("donor"), *members)
        changed = pairs.join(values, "donor").join(rows.drop(*members), "row_key")
        scored = outcome.join(ask(changed, ["row_key", "repeat"]), "row_key")
        out.append((unit, float(mean(scored, ["landmark", "repeat"]) - intact)))
    session = rows.sparkSession
    rows.unpersist()
    return session.createDataFrame(out, "unit string, importance double")


def drop_column_importance(estimator, cp: CountingProcess, cv: int = 3, groups: dict[str, list[str]] | None = None, windows: int | list[float] = 8, alpha: float = 0.01, n_seeds: int = 1, add_noise_control: bool = False, random_state: int = 0) -> DataFrame:
    """``unit, importance, se``: the loss of the cross-fitted score per event when a unit is left out of the fit.

    Ids are dealt to folds; every fold fits the full model and one without each
    unit, on the same seed. The error clusters by id.
    """
    if add_noise_control:
        cp = cp.with_df(noise_column(cp.df.withColumn("_k", F.xxhash64(cp.id, cp.start)), "_k", random_state).drop("_k"), features=(*cp.features, "noise"))
    edges = est.event_windows(cp, windows) if isinstance(windows, int) else [float(w) for w in windows]
    folds = resample.group_folds(cp.df, cp.id, cv, random_state)
    marked = cp.df.join(folds, cp.id).persist()
    units = resolve_units(list(cp.features), groups)
    total = None
    for fold in range(cv):
        train, test = cp.with_df(marked.where(F.col("fold") != fold)), cp.with_df(marked.where(F.col("fold") == fold))
        for seed in range(n_seeds):
            scores = {}
            for name, out in {"": [], **units}.items():
                keep = tuple(f for f in cp.features if f not in out)
                if not keep:
                    raise ValidationError(f"unit {name!r} holds all features")
                fitted = estimator.clone().set_params(random_state=random_state + 1000 * fold + seed).fit(train.with_df(train.df, features=keep))
                rows = _keyed(test.with_df(test.df, features=keep), fitted)
                curves = with_curves(fitted, rows, "row_key", edges)
                scores[name] = _score(rows, curves, fitted, edges, null_curves(fitted, edges), alpha, "id").select("id", F.col("score").alias("s"), "n_events")
            for name in units:
                drop = scores[""].join(scores[name].select("id", F.col("s").alias("s2")), "id").select(F.lit(name).alias("unit"), "id", ((F.col("s") - F.col("s2")) / n_seeds).alias("drop"), (F.col("n_events") / n_seeds).alias("n"))
                total = drop if total is None else total.unionAll(drop)
    per = total.groupBy("unit", "id").agg(F.sum("drop").alias("drop"), F.sum("n").alias("n"))
    sums = per.groupBy("unit").agg((F.sum("drop") / F.sum("n")).alias("importance"), F.sum("n").alias("_events"), F.count("*").alias("_ids"))
    residual = per.join(sums, "unit").withColumn("_r", F.col("drop") - F.col("importance") * F.col("n"))
    se = residual.groupBy("unit", "importance", "_events", "_ids").agg(F.stddev_samp("_r").alias("_sd"))
    return se.select("unit", "importance", (F.col("_sd") * F.sqrt(F.col("_ids").cast("double")) / F.col("_events")).alias("se"))


def landmark_drop_column_importance(model, cp: CountingProcess, cv: int = 2, scoring: str = "brier", cause: int | None = None, random_state: int = 0) -> DataFrame:
    """``unit, importance``: the rise of the cross-fitted Brier score when all history features of a raw column are left out."""
    if scoring != "brier":
        raise ValueError("scoring must be 'brier'")
    folds = resample.group_folds(cp.df, cp.id, cv, random_state)
    marked = cp.df.join(folds, cp.id).persist()
    specs, w = list(model.history_features), float(model.horizon)
    units = {"": [], **landmark_units(specs)}
    names = feature_names(specs)
    sums = dict.fromkeys(units, 0.0)
    for fold in range(cv):
        train, test = (cp.with_df(marked.where(x).drop("fold")) for x in (F.col("fold") != fold, F.col("fold") == fold))
        for unit, out in units.items():
            keep = [s for s, n in zip(specs, names, strict=True) if n not in out]
            fitted = model.clone().set_params(history_features=tuple(keep)).fit(train)
            stack = landmark_stack(test, w, keep, model.landmarks, model.step)
            ask = fitted.forest_.predict_risk(stack, ["id", "landmark"], w) if cause is None else fitted.forest_.predict_risk(stack, ["id", "landmark"], w, cause)
            scored = stack.select("id", "landmark", "start", "stop", "event").join(ask, ["id", "landmark"])
            sums[unit] += metrics.brier(scored, w, cause, by=["landmark"]).agg(F.avg("brier")).first()[0] / cv
    session = marked.sparkSession
    marked.unpersist()
    return session.createDataFrame([(u, float(v - sums[""])) for u, v in sums.items() if u], "unit string, importance double")

"""Growing one tree on arrays.

A row is at risk at the grid times ``a <= k < b``; an event of cause ``j`` (from 1)
happens at grid time ``b - 1``. A node's score sums over its own event times only,
from histograms of entries and exits by bin, summed over time and then over bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

RIGHT, LEFT, ALONE = 0, 1, 2
MISSING = -1


@dataclass
class Rows:
    """Rows of a node or tree: bins (features by rows, -1 missing), risk range, cause, unit (sorted)."""

    bins: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cause: np.ndarray
    unit: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.bins[:, at], self.a[at], self.b[at], self.cause[at], self.unit[at])

    @property
    def size(self) -> int:
        return self.a.size


@dataclass
class Limits:
    min_units: int = 15
    min_events: int = 3
    min_events_cause: int = 0
    max_depth: int | None = None
    max_features: int | None = None
    causes: int = 1
    split_cause: int | None = None


@dataclass
class Tree:
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    missing: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    leaf: list = field(default_factory=list)
    jumps: list = field(default_factory=list)  # (leaf, k, cause, jump)
    stats: list = field(default_factory=list)  # (leaf, cause, events)


def risk_profile(rows: Rows, times: np.ndarray, causes: int) -> tuple[np.ndarray, np.ndarray]:
    """At risk, and events of each cause, at the grid times ``times``."""
    edge = np.bincount(np.searchsorted(times, rows.a), minlength=times.size + 1) - np.bincount(np.searchsorted(times, rows.b), minlength=times.size + 1)
    hit = rows.cause > 0
    events = np.zeros((causes, times.size))
    np.add.at(events, (rows.cause[hit] - 1, np.searchsorted(times, rows.b[hit] - 1)), 1)
    return np.cumsum(edge[:-1]).astype(float), events


def logrank(at_risk: np.ndarray, events: np.ndarray, left_risk: np.ndarray, left_events: np.ndarray) -> np.ndarray:
    """``U^2 / V`` of candidates (rows of ``left_*``); ``events`` are those of one cause."""
    use = (at_risk >= 2) & (events > 0)
    y, d = at_risk[use], events[use]
    share = left_risk[:, use] / y
    u = (left_events[:, use] - d * share).sum(axis=1)
    v = (d * share * (1 - share) * (y - d) / (y - 1)).sum(axis=1)
    return np.divide(u * u, v, out=np.zeros_like(u), where=v > 1e-12)


def score(at_risk, events, left_risk, left_events, limits: Limits) -> np.ndarray:
    """One cause's statistic, or the sum over all; ``left_events`` is (causes, candidates, times)."""
    causes = [limits.split_cause - 1] if limits.split_cause else range(events.shape[0])
    return sum(logrank(at_risk, events[j], left_risk, left_events[j]) for j in causes)


def _unit_counts(bins: np.ndarray, unit: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Units with a row in a bin up to ``b``, and with a row beyond it."""
    cuts = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1)) if unit.size else np.zeros(0, int)
    if not unit.size:
        return np.zeros(n_bins, int), np.zeros(n_bins, int)
    low, high = np.minimum.reduceat(bins, cuts), np.maximum.reduceat(bins, cuts)
    upto = np.cumsum(np.bincount(low, minlength=n_bins))
    beyond = cuts.size - np.cumsum(np.bincount(high, minlength=n_bins))
    return upto, beyond


def _units(unit: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(unit))) + 1 if unit.size else 0


@dataclass
class FeatureTable:
    """What the candidates of one feature need: cumulative counts by bin, and units on each side.

    ``left_risk`` (bins, times) and ``left_events`` (causes, bins, times) are those of
    observed rows up to a bin. ``sides`` holds (units up to a bin, units beyond it)
    with missing rows on the right and, if ``lost`` (risk, events, units with missing
    rows, units with observed ones) is there, on the left.
    """

    feature: int
    used: np.ndarray
    left_risk: np.ndarray
    left_events: np.ndarray
    sides: list
    lost: tuple | None = None


def best_of(tables, at_risk: np.ndarray, events: np.ndarray, limits: Limits) -> tuple[int, int, int, float] | None:
    """(feature, bin, where missing go, score) of the best admissible split; the first of equals.

    Candidates come in the order of ``tables``, missing against observed first,
    then ascending bins, missing to the right before missing to the left.
    """
    best, found = 0.0, None
    total = events.sum(axis=1)
    for t in tables:
        ways = [(RIGHT, None)]
        if t.lost is not None:
            lost_risk, lost_events, alone_units, seen_units = t.lost
            ways.append((LEFT, (lost_risk, lost_events)))
            gone = lost_events.sum(axis=1)
            if min(alone_units, seen_units) >= limits.min_units and _enough(gone, limits) and _enough(total - gone, limits):
                value = float(score(at_risk, events, lost_risk[None], lost_events[:, None], limits)[0])
                if value > best:
                    best, found = value, (t.feature, -1, ALONE, value)
        used = t.used
        if not used.size:
            continue
        values, ok = [], []
        for (_, extra), (upto, beyond) in zip(ways, t.sides, strict=True):
            lr, le = t.left_risk[used], t.left_events[:, used]
            if extra is not None:
                lr, le = lr + extra[0], le + extra[1][:, None]
            here = le.sum(axis=2)
            good = (np.minimum(upto[used], beyond[used]) >= limits.min_units) & (np.minimum(here.sum(axis=0), total.sum() - here.sum(axis=0)) >= limits.min_events)
            if limits.min_events_cause:
                good &= (np.minimum(here, total[:, None] - here) >= limits.min_events_cause).all(axis=0)
            s = np.zeros(used.size)
            if good.any():
                s[good] = score(at_risk, events, lr[good], le[:, good], limits)
            values.append(s)
            ok.append(good)
        table = np.where(np.stack(ok, axis=1), np.stack(values, axis=1), -1.0)  # (bins, ways): the order of candidates
        at = int(np.argmax(table))
        if table.flat[at] > best:
            best = float(table.flat[at])
            found = (t.feature, int(used[at // len(ways)]), ways[at % len(ways)][0], best)
    return found


def _tables(rows: Rows, features: np.ndarray, times: np.ndarray, limits: Limits):
    first, last = np.searchsorted(times, rows.a), np.searchsorted(times, rows.b)
    when = np.searchsorted(times, rows.b - 1)
    k = times.size
    for f in features:
        bins = rows.bins[f]
        seen = bins >= 0
        n_bins = int(bins.max(initial=-1)) + 1
        if n_bins < 1:
            continue
        x, width = bins[seen], k + 1
        flow = np.bincount(x * width + first[seen], minlength=n_bins * width) - np.bincount(x * width + last[seen], minlength=n_bins * width)
        left_risk = np.cumsum(np.cumsum(flow.reshape(n_bins, width)[:, :k], axis=1), axis=0).astype(float)
        left_events = np.zeros((limits.causes, n_bins, k))
        for j in range(limits.causes):
            mine = seen & (rows.cause == j + 1)
            left_events[j] = np.cumsum(np.bincount(bins[mine] * k + when[mine], minlength=n_bins * k).reshape(n_bins, k), axis=0)
        used = np.flatnonzero(np.bincount(x, minlength=n_bins))[:-1]  # the last bin would leave nothing
        if seen.all():
            yield FeatureTable(int(f), used, left_risk, left_events, [_unit_counts(bins, rows.unit, n_bins)])
            continue
        sides = []
        for place in (n_bins, -1):  # missing rows beyond all bins, or before them
            upto, beyond = _unit_counts(np.where(seen, bins, place) + 1, rows.unit, n_bins + 2)
            sides.append((upto[1:-1], beyond[1:-1]))  # a unit is on a side if one of its rows is
        gone = rows.take(np.flatnonzero(~seen))
        lost = (*risk_profile(gone, times, limits.causes), _units(gone.unit), _units(rows.unit[seen]))
        yield FeatureTable(int(f), used, left_risk, left_events, sides, lost)


def best_split(rows: Rows, features: np.ndarray, limits: Limits) -> tuple[int, int, int, float] | None:
    """The best split of a node's rows on the drawn ``features``; see :func:`best_of`."""
    times = np.unique(rows.b[rows.cause > 0] - 1)
    if not times.size:
        return None
    return best_of(_tables(rows, features, times, limits), *risk_profile(rows, times, limits.causes), limits)


def _enough(events: np.ndarray, limits: Limits) -> bool:
    return events.sum() >= limits.min_events and (events >= limits.min_events_cause).all()


def goes_left(bins: np.ndarray, cut: int, missing: int) -> np.ndarray:
    if missing == ALONE:
        return bins == MISSING
    return np.where(bins == MISSING, missing == LEFT, bins <= cut)


def divisible(units: int, events: np.ndarray, depth: int, limits: Limits) -> bool:
    """Whether a node's counts leave room for two children."""
    return (
        (limits.max_depth is None or depth < limits.max_depth)
        and units >= 2 * limits.min_units
        and events.sum() >= 2 * limits.min_events
        and bool((events >= 2 * limits.min_events_cause).all())
    )


def grow(rows: Rows, limits: Limits, rng: np.random.Generator, depth: int = 0) -> Tree:
    """A tree, depth first, from a node at ``depth``; every node draws its features anew."""
    tree, p = Tree(), rows.bins.shape[0]
    todo = [(rows, depth, -1, False)]
    while todo:
        part, depth, parent, right = todo.pop()
        node = len(tree.feature)
        if parent >= 0:
            (tree.right if right else tree.left)[parent] = node
        for column, value in ((tree.feature, -1), (tree.bin, -1), (tree.missing, RIGHT), (tree.left, -1), (tree.right, -1), (tree.leaf, -1)):
            column.append(value)
        events = np.bincount(part.cause, minlength=limits.causes + 1)[1:]
        split = None
        if divisible(_units(part.unit), events, depth, limits):
            drawn = rng.permutation(p)[: limits.max_features or p]
            split = best_split(part, drawn, limits)
        if split is None:
            _close(tree, node, part, limits)
            continue
        f, cut, missing, _ = split
        tree.feature[node], tree.bin[node], tree.missing[node] = f, cut, missing
        left = goes_left(part.bins[f], cut, missing)
        todo.append((part.take(np.flatnonzero(~left)), depth + 1, node, True))
        todo.append((part.take(np.flatnonzero(left)), depth + 1, node, False))
    return tree


def _close(tree: Tree, node: int, part: Rows, limits: Limits) -> None:
    leaf = len(tree.stats) // limits.causes
    tree.leaf[node] = leaf
    times = np.unique(part.b[part.cause > 0] - 1)
    at_risk, events = risk_profile(part, times, limits.causes)
    for j in range(limits.causes):
        tree.stats.append((leaf, j + 1, int(events[j].sum())))
        for t in np.flatnonzero(events[j]):
            tree.jumps.append((leaf, int(times[t]), j + 1, float(events[j, t] / at_risk[t])))

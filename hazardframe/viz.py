"""Charts as Vega-Lite specifications and trees as SVG; pure descriptions without a plotting library."""

from __future__ import annotations

from xml.sax.saxutils import escape

SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"


def _spec(values: list[dict], mark, encoding: dict, **more) -> dict:
    return {"$schema": SCHEMA, "data": {"values": values}, "mark": mark, "encoding": encoding, **more}


def _field(name: str, kind: str, title: str | None = None, **more) -> dict:
    return {"field": name, "type": kind, "title": title or name, **more}


def plot_survival_curve(curves, value: str = "surv", label: str | None = None) -> dict:
    """Step chart of ``t`` and ``value`` (a probability, or ``cumhaz``), one line per ``label``."""
    rows = [r.asDict() for r in curves.orderBy("t").collect()]
    scale = {"domain": [0, 1]} if value != "cumhaz" else {}
    encoding = {"x": _field("t", "quantitative", "time"), "y": _field(value, "quantitative", scale=scale)}
    if label:
        encoding["color"] = _field(label, "nominal")
    return _spec(rows, {"type": "line", "interpolate": "step-after"}, encoding)


def plot_cumulative_incidence(curves, subject: str | None = None, cause_labels: dict | None = None) -> dict:
    """Stepped areas of ``cif`` by ``cause``, stacked, one panel per subject."""
    names = cause_labels or {}
    rows = [{**r.asDict(), "cause": str(names.get(r["cause"], r["cause"]))} for r in curves.orderBy("t").collect()]
    encoding = {"x": _field("t", "quantitative", "time"), "y": _field("cif", "quantitative", "cumulative incidence", stack="zero"), "color": _field("cause", "nominal")}
    if subject:
        encoding["facet"] = _field(subject, "nominal", columns=3)
    return _spec(rows, {"type": "area", "interpolate": "step-after"}, encoding)


def plot_importance(table, top_n: int | None = None) -> dict:
    """Bars of ``importance`` with error bars of one ``se``, the largest absolute values first."""
    rows = sorted((r.asDict() for r in table.collect()), key=lambda r: -abs(r["importance"]))[:top_n]
    for r in rows:
        se = r.get("se") or 0.0
        r.update(low=r["importance"] - se, high=r["importance"] + se)
    y = _field("unit", "nominal", "", sort=[r["unit"] for r in rows])
    bars = {"mark": "bar", "encoding": {"y": y, "x": _field("importance", "quantitative")}}
    errors = {"mark": "rule", "encoding": {"y": y, "x": _field("low", "quantitative", "importance"), "x2": {"field": "high"}}}
    return {"$schema": SCHEMA, "data": {"values": rows}, "layer": [bars, errors]}


def plot_hazard_effect(table) -> dict:
    """Lines of ``hazard`` over ``value``, one per window; unsupported points are faint."""
    rows = [r.asDict() for r in table.orderBy("m", "value").collect()]
    color, x, y = _field("m", "ordinal", "window"), _field("value", "quantitative"), _field("hazard", "quantitative")
    points = {"mark": "point", "encoding": {"x": x, "y": y, "color": color, "opacity": {"condition": {"test": "datum.supported", "value": 1}, "value": 0.25}}}
    return {"$schema": SCHEMA, "data": {"values": rows}, "layer": [{"mark": "line", "encoding": {"x": x, "y": y, "color": color}}, points]}


def plot_calibration(table) -> dict:
    """Observed against mean predicted risk per bin, with the diagonal."""
    rows = [r.asDict() for r in table.orderBy("bin").collect()]
    points = {"data": {"values": rows}, "mark": {"type": "line", "point": True}, "encoding": {"x": _field("mean_risk", "quantitative", "predicted"), "y": _field("observed_risk", "quantitative", "observed")}}
    line = {"data": {"values": [{"a": 0, "b": 0}, {"a": 1, "b": 1}]}, "mark": {"type": "line", "strokeDash": [4, 4]}, "encoding": {"x": _field("a", "quantitative"), "y": _field("b", "quantitative")}}
    return {"$schema": SCHEMA, "layer": [line, points]}


def tree_layout(nodes: dict[int, object], max_depth: int | None = None) -> dict[int, tuple[float, int]]:
    """(x, depth) of each shown node: leaves side by side, parents over the middle of their children."""
    place: dict[int, tuple[float, int]] = {}
    column = 0
    todo = [(0, 0, False)]
    while todo:
        n, depth, done = todo.pop()
        node = nodes[n]
        shown_leaf = node.leaf is not None or (max_depth is not None and depth >= max_depth)
        if shown_leaf:
            place[n] = (float(column), depth)
            column += 1
        elif done:
            place[n] = ((place[node.left][0] + place[node.right][0]) / 2, depth)
        else:
            todo += [(n, depth, True), (node.right, depth + 1, False), (node.left, depth + 1, False)]
    return place


def plot_tree(forest, tree: int = 0, max_depth: int | None = None) -> str:
    """One tree of a fitted forest as an SVG text."""
    nodes = {r.node: r for r in forest.export_tree(tree).collect()}
    place = tree_layout(nodes, max_depth)
    wide, high, box = 150, 80, 130
    at = {n: (int(75 + x * wide), 30 + d * high) for n, (x, d) in place.items()}
    parts = []
    for n, (x, y) in at.items():
        r = nodes[n]
        for child, side in ((r.left, "yes"), (r.right, "no")):
            if child in at:
                cx, cy = at[child]
                parts.append(f'<line x1="{x}" y1="{y + 18}" x2="{cx}" y2="{cy - 18}" stroke="#888"/><text x="{(x + cx) // 2}" y="{(y + cy) // 2}" font-size="10">{side}</text>')
    for n, (x, y) in at.items():
        r = nodes[n]
        if r.leaf is not None:
            label = f"leaf {r.leaf}"
        elif r.missing == "alone":
            label = f"{r.feature} missing"
        else:
            label = f"{r.feature} <= {r.threshold:.4g}"
        parts.append(f'<rect x="{x - box // 2}" y="{y - 18}" width="{box}" height="36" rx="4" fill="#fff" stroke="#333"/><text x="{x}" y="{y + 4}" text-anchor="middle" font-size="11">{escape(label)}</text>')
    width = max(x for x, _ in at.values()) + 75
    height = max(y for _, y in at.values()) + 40
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif">{"".join(parts)}</svg>'

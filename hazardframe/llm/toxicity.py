"""Toxicity by a chain of linear classifiers.

The categories are predicted in a fixed order. The model of a category takes the
text's features and the probabilities that the earlier models give; in training
these come from models that were fitted without the row (out of fold), so that a
later model sees earlier predictions as good as those it will see when scoring.
The last category's threshold is where its out-of-fold probabilities separate the
training rows best.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from hazardframe.llm.common import map_rows, spread, text_of, type_of
from hazardframe.llm.features import common_slots, extractor, held_out, labelled_sample, places, sigmoid

#: Labelled documents to learn from, features to weigh, documents that a feature needs.
SAMPLE, MOST, LEAST = 8192, 1 << 16, 4
FOLDS, EPOCHS, RATE, SEED = 4, 8, 0.2, 11
#: A feature is used if its share among marked rows differs by so many standard errors.
CLEAR = 4.0
#: Rows of a step of the descent.
STEP = 16


class LinearModel:
    """Logistic regression on the presence of clear features and a few dense inputs."""

    def __init__(self, chosen: np.ndarray, dense: int):
        self.chosen = chosen
        self.w0 = 0.0
        self.w = np.zeros(chosen.size + dense)

    @staticmethod
    def select(slots: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """Slots whose share differs clearly between marked and other rows (two-proportion z)."""
        every = common_slots([(None, s, None) for s in slots], LEAST, MOST)
        n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
        with_1, with_0 = np.zeros(every.size), np.zeros(every.size)
        for s, label in zip(slots, y, strict=True):
            at, _ = places(every, s)
            (with_1 if label else with_0)[at] += 1
        pooled = (with_1 + with_0) / (n1 + n0)
        z = (with_1 / n1 - with_0 / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0))
        return every[np.abs(z) >= CLEAR]

    def raw(self, slots: np.ndarray, dense: list[float]) -> float:
        at, _ = places(self.chosen, slots)
        return self.w0 + float(self.w[at].sum()) + sum(float(a) * b for a, b in zip(self.w[self.chosen.size :], dense, strict=True))

    @classmethod
    def fit(cls, slots: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> LinearModel:
        """Steps of a few rows, each feature at its own falling rate."""
        model = cls(cls.select(slots, y), dense.shape[1])
        mean = min(max(float(y.mean()) if y.size else 0.5, 1e-3), 1 - 1e-3)
        model.w0 = float(np.log(mean / (1 - mean)))
        k, n = model.chosen.size, len(slots)
        at = [np.concatenate([places(model.chosen, s)[0], k + np.arange(dense.shape[1])]) for s in slots]
        x = [np.concatenate([np.ones(a.size - dense.shape[1]), d]) for a, d in zip(at, dense, strict=True)]
        seen = np.full(model.w.shape, 1e-2)
        rnd = np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            order = rnd.permutation(n)
            for some in (order[i : i + STEP] for i in range(0, n, STEP)):
                row = np.repeat(np.arange(some.size), [at[i].size for i in some])
                where, value = np.concatenate([at[i] for i in some]), np.concatenate([x[i] for i in some])
                g = sigmoid(model.w0 + np.bincount(row, model.w[where] * value, minlength=some.size)) - y[some]
                used, back = np.unique(where, return_inverse=True)
                step = np.bincount(back, g[row] * value, minlength=used.size) + 1e-4 * model.w[used]
                seen[used] += step * step
                model.w[used] -= RATE * step / np.sqrt(seen[used])
                model.w0 -= 0.01 * float(g.sum())
        return model


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of ``p`` with the largest F1 for ``y``, midway to the next lower value; the highest of equals."""
    order = np.argsort(-p, kind="stable")
    value, hit = p[order], np.cumsum(y[order])
    last = np.flatnonzero(np.append(value[1:] != value[:-1], True)) if p.size else np.zeros(0, int)
    if not last.size or not hit[-1]:
        return 0.5
    f1 = 2 * hit[last] / (last + 1 + hit[-1])
    best = int(np.argmax(f1))
    below = value[last[best] + 1] if best + 1 < last.size else 0.0
    return float((value[last[best]] + below) / 2)


class Chain:
    def __init__(self, categories: list[str], models: list[LinearModel], cut: float):
        self.categories, self.models, self.cut = categories, models, cut

    def predict(self, slots: np.ndarray) -> list[float]:
        """The probability of each category, in order."""
        earlier: list[float] = []
        for model in self.models:
            earlier.append(float(sigmoid(model.raw(slots, earlier))))
        return earlier

    @classmethod
    def fit(cls, categories: list[str], slots: list[np.ndarray], marks: np.ndarray, folds: int = FOLDS) -> Chain:
        n = len(slots)
        fold = np.arange(n) % folds
        dense = np.zeros((n, 0))
        models, out = [], np.zeros(n)
        for j in range(len(categories)):
            y = marks[:, j].astype(float)
            models.append(LinearModel.fit(slots, dense, y))
            out = np.zeros(n)
            for f in range(folds):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                part = LinearModel.fit([slots[i] for i in inside], dense[inside], y[inside])
                out[outside] = [sigmoid(part.raw(slots[i], list(dense[i]))) for i in outside]
            dense = np.column_stack([dense, out])
        return cls(categories, models, best_cut(out, marks[:, -1].astype(float)))


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, object], bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Learn ``categories`` (name to a 0/1 expression over ``labels``), in their order.

    At most ``bound`` labelled rows are used and no held-out ones; rows with a
    null label, a null id or no document are left out. Without labelled rows
    every probability is one half.
    """
    marked = labels.select(id_col, *(c.alias(f"_c{i}") for i, c in enumerate(categories.values())))
    sample = labelled_sample(docs, marked, [f"_c{i}" for i in range(len(categories))], bound, LEAST, MOST, id_col, text_col)
    marks = np.array([m for m, _, _ in sample]).reshape(len(sample), len(categories))
    return Chain.fit(list(categories), [s for _, s, _ in sample], marks)


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, a probability per category, and the last category's flag.

    A null text counts as empty; null ids, ties and repeated rows are each
    scored, very long texts whole; an empty table gives an empty one. Further
    columns are never read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def kernel(ids, held, texts):
        found = [shared.value.predict(extractor()(t)[0]) for t in texts]
        made = {id_col: ids, "held_out": held}
        made |= {name: [p[j] for p in found] for j, name in enumerate(names)}
        return made | {"predicted": [int(p[-1] >= shared.value.cut) for p in found]}

    schema = f"`{id_col}` {type_of(docs, id_col)}, held_out boolean, {', '.join(f'{n} double' for n in names)}, predicted int"
    return map_rows(spread(docs.select(id_col, held_out(id_col).alias("_held"), text_of(text_col).alias("_text"))), schema, kernel)

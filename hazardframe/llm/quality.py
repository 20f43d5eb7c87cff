"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]),
so that all pairwise interactions cost time linear in a document's features. It
is trained with AdaGrad on a bounded sample of labelled rows on the driver and
broadcast (its size is bounded by ``most`` features of ``rank`` + 1 numbers).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import map_rows, small_batches, spread, text_of, type_of
from hazardframe.llm.features import common_slots, extractor, held_out, labelled_sample, length_of, places, sigmoid

#: Labelled documents to learn from, features to keep, documents that a feature needs.
SAMPLE, MOST, LEAST = 8192, 1 << 15, 4
RANK, EPOCHS, RATE, DECAY, SEED = 8, 6, 0.1, 1e-5, 7
ACCEPT = 0.7


class FactorisationMachine:
    def __init__(self, chosen: np.ndarray, rank: int = RANK, seed: int = SEED):
        self.chosen = chosen
        self.w0 = 0.0
        self.w = np.zeros(chosen.size, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (chosen.size, rank)).astype(np.float32)

    def inputs(self, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known features and their values, of unit length, so that long texts weigh as short ones."""
        at, there = places(self.chosen, slots)
        x = np.log1p(counts[there])
        return at, (x / max(1e-9, float(np.sqrt(x @ x)))).astype(np.float32) * 4

    def raw(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        v = self.v[at]
        sums = x @ v
        pairs = 0.5 * (float(sums @ sums) - float(((x * x) @ (v * v)).sum()))
        return self.w0 + float(self.w[at] @ x) + pairs, sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> FactorisationMachine:
        mean = min(max(float(np.mean(y)) if y else 0.5, 1e-3), 1 - 1e-3)
        self.w0 = float(np.log(mean / (1 - mean)))
        given = [self.inputs(s, c) for s, c in rows]
        gw, gv = np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32)
        rnd = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rnd.permutation(len(given)):
                at, x = given[i]
                raw, sums = self.raw(at, x)
                g = float(sigmoid(raw)) - y[i]
                dw = g * x + DECAY * self.w[at]
                v = self.v[at]
                dv = g * (x[:, None] * sums - v * (x * x)[:, None]) + DECAY * v
                gw[at] += dw * dw
                gv[at] += dv * dv
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= rate * dv / np.sqrt(gv[at])
                self.w0 -= 0.01 * g
        return self.ready()

    def ready(self) -> FactorisationMachine:
        """Keep what scoring needs of the squares: one number a feature."""
        self.squares = (self.v * self.v).sum(axis=1)
        return self

    def score(self, slots: np.ndarray, counts: np.ndarray) -> float:
        at, x = self.inputs(slots, counts)
        sums = x @ self.v[at]
        raw = self.w0 + float(self.w[at] @ x) + 0.5 * (float(sums @ sums) - float((x * x) @ self.squares[at]))
        return float(sigmoid(raw))


def train_quality(
    docs: DataFrame, labels: DataFrame, mark: str = "quality", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars"
) -> FactorisationMachine:
    """Learn ``mark`` from at most ``bound`` labelled rows that are not held out.

    Inputs are the words of the whole text, statistics of its structure, and as
    metadata the length that the table states in ``length_col``, if it has that
    column. Without labelled rows every score is one half; labels of null, of null
    ids or of ids without a document are left out.
    """
    sample = labelled_sample(docs, labels, [mark], bound, LEAST, MOST, id_col, text_col, length_col)
    model = FactorisationMachine(common_slots(sample, LEAST, MOST))
    return model.fit([(s, c) for _, s, c in sample], [m[0] for m, _, _ in sample])


def score_quality(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``.

    A null text counts as empty and gets the score of an empty text; null ids,
    ties and repeated rows are each scored, very long texts whole; an empty table
    gives an empty one. Further columns are never read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(ids, held, texts, lengths):
        scores = [shared.value.score(*extractor()(t, n)) for t, n in zip(texts, lengths, strict=True)]
        return {id_col: ids, "held_out": held, "score": scores, "predicted": [int(s >= ACCEPT) for s in scores]}

    schema = f"`{id_col}` {type_of(docs, id_col)}, held_out boolean, score double, predicted int"
    return map_rows(spread(docs.select(id_col, held_out(id_col).alias("_held"), text_of(text_col).alias("_text"), length_of(docs, length_col))), schema, kernel)


def keep_good(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, unchanged.

    A null text is judged as the empty one, and stays null if kept; null ids, ties
    and repeated rows are each judged, very long texts whole; an empty table stays
    empty. Further columns pass through, whatever their names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accepted(texts: pd.Series, lengths: pd.Series) -> pd.Series:
        rows = zip(texts, lengths, strict=True)
        return pd.Series([shared.value.score(*extractor()(t, None if pd.isna(n) else int(n))) >= ACCEPT for t, n in rows], dtype=bool)

    return spread(docs).where(F.pandas_udf(accepted, "boolean")(text_of(text_col), length_of(docs, length_col)))

"""Quality and toxicity models: held-out accuracy, the linear-time identity, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from hazardframe.llm import features, quality, toxicity

CLEAN = "the river runs past an old mill and the town wakes early on market days".split()
JUNK = ["buy!!!", "$$$", "###", "CLICK", "***", "now!!!"]
RUDE = ["idiot", "scum", "moron"]


@pytest.fixture()
def corpus(spark, docs_of):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = [rnd.choice(CLEAN) for _ in range(rnd.randint(30, 120))]
        if bad:
            words = [rnd.choice(JUNK) if rnd.random() < 0.5 else w for w in words]
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(RUDE)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (None, "the mill"), (1001, ""), (1002, "the river " * 50_000), (7, rows[7][1])]
    labels += [(7, None, 1), (None, 1, 0), (2000, 1, 1)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    model = quality.train_quality(docs, labels)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == 505
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_pairs_in_linear_time_equal_the_double_sum():
    rnd = np.random.default_rng(0)
    model = quality.FactorisationMachine(np.arange(0, 60, 2), rank=3)
    model.w = rnd.normal(size=30).astype(np.float32)
    model.v = rnd.normal(size=(30, 3)).astype(np.float32)
    at, x = model.inputs(np.array([0, 2, 3, 10, 58]), np.array([1, 2, 3, 1, 4], dtype=np.float32))
    assert at.tolist() == [0, 1, 5, 29]
    slow = model.w0 + sum(model.w[i] * a for i, a in zip(at, x, strict=True))
    slow += sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(model.raw(at, x)[0] - slow) < 1e-4
    score = model.ready().score(np.array([0, 2, 3, 10, 58]), np.array([1, 2, 3, 1, 4], dtype=np.float32))
    assert abs(score - 1 / (1 + np.exp(-slow))) < 1e-5


def test_training_never_sees_held_out_rows(spark, corpus):
    docs, labels = corpus
    sample = features.labelled_sample(docs, labels, ["quality"], 100, 4, 1 << 15)
    assert 98 <= len(sample) <= 100  # a label may have no document
    again = features.labelled_sample(docs.repartition(5), labels.repartition(3), ["quality"], 100, 4, 1 << 15)
    assert all((a[1] == b[1]).all() for a, b in zip(sample, again, strict=True))
    held = labels.where(features.held_out("doc_id"))
    assert features.labelled_sample(docs, held, ["quality"], 100, 4, 1 << 15) == []


def test_chain(spark, corpus):
    from pyspark.sql import functions as F

    docs, labels = corpus
    chain = toxicity.train_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert [m.w.size - m.chosen.size for m in chain.models] == [0, 1]
    out = toxicity.score_toxicity(docs, chain).collect()
    truth = {r.doc_id: r.toxic for r in labels.where("quality is not null").collect()}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert len(out) == 505 and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in out)


def test_without_rows(spark, docs_of):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b"), (2, None)])
    assert {r.score for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect()} == {0.5}
    chain = toxicity.train_chain(docs, labels, {"toxic": F.col("toxic")})
    assert {r.p_toxic for r in toxicity.score_toxicity(docs, chain).collect()} == {0.5}
    assert quality.score_quality(docs_of([]), quality.train_quality(docs, labels)).count() == 0

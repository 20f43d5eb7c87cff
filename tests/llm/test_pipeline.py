"""The pipeline against its stages done plainly, one document at a time."""

import random

import pytest
from test_decontaminate_whole import best_score
from test_near_copies import groups_of
from test_packing import direct
from test_scans import plain_secrets

import corpus_pipeline
from hazardframe.llm import common, quality
from hazardframe.llm.features import Extractor

pytest.importorskip("public_tokenizers")


@pytest.fixture()
def folder(spark, tmp_path):
    rnd = random.Random(8)
    say = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    items = [(i, say(rnd.randint(20, 40))) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        text = say(rnd.randint(40, 300))
        if i % 5 == 0:
            text = " ".join(w + rnd.choice(["$$$", "###"]) for w in text.split())
        if i % 7 == 0:
            text += " password: hunter22x and more"
        if i % 11 == 0:
            text += " " + items[i % 5][1]
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(i % 5 != 0), 0))
    docs += [(200 + i, docs[i][1]) for i in range(10)] + [(300 + i, docs[i][1] + " tail") for i in range(5)]
    docs += [(400, None), (None, say(50)), (401, ""), (402, say(20_000))]
    make = spark.createDataFrame
    make([(d, t, "en", "s", None if t is None else len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    make(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs, items


def test_pipeline(spark, folder):
    sf_dir, docs, items = folder
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    model = quality.train_quality(table("documents"), table("labels"))
    length = lambda t: None if t is None else len(t)
    rows = [(d, t) for d, t in docs if model.score(*Extractor()(t or "", length(t))) >= quality.ACCEPT]
    assert 0 < len(rows) < len(docs)
    best = {}
    for (d, t), g in zip(rows, groups_of(rows), strict=True):
        if g not in best or ((d is None), d or 0) < ((best[g][0] is None), best[g][0] or 0):
            best[g] = (d, t)
    assert len(best) < len(rows)

    def holds(text):
        words = (text or "").split()[:400]
        return any(best_score(x.split(), words) >= 4 * len(x.split()) for _, x in items)

    def clean(text):
        spans = sorted((a, z) for _, a, z in plain_secrets(text))
        for a, z in spans[::-1]:
            text = text[:a] + "[SECRET]" + text[z:]
        return text

    left = [(d, t) for d, t in best.values() if not holds(t)]
    assert len(left) < len(best)
    final = {d: clean(t or "") for d, t in left}
    assert any("[SECRET]" in t for t in final.values())
    ids = direct(list(final.values()))
    want = dict(zip(final, ids, strict=True))
    got = {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want


def test_intermediate_tables_are_removed(spark, folder):
    fs, shared = common._place(spark, common.shared_dir(spark))
    names = lambda: {s.getPath().getName() for s in fs.listStatus(shared)}
    corpus_pipeline.run(spark, folder[0])
    before = names()
    out = corpus_pipeline.run(spark, folder[0])
    left = names() - before
    assert [x.rpartition("-")[0] for x in left] == ["secret-scans"]  # the input of the last stage, which is not run yet
    assert out.count() > 0


def test_stages_keep_the_columns(spark, folder):
    sf_dir, _, _ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = docs.dtypes
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.dtypes == kinds
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0

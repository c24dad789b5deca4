"""The pipeline on a small corpus, stage by stage and whole, against what each operator says of its own input."""

import os
import random

import pytest

import corpus_pipeline
from evidra.llm import mixing, near_dup, packing, quality, secret_scan

VOCAB = [f"word{i}" for i in range(400)]
JUNK = ["buy", "now", "click", "here", "cheap", "$$$"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, block int"


def corpus():
    r = random.Random(11)
    texts = [" ".join(r.choices(VOCAB, k=r.randint(60, 300))) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", texts[2].upper()]
    texts += [" ".join(r.choices(JUNK, k=80)) for _ in range(20)]
    texts += [None, "", "too short", texts[3] + " api_key = 'abcdEFGH1234wxyz5678'" + texts[4], " ".join(r.choices(VOCAB, k=20_000))]
    rows = [(i, t, "en", ["a", "a", "a", "b", None][i % 5], len(t or ""), "r", i, 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, texts[6] + " other words here", "en", "b", 9, None, None, None), (None, " ".join(r.choices(VOCAB, k=90)), None, None, None, None, None, None)]
    labels = [(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(63, 75)] + [(999, 1, None), (None, 1, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rows, labels = corpus()
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def texts(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def done(name, before):
        path = f"{tmp_path}/{name}"
        stage[name](spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.schema.simpleString() == docs.schema.simpleString()
        return after

    good = done("quality_rules", docs)
    kept = [(r.doc_id, r.kept) for r in quality.quality(docs, labels).collect()]
    assert good.count() == sum(k for _, k in kept) > 60 and not {i for i, _ in texts(good)} & {*range(63, 86)}
    one = done("minhash_near_dedup", good)
    assert texts(one) == texts(near_dup.keep_one(good)) and not {60, 61, 62} & {i for i, _ in texts(one)}
    assert [t for i, t in texts(one) if i == 5] == sorted({t for i, t in texts(good) if i == 5})
    clean = done("secret_scans", one)
    assert texts(clean) == sorted((i, secret_scan.redacted(t)) for i, t in texts(one)) and texts(clean) != texts(one)
    mixed = done("source_mixing", clean)
    assert {*texts(mixed)} == {*texts(clean)} and mixed.count() == mixing.mix(clean, evenness=mixing.EVENNESS).count() > clean.count()
    bins = done("best_fit_packing", mixed).collect()
    assert sorted(map(repr, bins)) == sorted(map(repr, packing.pack(mixed.repartition(2)).collect()))
    assert sum(r.used for r in bins) == sum(len(t.split()) for _, t in texts(mixed))


def test_run(spark, sf):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = {*os.listdir(base)}
    bins = corpus_pipeline.run(spark, sf)
    assert sum(bool(r.doc_ids) for r in bins.collect()) == bins.count() > 5
    made = [d for d in os.listdir(base) if d not in before and os.listdir(f"{base}/{d}")]
    assert len(made) == 1 and len(os.listdir(f"{base}/{made[0]}")) == 1


def test_empty(spark, sf, tmp_path):
    root = f"{tmp_path}/none"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{root}/{name}.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []

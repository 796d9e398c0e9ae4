"""The corpus pipeline and each of its stages on small tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = [f.split()[0] for f in DOCS.split(", ")]


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "ti", "on", "sh", "ble"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    path = str(tmp_path_factory.mktemp("corpus"))
    item = prose(rng, 60)
    texts = {i: prose(rng, 80) for i in range(1, 41)}
    texts[41] = texts[1]  # an exact copy
    near = texts[2].split()
    texts[42] = " ".join([*near[:40], "changed", *near[41:]])
    texts[43] = prose(rng, 30) + " " + item + " " + prose(rng, 30)  # leaked
    texts |= {i: prose(rng, 60) + " vile filth scum" * 8 for i in range(44, 74)}
    texts |= {74: None, 75: "", 76: "\n \t", 77: "short line\nshort line"}
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()] + [(None, prose(rng, 50), None, None, 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, int(44 <= i < 74)) for i in range(1, 74)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def test_run_keeps_clean_documents(spark, tables):
    path, texts = tables
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    clean = set(range(1, 41))
    assert clean <= set(got) and not {41, 42, 43} & set(got)
    assert len({*range(44, 74)} & set(got)) <= 3
    assert all(r.parity for r in got.values()) and all(got[i].n_tokens == len(got[i].ids) > 0 for i in clean)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_of_documents(spark, tables, name, stage):
    path, texts = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = stage(spark, docs, path)
    assert out.columns == COLUMNS
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert set(range(3, 41)) <= ids and None in ids
    assert stage(spark, docs.limit(0), path).count() == 0


def test_last_stage_of_odd_rows(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("ids", F.lit("clashes"))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    got = {r.doc_id: r.n_tokens for r in out.where("doc_id >= 74").collect()}
    assert got[74] == got[75] == 0 and got[76] > 0 and out.count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0

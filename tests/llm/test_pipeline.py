import importlib.util
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_setsketch import brute
from tests.llm.util import empty_documents, odd_documents
from tracemill.llm import catalog
from tracemill.llm.langid import identify_documents
from tracemill.llm.quality import judge


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SMALL).cache())
    return out


def test_stages_keep_columns_and_take_effect(stages):
    docs, identified, good, single, mixed, packed = stages
    for frame in (identified, good, single, mixed):
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    known = {r["id"] for r in identify_documents(docs).filter("kept").collect()}
    assert set(ids(identified)) == known
    assert set(ids(good)) == {r["id"] for r in judge(identified).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert set(ids(single)) == {i for i, (_, _, kept) in brute(rows, 5, 80).items() if kept}
    assert set(ids(mixed)) <= set(ids(single)) and max(ids(mixed).values()) <= 3
    covered = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"]: r["n"] // r["all"] for r in covered} == dict(ids(mixed)) and all(r["n"] % r["all"] == 0 for r in covered)


def test_run_gives_the_stages_result(spark, stages):
    ran = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert ran == sorted(tuple(r) for r in stages[-1].collect())


def test_odd_rows(spark):
    for docs in (odd_documents(spark), empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL).cache()
        assert docs.count() >= 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "source_mixing", "packing"]
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in catalog.QUERIES) == 1
    spec = importlib.util.spec_from_file_location("entry", Path(corpus_pipeline.__file__).with_name("__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert {"pipeline", *catalog.QUERIES} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

"""Every query of the subpackage runs over its table; the pipeline equals its stages done by hand."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_queries import connect
from wardline.llm import jaccard
from wardline.llm.queries import ORACLE_SQL, QUERIES

from .test_documents import near_brute

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER)
    if name in ORACLE_SQL:
        want = connect(FOLDER).sql(ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        columns = ", ".join(sorted(got.columns))
        assert Counter(map(str, map(tuple, got.select(*sorted(got.columns)).collect()))) == Counter(
            map(str, want.project(columns).fetchall()))
    else:
        assert got.count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = corpus_pipeline.quality_classifier(spark, docs, FOLDER)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    texts = [(r["doc_id"], r["text"]) for r in good.collect()]
    want = {c for _, _, c in near_brute(texts)}
    one = corpus_pipeline.ngram_jaccard_join(spark, good, FOLDER)
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns
    less = corpus_pipeline.suffix_array_dedup(spark, one, FOLDER)
    assert less.columns == docs.columns and less.count() == one.count()
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"] for r in packed.collect()} == want
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert jaccard.near_groups(less).where("doc_id <> component_id").count() <= less.count()

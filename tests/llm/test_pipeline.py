"""The pipeline against a plain version of its stages, and the queries against their SQL."""

import brute
import duckdb
import pytest

import corpus_pipeline
from oracle import difference
from recallgrid.llm import pii, quality, rules
from recallgrid.llm.common import table
from recallgrid.llm.oracle_sql import ORACLES
from recallgrid.llm.queries import QUERIES, remainder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], SF) is None


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    judged = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    model = quality.train(docs, table(spark, SF, "labels").filter(remainder(5) != 0))
    kept = [d for d in sorted(texts) if judged[d] and model.score(texts[d]) >= 0.3]
    groups = brute.near_duplicates([(d, texts[d]) for d in kept])
    kept = [d for d in kept if groups[d][1] == d]
    for _, stage in corpus_pipeline.STAGES[:4]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == [
        (d, pii.masked(texts[d]), len(pii.masked(texts[d]))) for d in kept]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(kept)

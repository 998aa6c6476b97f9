"""The registered queries with SQL against it on the smallest tables."""

import pytest

from monthmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, root, name):
    df = QUERIES[name](spark, root)
    want = duck.execute(ORACLES[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = df.select(*columns).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = want[columns].sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op6_decontaminate", "op7_warc", "op12_whitening"}))
def test_one_row_for_each_document(spark, root, name):
    out = QUERIES[name](spark, root).select("doc_id").collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id").collect())



import pytest

import corpus_pipeline
from monthmill.llm import simhash
from monthmill.llm.queries import QUERIES
from tests.llm.data import documents
from tests.llm.test_models import LABELS, ODD, rated


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows, labels = rated(n=150)
    item = "a passage of the benchmark that must not be found in any training document at all"
    shared = "\nThis line is found in more than three documents\n"
    texts = {2: rows[2][1] + " " + item, 3: rows[3][1] + shared, 4: rows[4][1] + shared, 7: rows[7][1] + shared, 8: rows[9][1], 12: rows[13][1] + " more"}
    rows = [(i, texts.get(i, t)) for i, t in rows]
    documents(spark, rows + ODD).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], tables).cache())
    for step in out[:-1]:
        assert step.columns == docs.columns
    ids = [sorted(str(r.doc_id) for r in step.select("doc_id").collect()) for step in out]
    quality, lines, near, clean, encoded = ids[1:]
    # poor texts go, sound ones stay
    assert not {"1", "6", "11"} & set(quality) and {"0", "2", "3", "4", "5", "7", "13"} <= set(quality)
    # the shared line stays in the largest document
    text = {r.doc_id: r.text for r in out[2].collect()}
    assert lines == quality and ["more than three" in text[i] for i in (3, 4, 7)] == [False, False, True]
    # copies: the smallest id stays
    assert {"8", "12"} <= set(near) and not {"9", "13"} & set(near)
    assert "2" in near and sorted(set(near) - set(clean)) == ["2"]
    assert encoded == clean
    final = {str(r.doc_id): r for r in out[5].collect()}
    assert all(r.parity and r.round_trip for r in final.values())


def test_near_duplicates_against_all_pairs(spark, tables):
    """The stage as it runs: of every group linked by a shingle similarity of 0.8 the smallest id stays, and nothing else goes."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, out = out, stage(spark, out, tables).cache()
    rows = [(r.doc_id, set(simhash.shingle_hashes(r.text or "", 5).tolist())) for r in before.collect()]
    label = list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    place = {i: n for n, i in enumerate(order)}
    label = [place[i] for i in range(len(rows))]
    alike = [[i == j or rows[i][1] == rows[j][1] or len(rows[i][1] & rows[j][1]) >= 0.8 * len(rows[i][1] | rows[j][1])
              for j in range(len(rows))] for i in range(len(rows))]
    while True:
        new = [min(label[j] for j in range(len(rows)) if alike[i][j]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    want = sorted(str(rows[i][0]) for i in range(len(rows)) if rows[i][0] is None or rows[order[label[i]]][0] == rows[i][0])
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == want


def test_run_and_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).columns == ["doc_id", "ids", "n_tokens", "parity", "round_trip"]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_operators_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))

"""The stages one after the other, each against a plain version on its own input."""

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_near import jaccard_components
from tests.llm.test_scan import runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(llm, tmp_path_factory):
    """Input and output rows of every stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), llm.read.parquet(f"{SF}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm, docs, SF).write.parquet(f"{folder}/{number}")
        after = llm.read.parquet(f"{folder}/{number}")
        out.append((docs, after))
        docs = after
    return out


def test_columns(stages):
    for before, after in stages[:4]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(stages):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in stages[0][1].collect()}
    right = [(i in kept) != bool(t) for i, t in labels.items()]
    assert sum(right) >= 0.9 * len(right)


def test_one_document_of_each_group(stages):
    before, after = (x.collect() for x in stages[2])
    wanted = {i for i, _, c in jaccard_components([(r.doc_id, r.text) for r in before], 5, 8, 10) if i == c}
    assert {r.doc_id for r in after} == wanted


def test_benchmark_documents_go(stages):
    before, after = (x.collect() for x in stages[3])
    items = [runs(t)[1] for _, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    wanted = {r.doc_id for r in before if not any(5 * len(i & runs(r.text)[1]) >= 4 * len(i) for i in items if i)}
    assert {r.doc_id for r in after} == wanted


def test_all_that_is_left_is_encoded(stages):
    before, after = stages[4]
    rows = after.collect()
    assert len(rows) == before.count() and all(r.same for r in rows)


def test_empty_documents(llm, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(llm, docs([]), SF).count() == 0, name

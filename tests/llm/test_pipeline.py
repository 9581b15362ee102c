"""The pipeline: stages in order, columns kept, decisions in effect, hard cases."""

import corpus_pipeline
import pytest
from conftest import SF_SMALL

from llm.conftest import hard_rows
from storepulse.llm.tables import saved, table

import __spark_entry__


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "pack"]
    assert "pipeline" in __spark_entry__.queries()


def test_each_stage_works_on_what_was_kept(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    left = {r.doc_id: len(r.text or "") for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF_SMALL), name)
        now = {r.doc_id: len(r.text or "") for r in docs.collect()}
        assert docs.columns == columns and now.keys() <= left.keys(), name
        # the substring stage takes passages out of texts, the others whole documents
        if name == "substring_dedup":
            assert all(now[d] <= left[d] for d in now) and any(now[d] < left[d] for d in now)
        else:
            assert now.keys() < left.keys() and all(now[d] == left[d] for d in now), name
        left = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left.keys()
    run = corpus_pipeline.run(spark, SF_SMALL)
    assert run.exceptAll(packed).count() == 0 and run.count() == packed.count()


def test_substring_stage_removes_a_document_of_copied_passages(spark, tables):
    """Each half stands in another document, so the near-duplicate stage keeps it and nothing of it is its own."""
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))
    one, two = words("a", 90), words("b", 90)
    path = tables([(1, one + " " + words("x", 90), "en", "s", 1), (2, words("y", 90) + " " + two, "en", "s", 1),
                   (3, one + " " + two, "en", "s", 1), (4, words("z", 120), "en", "s", 1)], clashing=False)
    stages = dict(corpus_pipeline.STAGES)
    docs = saved(stages["near_dedup"](spark, table(spark, path, "documents"), path), "near")
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in stages["substring_dedup"](spark, docs, path).collect()} == {1, 2, 4}


@pytest.mark.parametrize("rows", [hard_rows(), []])
def test_hard_cases(spark, tables, rows):
    path = tables(rows, [(1, 1, 0), (7, 0, 0)], [(1, "a benchmark item of more than thirty-two bytes in length")])
    assert corpus_pipeline.run(spark, path).columns[:3] == ["doc_id", "start", "length"]

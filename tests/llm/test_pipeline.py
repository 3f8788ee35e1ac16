"""The pipeline's stages, each against a plain computation on its own input."""

import corpus_pipeline
from test_decontaminate import plain_scan
from test_mixing import check
from test_repeats import plain
from test_simhash import plain_components

import edges
from vigie.llm import toxicity
from vigie.llm.tables import given
from vigie.session import stored

SF_DIR = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    docs = given(spark, SF_DIR, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.select("doc_id", "text", "source").collect()
        docs = stored(stage(spark, docs, SF_DIR), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    start, distinct, cut, decontaminated, mixed = (seen[name] for name, _ in corpus_pipeline.STAGES)
    scores = toxicity.score_documents(given(spark, SF_DIR, "documents"), given(spark, SF_DIR, "labels")).collect()
    assert {r.doc_id for r in distinct} == {r.doc_id for r in scores if not r.predicted} and len(distinct) < len(start)
    groups, _ = plain_components([(r.doc_id, r.text) for r in distinct])
    assert {r.doc_id for r in cut} == {component for _, _, component in groups} and len(cut) < len(distinct)
    wanted = {key: n - removed for key, n, removed, _, _ in plain([(r.doc_id, r.text) for r in cut], 200)}
    assert {r.doc_id for r in decontaminated} == set(wanted)
    assert all(len(r.text.encode()) <= wanted[r.doc_id] <= len(r.text.encode()) + 6 for r in decontaminated if wanted[r.doc_id] != 0)
    hits = plain_scan([(r.doc_id, r.text) for r in decontaminated], edges.given_rows(SF_DIR, "benchmark", "item_id", "text"))
    assert {r.doc_id for r in mixed} == {row[0] for row in hits if not row[-1]}
    check(docs.collect(), [(r.doc_id, r.text, r.source) for r in mixed])

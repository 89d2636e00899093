"""The pipeline on a driver table, each stage against a plain version of its decision, and what held-out rows say of the models."""

import corpus_pipeline
import pytest
from vinculo.llm.line_rules import LineRules, clean_text
from vinculo.llm.queries import QUERIES

from test_texts import plain_components, plain_counts  # noqa: I001

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_what_plain_versions_keep(stages):
    (docs, told), (_, good), (_, single), (_, packed) = stages
    assert told.columns == good.columns == single.columns == docs.columns
    assert told.count() == docs.filter("text rlike '[a-zA-Z]'").count()
    rules, want = LineRules(), {}
    for r in told.collect():
        n, _, _, _, repeated = plain_counts(r.text)
        text, _, lost = clean_text(r.text, rules)
        if not (n < 10 or 100 * repeated > 20 * n) and lost <= rules.most_lost * n:
            want[r.doc_id] = text
    rows = good.collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    groups = plain_components([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in groups.values()})
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in single.collect()}


def test_good_documents_stay(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in stages[1][1].select("doc_id").collect()}
    base = {r.doc_id for r in QUERIES["op1_line_rules"](spark, SF).filter("base_failed").collect()}
    sure = {d for d, q in labels.items() if q == 1} - base
    assert len(sure & good) >= 0.98 * len(sure)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    told = QUERIES["op7_language"](spark, sf).filter("held_out").join(truth, "doc_id").filter("lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in told) >= 0.98 * len(told) > 100
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    scored = QUERIES["op9_factor_machine"](spark, sf).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.93 * len(scored) > 50

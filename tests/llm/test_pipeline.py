import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import packing, quality, secrets, toxicity
from gridloom.llm.common import read_table
from gridloom.llm.queries import queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's rows, written and read again."""
    at, docs, out = tmp_path_factory.mktemp("pipeline"), read_table(spark, sf_dir, "documents"), {"input": None}
    out["input"] = docs
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, sf_dir).write.parquet(str(at / name))
        docs = out[name] = spark.read.parquet(str(at / name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "secrets", "packing"]
    for name in ("toxicity", "quality", "near_dedup", "secrets"):
        assert stages[name].columns == list(corpus_pipeline.COLUMNS)


def test_toxicity_stage(spark, sf_dir, stages):
    toxic = {r["doc_id"] for r in queries()["op4_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    assert set(texts(stages["toxicity"])) == set(texts(stages["input"])) - toxic and toxic


def test_quality_stage(spark, sf_dir, stages):
    poor = {r["doc_id"] for r in quality.quality_scores(stages["toxicity"], read_table(spark, sf_dir, "labels")).where("predicted = 0").collect()}
    assert set(texts(stages["quality"])) == set(texts(stages["toxicity"])) - poor and poor


def test_near_dedup_stage(stages):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(__file__))
    from tests_brute import groups_of

    before = texts(stages["quality"])
    assert texts(stages["near_dedup"]) == {d: before[d] for d in groups_of(before)}


def test_secrets_stage(stages):
    import re

    before, after = texts(stages["near_dedup"]), texts(stages["secrets"])
    assert before.keys() == after.keys()
    changed = {d for d in before if before[d] != after[d]}
    assert all("[SECRET]" in after[d] for d in changed)
    assert not any(re.search("[0-9a-f]{16}", t) or re.search("AKIA[A-Z0-9]{14}", t) for t in after.values())
    assert all(r["n_chars"] == len(r["text"]) for r in stages["secrets"].collect() if r["doc_id"] in changed)


def test_packing_stage(stages):
    after = texts(stages["secrets"])
    tokens = {d: len(packing.encoder(None).ids(t)) + 1 for d, t in after.items()}
    packed: dict = {}
    for r in stages["packing"].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == tokens


def test_defined_cases(spark, sf_dir, docs_of):
    rows = [(1, "a calm line of prose about rivers"), (1, "a calm line of prose about rivers"), (2, None), (None, "words without an id here"), (None, "other words that have no id"), (3, "")]
    docs = docs_of(rows)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        if name == "packing":
            assert sum(r["length"] for r in out.collect()) == sum(len(packing.encoder(None).ids(t or "")) + 1 for _, t in rows)
        elif name == "near_dedup":
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "other words that have no id"), (0, "words without an id here"), (1, rows[0][1]), (2, "")]
        else:  # calm texts, none of which is labelled, stay
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted((i or 0, t or "") for i, t in rows), name
        empty = step(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0, name
    near = corpus_pipeline.near_copies_out(spark, docs, sf_dir)
    assert sorted((r["doc_id"] or 0) for r in near.collect()) == [0, 0, 1, 2]


def test_very_long_and_clashing(spark, sf_dir, docs_of):
    """A very long text passes all stages; a secret in it goes, nothing else does."""
    calm = "The river runs past old houses and a quiet mill, and people walk along it in the evening. "
    docs = docs_of([(1, calm * 4000 + "password=abcdefgh12345678 " + calm), (2, calm + "another one")])
    for _, step in corpus_pipeline.STAGES[:4]:
        docs = step(spark, docs, sf_dir)
    kept = texts(docs)
    assert kept[1] == calm * 4000 + "[SECRET] " + calm


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert np.isclose(got.count(), stages["packing"].count()) and toxicity and secrets

"""The pipeline stage by stage on a whole small table, and every stage on edge cases."""

import re

import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.test_documents import EDGES, base_spans, brute_groups, distance

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents ahead of each stage, and the last result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != "mixing":
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
        out.append(made.toPandas())
        docs = spark.createDataFrame(out[-1]) if name != "mixing" else made
    return out


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage_keeps_the_good(steps):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    before, after = steps[0].merge(labels, on="doc_id"), set(steps[1].doc_id)
    good = before[before.quality == 1].doc_id
    bad = before[before.quality == 0].doc_id
    assert good.isin(after).mean() > 0.97 and bad.isin(after).mean() < 0.15


def test_join_stage_keeps_one_of_each_group(steps):
    groups = brute_groups(list(zip(steps[1].doc_id, steps[1].text, strict=True)), 5, 80, 100)
    assert set(steps[2].doc_id) == {c for _, c in groups.values()}
    assert len(steps[2]) == steps[2].doc_id.nunique()


def test_decontamination_stage(steps):
    items = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower()) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    exact = {d for d, t in zip(steps[2].doc_id, steps[2].text, strict=True) for i in items if " ".join(i) in " ".join(words(t))}
    gone = set(steps[2].doc_id) - set(steps[3].doc_id)
    assert exact <= gone and exact
    for d, t in zip(steps[2].doc_id, steps[2].text, strict=True):
        if d in gone - exact:
            w = words(t)
            assert any(distance(i, w[a : a + n]) <= 0.2 * len(i) for i in items for a in range(len(w)) for n in (len(i) - 1, len(i), len(i) + 1))


def test_secret_stage(steps):
    before = steps[3].set_index("doc_id").text
    for r in steps[4].itertuples():
        spans = base_spans(before[r.doc_id])
        assert not base_spans(r.text) and ("[SECRET]" in r.text) == bool(spans)
        assert r.n_chars == len(r.text) and (spans or r.text == before[r.doc_id])
    assert len(steps[4]) == len(steps[3])


def test_mixing_stage(steps):
    mixed = steps[5]
    assert set(mixed.doc_id) <= set(steps[4].doc_id)
    for _, part in mixed.groupby("source"):
        assert part.n_tokens.sum() >= part.quota.iloc[0]


def test_run_equals_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "pass"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, steps[5][key].values.tolist()))


def test_run_removes_what_it_wrote(spark):
    from sigloom.llm.common import made

    before = made(spark)
    assert corpus_pipeline.run(spark, SF).count() > 0 and made(spark) == before + 2  # the last stage's input, and the draw's digest


def test_stages_on_edges(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, stats double, sketch int"
    docs = spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in EDGES], kind)
    sf = str(tmp_path)
    spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 1)], "doc_id long, quality long, toxic long").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x y"), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            n = out.count()
            if name == "mixing":
                assert "doc_id" in out.columns
            else:
                assert out.columns == table.columns and n <= len(EDGES)

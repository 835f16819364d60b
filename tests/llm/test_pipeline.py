import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pyarrow as pa  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from pricelattice.llm.common import BATCH, stored  # noqa: E402
from tests.llm.test_simhash import shingle_sets, similarities  # noqa: E402


def test_every_stage(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name != "bpe":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
            good = [i for i in before if labels.get(i) == 1]
            bad = [i for i in before if labels.get(i) == 0]
            assert sum(i in after for i in good) > 0.95 * len(good) and sum(i in after for i in bad) < 0.2 * len(bad)
        if name == "simhash_dedup":
            ids, texts = zip(*((i, r.text) for i, r in sorted(before.items())))
            near = similarities(shingle_sets(texts))
            alone = set(ids) - {ids[k] for p, v in near.items() if v >= 0.8 for k in p}
            assert alone <= set(after)
            close = [p for p, v in near.items() if v >= 0.9]
            assert sum(ids[i] in after and ids[j] in after for i, j in close) <= 0.05 * len(close)
        if name == "decontamination":
            texts = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in after.values() for t in texts)
            assert any(t in r.text for r in before.values() for t in texts)
        if name == "bpe":
            assert set(after) == set(before)
    assert first


def test_run_is_the_stages_in_a_row(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, d), "test-stage")
    assert sorted(map(tuple, pipeline.run(spark, d).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("name", ["quality_classifier", "simhash_dedup", "decontamination", "bpe"])
def test_batches_to_python_are_small(spark, name):
    """Long texts go to Python in batches that are bounded by bytes, not by rows alone."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    d = "/root/testdata/sf0.001"
    dict(pipeline.STAGES)[name](spark, spark.read.parquet(f"{d}/documents.parquet").limit(0), d)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 8_000, 1, 1).select(F.repeat(F.lit("x"), 2_000).alias("text"))
    assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 1.5 * BATCH


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_edges_of_every_stage(spark, name):
    """Empty tables, null and empty texts, repeated rows, null ids, and columns named as the stages' own."""
    stage = dict(pipeline.STAGES)[name]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert stage(spark, docs.limit(0), d).collect() == []
    extra = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, text_hash string, n_deleted string, fp string"
    extra += ", n_lines string, __lines string, __gone string, __d string, __th string, __text string, __words_of string, __score string, __own string, __id string, __hash string"
    more = tuple("abcdefghijk")
    rows = [(10**6 + k, t, None, None, None, "s", "i", "h", "n", "f", *more) for k, t in enumerate([None, "", " \n", "a few plain words"])]
    rows += [(10**6 + 3, "a few plain words", None, None, None, "s", "i", "h", "n", "f", *more), (None, "no id here", "en", "web", 10, "s", "i", "h", "n", "f", *more)]
    out = stage(spark, spark.createDataFrame(rows, extra), d)
    got = out.collect()
    assert len(got) <= len(rows)
    if name != "bpe":
        assert out.columns == extra.replace(" string", "").replace(" long", "").split(", ")
        assert {tuple(r)[5:] for r in got} <= {tuple(r)[5:] for r in rows}
    else:
        assert len(got) == len(rows)

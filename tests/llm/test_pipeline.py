"""The pipeline's stages on the smallest tables, and the registered queries."""

from __future__ import annotations

import corpus_pipeline
from costlens.llm import queries
from costlens.llm.common import default_tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.dtypes == columns
        if name != "contextual_pii":
            assert docs.count() <= before
        before = docs.count()
    assert docs.filter("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z0-9]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert default_tokenizer().endswith(".json")

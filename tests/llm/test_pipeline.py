from __future__ import annotations

import corpus_pipeline
from newsdesk.llm import decontaminate, near_dedup, sentencepiece_codec, substring_dedup
from newsdesk.llm.common import table
from newsdesk.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect_on_its_input(spark):
    docs = table(spark, SF, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF)
        if name == "sentencepiece":
            assert ids(kept) == ids(docs)
            break
        assert kept.schema == docs.schema and ids(kept) <= ids(docs)
        kept.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        kept = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        if name == "near_dedup":
            groups = near_dedup.near_groups(docs)
            assert ids(kept) == ids(groups.filter("doc_id = component_id"))
        if name == "substring_dedup":
            assert ids(docs) - ids(kept) == ids(substring_dedup.scan(docs).filter("n_removed = n_words AND n_removed > 0"))
        if name == "decontamination":
            assert ids(kept) == ids(decontaminate.scan(docs, table(spark, SF, "benchmark")).filter("NOT contaminated"))
        docs = kept
    assert sentencepiece_codec.MODEL


def test_queries_cover_the_thirteen_operators():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)

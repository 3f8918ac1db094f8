"""Decomposed keys are made where the rows stand: no plan has a worker of Python, and all characters decompose as unicodedata says."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from newsdesk import plans
from newsdesk.functions import text as T


@pytest.mark.parametrize("name", ["token_sets", "title_candidates", "page_candidates", "primary_titles", "text_keys", "key_variants"])
def test_no_python_in_plans_of_keys(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_decomposition_of_all_characters(spark):
    known = [c for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(c := chr(i)) != "Cn"]
    rows = ["".join(known[i : i + 50]) for i in range(0, len(known), 50)] + ["q̣̇", "", "áb", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string").select("i", T.nfkd(F.col("x")).alias("d"), T.nfkc(F.col("x")).alias("c"))
    of = lambda form, x: None if x is None else unicodedata.normalize(form, x)
    assert all((r.d, r.c) == (of("NFKD", rows[r.i]), of("NFKC", rows[r.i])) for r in df.collect())

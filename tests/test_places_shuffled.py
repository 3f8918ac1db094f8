"""the places of link_by_phrase, many rows made of a small file, are not broadcast through the driver."""

import __spark_entry__


def test_headline_links_broadcasts_no_places(spark):
    df = __spark_entry__.queries()["headline_links"](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [first") == 2 and "BroadcastHashJoin [first" not in plan
    assert df.count() == 2642

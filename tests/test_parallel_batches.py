"""Micro-batches over all cores: each is read by several tasks, and rows are dealt before they are sorted."""

import re

from pyspark.sql import functions as F

from newsdesk.plans import feeds
from newsdesk.sources.scratch import scratch_dir
from newsdesk.streaming import streams


def test_a_batch_has_a_file_for_each_core(spark):
    seen, path = [], scratch_dir(spark)
    step = lambda df, i: seen.append((len(df.select(F.input_file_name()).distinct().collect()), df.count()))
    feeds._landed(spark.range(3000), 3).writeStream.foreachBatch(step).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in seen] == [spark.sparkContext.defaultParallelism] * 3 and sum(n for _, n in seen) == 3000


def test_rows_are_not_sorted_before_they_are_dealt(spark, monkeypatch):
    plans, path = [], scratch_dir(spark)
    monkeypatch.setattr(streams, "latest", lambda df, *a, f=streams.latest: plans.append(f(df, *a)) or plans[-1])
    rows = spark.range(1000).select((F.col("id") % 300).cast("string").alias("game"), F.lit("v").alias("voter"), (F.col("id") % 10 + 1).cast("int").alias("rating"), F.timestamp_seconds("id").alias("ts"))
    streams.latest_votes(rows, path)
    nodes = re.findall(r"(Exchange|Sort) ", plans[0]._jdf.queryExecution().sparkPlan().toString() + plans[0]._jdf.queryExecution().executedPlan().toString())
    assert nodes.count("Sort") <= 2 and plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 1
    got = {(r.game, r.rating) for r in streams.read_votes(spark, path).collect()}
    assert got == {(str(g), max(i for i in range(1000) if i % 300 == g) % 10 + 1) for g in range(300)}

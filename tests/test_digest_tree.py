"""Drift by digest trees: the rows of a full join, and only differing leaves are read."""

from __future__ import annotations

from operator import itemgetter

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import ledger as L


def written(spark, path, rows, depth=2):
    L.write_digest_tree(spark.createDataFrame(rows, "k long, d string, leaf string"), "k", "d", f"file://{path}", depth)
    return f"file://{path}"


def test_only_differing_leaves_are_read(spark, tmp_path):
    rows = [(k, f"d{k}", "x") for k in range(3000)]
    changed = [(k, "other" if k == 77 else d, x) for k, d, x in rows if k != 5] + [(9001, "new", "x")]
    a, b = written(spark, tmp_path / "a", rows), written(spark, tmp_path / "b", changed)
    leaves = L.differing_leaves(spark, a, b)
    assert 1 <= len(leaves) <= 3
    out = L.drift_by_tree(spark, a, b, "k")
    assert sorted((tuple(r) for r in out.collect()), key=itemgetter(0)) == [(5, "missing"), (77, "mismatched"), (9001, "extra")]
    # Each scan names the leaves as partition filters; those hold few of the 3,000 rows.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "PartitionFilters: []" not in plan
    assert spark.read.parquet(f"{a}/rows").filter(F.col("leaf").isin(leaves)).count() < 100


def test_equal_trees_read_no_rows(spark, tmp_path):
    rows = [(k, None if k % 7 == 0 else f"d{k}", "x") for k in range(500)] + [(None, "no key", "x")]
    a, b = written(spark, tmp_path / "a", rows), written(spark, tmp_path / "b", rows[::-1])
    assert L.differing_leaves(spark, a, b) == []
    assert L.drift_by_tree(spark, a, b, "k").count() == 0


def test_empty_sides_and_depths(spark, tmp_path):
    a, none = written(spark, tmp_path / "a", [(1, "x", ""), (2, "y", "")]), written(spark, tmp_path / "none", [])
    assert {tuple(r) for r in L.drift_by_tree(spark, a, none, "k").collect()} == {(1, "missing"), (2, "missing")}
    assert {tuple(r) for r in L.drift_by_tree(spark, none, a, "k").collect()} == {(1, "extra"), (2, "extra")}
    assert L.drift_by_tree(spark, none, none, "k").count() == 0
    with pytest.raises(ValueError, match="depth"):
        L.differing_leaves(spark, a, written(spark, tmp_path / "deep", [(1, "x", "")], 3))

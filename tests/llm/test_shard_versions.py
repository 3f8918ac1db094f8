"""Living shard sets: several arrivals, racing writers, old versions, clashing names."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from newsdesk.llm import sharding

SCHEMA = "doc_id long, text string, path string, n int, bytes long, shard string, n_rows long, run int, file string, N_ string"


def part(spark, k, n=300):
    return spark.createDataFrame([(i, f"text {i} " * 9 if i % 7 else None, f"p{i}", i, -i, f"s{i}", i, i % 3, "f", None) for i in range(k * n, (k + 1) * n)], SCHEMA.replace("N_", "other")).repartition(4)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_arrivals_and_compactions_keep_every_row(spark, tmp_path):
    root, whole = f"file://{tmp_path}/s", None
    for k in range(3):
        docs = part(spark, k)
        whole = docs if whole is None else whole.union(docs)
        version = sharding.append(docs, root, 4_000)
        assert version == sharding.latest_version(spark, root)
        assert ids(sharding.read(spark, root, None, docs.schema)) == list(range(300 * (k + 1)))
        before = sharding.manifest(spark, root).count()
        while (merged := sharding.compact(spark, root, docs.schema, 20_000, fewest=2)) is not None:
            assert merged == sharding.latest_version(spark, root)
        assert sharding.manifest(spark, root).count() < before
    got = sharding.read(spark, root, None, whole.schema)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr) and got.schema == whole.schema
    # Each version reads as it was, until it is vacuumed.
    assert ids(sharding.read(spark, root, 1, whole.schema)) == list(range(300))
    last = sharding.latest_version(spark, root)
    sharding.vacuum(spark, root, keep=2)
    assert sharding.versions(spark, root) == [last - 1, last]
    assert ids(sharding.read(spark, root, last - 1, whole.schema)) == ids(sharding.read(spark, root, last, whole.schema)) == list(range(900))


def test_racing_writers_all_commit(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: sharding.append(part(spark, k, 20), root, 4_000), range(4)))
    assert sorted(got) == [1, 2, 3, 4] == sharding.versions(spark, root)
    schema = part(spark, 0, 1).schema
    assert ids(sharding.read(spark, root, None, schema)) == list(range(80))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: sharding.compact(spark, root, schema, 100_000) if k else sharding.append(part(spark, 4, 20), root, 4_000), range(3)))
    assert ids(sharding.read(spark, root, None, schema)) == list(range(100))


def test_a_taken_version_is_not_replaced(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    sharding.append(part(spark, 0, 10), root)
    assert sharding._commit(sharding.manifest(spark, root).limit(0), root, 1) is False
    assert sharding.manifest(spark, root, 1).count() > 0 and sharding.versions(spark, root) == [1]


def test_more_runs_than_a_commit_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "COMMIT_RUNS", 2)
    monkeypatch.setattr(sharding, "RUN_SHARDS", 3)
    root, docs = f"file://{tmp_path}/m", part(spark, 0)
    sharding.append(docs, root, 1_000)
    commits = 0
    while sharding.compact(spark, root, docs.schema, 50_000) is not None:
        commits += 1
    assert commits > 2 and ids(sharding.read(spark, root, None, docs.schema)) == list(range(300))


def test_a_metadata_column_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="_metadata"):
        sharding.append(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, _metadata string"), f"file://{tmp_path}/x")

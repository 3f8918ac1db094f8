"""Groups and lists that are too large for one task: ranges, rounds, and components without a bound on rounds."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsdesk import plans
from newsdesk.operators import similarity as S
from newsdesk.operators import topk as T


@pytest.mark.parametrize("seed", range(2))
def test_greedy_dates_in_one_component(spark, monkeypatch, seed):
    monkeypatch.delattr(T, "walk_groups")  # one component holds all keys: it is not to be gathered
    rng = random.Random(seed)
    rows = [(i, rng.sample(range(12), rng.randint(1, 4)), rng.randint(0, 9)) for i in range(120)]
    rows += [(200, [None, 3], 0), (201, [None], 1), (202, [None], 2), (203, [None], 3), (204, [], 0), (205, None, 0)]
    used, want = Counter(), []
    for i, days, r in sorted((x for x in rows if x[1]), key=lambda x: (x[2], x[0])):
        if all(used[d] < 3 for d in days):
            used.update(days)
            want.append((i, r))
    df = spark.createDataFrame(rows, "i long, d array<int>, r int")
    assert sorted(map(tuple, T.greedy_dates(df, "i", "d", "r", 3).collect())) == sorted(want)
    assert {x.i for x in T.greedy_dates(df, "i", "d", "r", 3, 5).collect()} == {i for i, _ in want[:5]}
    assert T.greedy_dates(df.limit(0), "i", "d", "r", 3).count() == 0


def test_places_split_a_hot_group(spark):
    rows = [("hot" if i % 5 else None if i % 2 else "b", i * 7919 % 1009) for i in range(1000)]
    got = T.places(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.desc("v")], "place").collect()
    for g in ("hot", "b", None):
        own = sorted((v for x, v in rows if x == g), reverse=True)
        assert sorted((r.place, r.v) for r in got if r.g == g) == list(enumerate(own, 1))
    one = T.places(spark.createDataFrame(rows, "g string, v int"), [], [F.col("v")], "place")
    assert [r.place for r in one.orderBy("v").collect()] == list(range(1, 1001))


def test_rank_of_users_has_no_window_over_all(spark):
    plan = plans.QUERIES["expectation_ratings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(popularity" not in plan


def test_catalogue_issues_number_no_unresolved_record(spark):
    plan = plans.QUERIES["catalogue_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "isnotnull" in window[: window.index("Relation")].lower()


def test_connected_has_no_bound_on_rounds(spark):
    import inspect

    assert "most" not in inspect.signature(S.connected).parameters
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long")
    assert {r.component for r in S.connected(chain).collect()} == {0}


def _tables(spark):
    """Tables in the folder of the session."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    return {str(f.getPath()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}


def test_chain_of_dates_takes_few_rounds(spark, monkeypatch):
    """Each key shares a date with the next: 10,000 links, decided by turns."""
    n, rounds, before = 10_000, [], _tables(spark)
    rows = [(i, [i, i + 1], i) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, d array<long>, r long")
    walked = T.first_walked
    monkeypatch.setattr(T, "first_walked", lambda *a, **b: rounds.append(1) or walked(*a, **b))
    assert sorted(r.i for r in T.greedy_dates(df, "i", "d", "r", 1, walk=2000).collect()) == list(range(0, n, 2))
    assert len(rounds) < 30
    assert len(_tables(spark) - before) == 1  # the rows that were taken


@pytest.mark.parametrize("seed", range(2))
def test_greedy_dates_with_rounds_and_short_walks(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.sample(range(30), rng.randint(1, 4)), rng.randint(0, 9)) for i in range(150)]
    used, want = Counter(), []
    for i, days, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        if all(used[d] < 2 for d in days):
            used.update(days)
            want.append(i)
    df = spark.createDataFrame(rows, "i long, d array<int>, r int")
    for walk in (1, 7, 60):
        assert sorted(r.i for r in T.greedy_dates(df, "i", "d", "r", 2, walk=walk).collect()) == sorted(want)


def _walked_leaders(n, sim, first_match):
    leaders, want = [], {}
    for i in range(n):
        near = [(0 if first_match else -sim[x, i], x) for x in leaders if (x, i) in sim]
        want[i] = min(near)[1] if near else i
        if not near:
            leaders.append(i)
    return want


@pytest.mark.parametrize("walk,first_match", [(1, False), (5, True), (40, False)])
def test_leaders_of_random_graphs(spark, walk, first_match):
    rng = random.Random(walk)
    n = 120
    sim = {(a, b): rng.choice([0.6, 0.7, 0.8]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.04}
    items = spark.createDataFrame([(i, i // 3) for i in range(n)], "k int, o int")
    links = spark.createDataFrame([(a, b, s) if rng.random() < 0.5 else (b, a, s) for (a, b), s in sim.items()], "a int, b int, similarity double")
    got = {r.k: r.leader for r in S.leader_clusters(items, links, "k", "o", first_match, walk).collect()}
    assert got == _walked_leaders(n, sim, first_match)


def test_a_chain_of_leaders_has_no_bound(spark):
    n, before = 3000, _tables(spark)
    items = spark.createDataFrame([(i, i) for i in range(n)], "k int, o int")
    links = spark.createDataFrame([(i, i + 1, 0.9) for i in range(n - 1)], "a int, b int, similarity double")
    got = {r.k: r.leader for r in S.leader_clusters(items, links, "k", "o", walk=500).collect()}
    assert got == {i: i - i % 2 for i in range(n)}
    assert len(_tables(spark) - before) <= 2  # pairs, and the rows that joined
    assert S.leader_clusters(items.limit(2), links.limit(0), "k", "o").count() == 2

"""Order-dependent operators against plain models on random rows, and rules on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import ledger as L
from newsdesk.operators import linking as K
from newsdesk.operators import quality as Q
from newsdesk.operators import ratings as R
from newsdesk.operators import registry as G
from newsdesk.operators import retention as P
from newsdesk.operators import similarity as S
from newsdesk.operators import topk as T


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_cap_by_group_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), rng.randint(0, 9)) for i in range(60)]
    want, used = [], {}
    for i, g, s in sorted(rows, key=lambda r: (-r[2], r[0])):
        if used.get(g, 0) < 4 and len(want) < 9:
            used[g] = used.get(g, 0) + 1
            want.append((i,))
    df = spark.createDataFrame(rows, "i int, g string, s int")
    assert pairs(T.cap_by_group(df, "g", [F.desc("s"), F.col("i")], 4, 9), "i") == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dates_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, sorted(rng.sample(range(8), rng.randint(1, 3))), rng.randint(0, 20)) for i in range(40)]
    want, used = [], {}
    for i, days, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if all(used.get(d, 0) < 3 for d in days):
            for d in days:
                used[d] = used.get(d, 0) + 1
            want.append((i,))
    df = spark.createDataFrame(rows, "i int, d array<int>, r int")
    assert pairs(T.greedy_dates(df, "i", "d", "r", 3), "i") == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_leader_clusters_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    n = 40
    sim = {(a, b): rng.choice([0.6, 0.7, 0.8]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.05}
    get = lambda a, b: sim.get((min(a, b), max(a, b)), 0)
    leaders, want = [], []
    for i in range(n):
        best = max(((get(i, x), -k, x) for k, x in enumerate(leaders) if get(i, x) > 0), default=None)
        if best:
            want.append((i, best[2]))
        else:
            leaders.append(i)
            want.append((i, i))
    items = spark.createDataFrame([(i, i) for i in range(n)], "k int, o int")
    links = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "a int, b int, similarity double")
    assert pairs(S.leader_clusters(items, links, "k", "o"), "k", "leader") == want


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (103, 101)], "a long, b long")
    got = dict(pairs(S.connected(edges), "node", "component"))
    assert {got[i] for i in range(51)} == {0} and got[103] == 100 and len(got) == 54


@pytest.mark.parametrize("seed", range(2))
def test_similar_pairs_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    sets = {i: sorted(set(rng.choices("abcdefgh", k=rng.randint(0, 6)))) for i in range(30)}
    want = sorted((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / min(len(sets[a]), len(sets[b])) >= 0.6)
    df = spark.createDataFrame(list(sets.items()), "k int, t array<string>")
    assert pairs(S.similar_pairs(df, "k", "t", 0.6), "a", "b") == want


def test_accept_sources_rejected_rows_block_nothing(spark):
    rows = [("g", 1, "u1", "p1", True), ("g", 2, "u1", "p1", False), ("g", 3, "u1", "p2", False), ("g", 4, "u2", "p1", False), ("g", 5, "u3", "p3", False), ("g", 6, "u4", "p4", False)]
    df = spark.createDataFrame(rows, "game string, o int, url string, publication string, blocked boolean")
    assert pairs(R.accept_sources(df, "game", "o", 2), "o", "reason") == [(1, "blocked"), (2, ""), (3, "duplicate_url"), (4, "duplicate_publication"), (5, ""), (6, "maximum")]


def test_critic_scores(spark):
    df = spark.createDataFrame([("g", 8.0, 10.0, None), ("g", 90.0, 100.0, 2.0)], "game string, s double, m double, w double")
    assert R.weighted_score(df, "game", F.col("s"), F.col("m"), F.col("w"), F.lit(True)).first().score == 86.7


def test_retention_drops_an_incomplete_newest(spark):
    rows = [("v5", 5, False), ("v4", 4, True), ("v3", 3, True), ("v2", 2, True), ("v1", 1, True)]
    df = spark.createDataFrame(rows, "version string, d int, complete boolean").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))
    got = dict(pairs(P.retention_plan(df, "version", "ts", 1, 1, "v1"), "version", "reason"))
    assert got == {"v5": "incomplete", "v4": "recent", "v3": "daily", "v2": "expired", "v1": "current"}


def test_failure_streaks(spark):
    rows = [("a", 1, "ok"), ("a", 2, "error"), ("a", 3, "skipped"), ("a", 4, "error"), ("a", 5, "error"), ("b", 1, "error"), ("b", 2, "ok"), ("c", 1, "skipped")]
    df = spark.createDataFrame(rows, "s string, t int, x string")
    ok = F.when(F.col("x") == "ok", True).when(F.col("x") == "error", False)
    assert pairs(L.failure_streaks(df, "s", "t", "t", ok), "s", "failures", "persistent") == [("a", 3, True), ("b", 0, False), ("c", 0, False)]


def test_redirects_follow_chains_and_report_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "source int, target int")
    got = {r.source: (r.target, r.cyclic) for r in L.redirect_roots(df).collect()}
    assert got[1] == (4, False) and got[2] == (4, False) and got[7][1] and got[8][1]


def test_revisions_are_idempotent(spark):
    ledger = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, revision_no int, digest string")
    new = spark.createDataFrame([("a", "y"), ("b", "z")], "id string, digest string")
    first = L.append_revisions(ledger, new, "id", "digest")
    assert pairs(first, "id", "revision_no") == [("b", 1)]
    assert L.append_revisions(ledger.unionByName(first), new, "id", "digest").count() == 0


def test_phrases_longest_wins(spark):
    items = spark.createDataFrame([(1, "the dark souls three is out"), (2, "dark souls")], "id int, t string")
    aliases = spark.createDataFrame([("dark souls", "ds"), ("dark souls three", "ds3"), ("is out", "x"), ("is out", "y")], "alias string, entity string")
    got = pairs(K.link_by_phrase(items, aliases, "id", F.split("t", " ")), "id", "phrase", "status")
    assert got == [(1, "dark souls three", "linked"), (1, "is out", "ambiguous-phrase"), (2, "dark souls", "linked")]


def test_overrides_win(spark):
    items = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", "u3")], "id string, url string")
    links = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "a")], "id string, entity string")
    overrides = spark.createDataFrame([("1", "b"), ("u2", None)], "target string, entity string")
    entities = spark.createDataFrame([("a",), ("b",)], "entity string")
    got = pairs(K.apply_overrides(links, items, overrides, entities, "id", "url"), "id", "origin")
    assert got == [("1", "manual"), ("2", "no-game"), ("3", "automatic")]


def test_registration_keeps_ambiguity_apart(spark):
    rows = [(1, ["steam:1"], "doom", "game", 1993), (2, ["steam:1"], "doom classic", "game", 1993), (3, [], "doom", "game", 2016), (4, [], "doom", "remake", 1993)]
    df = spark.createDataFrame(rows, "candidate int, ids array<string>, alias string, kind string, year int")
    assert sorted(r.records for r in G.register(df, F.lit(1)).collect()) == [1, 1, 2]


def test_gate_and_health(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert pairs(Q.publication_gate(df, "id", {"v": F.col("v") > 1}), "id", "missing", "passed") == [(1, "v", False), (2, "", True)]
    assert Q.retained_fraction(df.limit(0), df, 0.5).first().ok is False
    assert Q.retained_fraction(df, df.limit(0), 0.5).first().ok is True

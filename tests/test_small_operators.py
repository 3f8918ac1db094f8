"""Operators without a query of their own, on rows by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsdesk.functions import text as T
from newsdesk.functions import urls as U
from newsdesk.operators import events as E
from newsdesk.operators import ledger as L
from newsdesk.operators import linking as K
from newsdesk.operators import popularity as P
from newsdesk.operators import quality as Q
from newsdesk.operators import registry as G
from newsdesk.operators import releases as Z
from newsdesk.operators import retention as R
from newsdesk.sources import io


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_candidates_share_one_shape(spark):
    a = spark.createDataFrame([("t", 1)], "title string, year int")
    b = spark.createDataFrame([("u", "s")], "title string, slug string")
    got = io.scan_candidates({"a": a, "b": b}, ["title", "year", "slug"]).select("title", "year", "slug", "origin").collect()
    assert sorted(map(tuple, got)) == [("t", 1, None, "a"), ("u", None, "s", "b")]


def test_publisher_keys(spark):
    df = spark.createDataFrame([("Big launch - IGN", "Google"), ("Big launch", "Kotaku"), ("x - Old Name", "G")], "title string, source string")
    got = [r.k for r in df.select(U.publisher_key(F.col("title"), F.col("source"), {"old name": "new name"}).alias("k")).collect()]
    assert got == ["ign", "kotaku", "new name"]


def test_axes(spark):
    axes = {"setting": {"space": ["spaceship", "orbit"], "west": ["cowboy"]}, "tone": {"dark": ["grim"]}}
    r = spark.createDataFrame([("a grim spaceship in orbit",)], "t string").select(T.infer_axes(F.col("t"), axes).alias("m")).first().m
    assert r == {"setting": ["space"], "tone": ["dark"]}


def test_record_quality(spark):
    df = spark.createDataFrame([("Doom", "d", None), ("app_123", "d", "i")], "title string, slug string, image string")
    assert [r.q for r in df.select(T.record_quality(F.col("title"), slug=F.col("slug"), image=F.col("image")).alias("q")).collect()] == [1, -8]


def test_regional_impact_and_blocked_titles(spark):
    as_of = F.lit("2026-01-10").cast("timestamp")
    df = spark.createDataFrame([("store closes", ["ru"], "2026-01-09"), ("store closes", [], "2026-01-09"), ("hello", ["ru"], "2026-01-09"), ("store closes", ["ru"], "2025-12-01")], "t string, r array<string>, d string").withColumn("ts", F.col("d").cast("timestamp"))
    assert E.regional_impact(df, F.col("t"), F.col("r"), "ts", as_of, "clos(es|ed)").count() == 1
    games = spark.createDataFrame([("Doom", "doom"), ("Doom Soundtrack", "ost"), ("Quake", "quake")], "title string, slug string")
    assert values(P.without_blocked(games, "title", "slug", ["quake"]), "slug") == [("doom",)]


def test_fresh_evidence(spark):
    rows = spark.sql("""SELECT array(named_struct('family', 'news', 'independent', true, 'observed_at', timestamp '2026-01-09'), named_struct('family', 'news', 'independent', true, 'observed_at', timestamp '2025-01-09'),
        named_struct('family', 'live', 'independent', true, 'observed_at', null), named_struct('family', 'news', 'independent', true, 'observed_at', null), named_struct('family', 'news', 'independent', false, 'observed_at', timestamp '2026-01-09')) AS e""")
    got = rows.select(P.fresh_evidence(F.col("e"), F.lit("2026-01-10").cast("timestamp"), 96, ["live"]).alias("f")).first().f
    assert [x.family for x in got] == ["news", "live"]


def test_series_links_only_free_items(spark):
    items = spark.createDataFrame([(1, "new dark souls soon"), (2, "dark souls again"), (3, "mega man x"), (4, "nothing")], "id int, t string")
    linked = spark.createDataFrame([(2, "ds3")], "id int, entity string")
    series = spark.createDataFrame([("dark souls", "ds1"), ("dark souls", "ds2"), ("mega man", "mm")], "name string, entity string")
    assert values(K.link_by_series(items, linked, series, "id", F.split("t", " ")), "id", "status") == [(1, "ambiguous-series"), (3, "linked")]


def test_identity_decisions(spark):
    c = spark.createDataFrame([(1,), (2,), (3,)], "candidate int")
    m = spark.createDataFrame([(1, 10, "match"), (2, 10, "match"), (2, 11, "match")], "candidate int, entity int, decision string")
    assert sorted(map(tuple, G.identity_decisions(c, m).collect()), key=str) == [(1, "matched", 10), (2, "review", None), (3, "new", None)]


def test_merged_entities(spark):
    e = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"]), (3, ["c"])], "id int, aliases array<string>")
    r = spark.createDataFrame([(1, 2)], "source int, target int")
    assert values(L.merge_entities(e, r, "id", ["aliases"]), "id", "aliases", "members") == [(2, ["a", "b"], [1, 2]), (3, ["c"], [3])]


def test_kept_releases_and_unreferenced(spark):
    df = spark.createDataFrame([("2026-01-01", "exact"), ("2026-01-05", "exact"), (None, "tbd")], "d string, p string").withColumn("e", F.col("d").cast("date"))
    assert Z.keep_releases(df, "e", "p", F.lit("2026-01-10").cast("date")).count() == 2
    assert values(R.unreferenced(spark.range(3), spark.range(2), "id"), "id") == [(2,)]


def test_task_summary(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    assert values(Q.task_states(df, "id", {"t": F.col("ok")}, [F.col("id")], 1)[1], "topic", "green", "needs_revision") == [("t", 1, 2)]

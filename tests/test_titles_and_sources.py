"""Titles that hold others, affinity and fallback by title, reasons against sources, profiles from text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import catalog as C
from newsdesk.operators import linking as K
from newsdesk.operators import ratings as R


@pytest.mark.parametrize("least,gram", [(1, 3), (4, 4), (2, 5)])
def test_containment_equals_all_pairs(spark, monkeypatch, least, gram):
    monkeypatch.setattr(K, "HEAVY", 5)  # frequent runs are dealt over several tasks
    rng = random.Random(least)
    word = lambda n: "".join(rng.choices("ab ", k=rng.randrange(n)))
    names, texts = [(i, word(8)) for i in range(60)] + [(99, None)], [(i, word(30)) for i in range(60)] + [(98, None), (97, "")]
    want = {(i, j) for i, n in names for j, t in texts if n and t and len(n) >= least and n in t}
    got = K.title_containment(spark.createDataFrame(names, "i long, title string"), spark.createDataFrame(texts, "j long, title string"), "i", "j", "title", least, gram)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 20


def test_affinity_by_id_title_and_tokens(spark):
    rows = [(1, 7, "star quest ii out now"), (2, None, "star quest ii out now"), (3, None, "quest of a star"), (4, None, "quest"), (5, 8, "star quest ii"), (6, None, "sky"), (7, None, "")]
    rows = [(e, n, t, t.split(), ["eu", "us"], "s", 101) for e, n, t in rows]
    candidates = [(70, 7, "star quest ii", ["star", "quest", "ii"]), (80, 9, "sky", ["sky"]), (90, None, "quest star saga of moon", ["quest", "star", "saga", "of", "moon"])]
    got = K.audience_affinity(spark.createDataFrame(rows, "event long, entity long, title string, tokens array<string>, regions array<string>, source string, score int"), spark.createDataFrame(candidates, "candidate long, entity long, title string, tokens array<string>"))
    # A row with another entity never matches by title; "sky" is too short to stand inside, but equals a title.
    assert {(r.candidate, r.event, r.weight) for r in got.filter("region = 'eu'").collect()} == {(70, 1, 101), (70, 2, 101), (70, 3, 67), (80, 6, 101), (90, 3, 61)}


def test_only_entities_and_items_without_ids_match_by_title(spark):
    items = spark.createDataFrame([(1, ["x:1"], "old star news"), (2, [], "old star news"), (3, ["x:9"], "star port"), (4, [], "star port"), (5, None, "moon")], "k long, ids array<string>, title string")
    entities = spark.createDataFrame([(10, ["x:1"], "star"), (11, ["x:2"], "star"), (12, [], "moo"), (13, None, "moon")], "entity long, ids array<string>, title string")
    got = K.id_or_title(items, entities, "k", "ids", "title", "entity")
    assert sorted(map(tuple, got.collect())) == [(1, 10, "id"), (2, 11, "title"), (4, 11, "title"), (5, 13, "title")]


def test_each_reason_against_a_source(spark):
    rows = [
        ("http://a.example/r/1", "A", "Review", "8", "10", None, []),
        ("http://a.example/r/1", "", "Review", "8", "10", None, ["missing"]),
        ("a.example/r/1", "A", "Review", None, None, "B+", ["missing", "shallow_path"]),
        ("http://a.example/guide/1", "A", None, "8", "10", "", ["forbidden_term"]),
        ("http://www.shop.example/r/1", "A", "x", "8", "10", "", ["forbidden_domain"]),
        ("http://eu.shop.example/r/", "A", "x", "8", "0", " ", ["forbidden_domain", "shallow_path", "no_score"]),
        ("http://myshop.example/r/1?x=/", "A", "x", "eight", "10", "", ["no_score"]),
        ("", None, "", None, None, None, ["missing", "shallow_path", "no_score"]),
    ]
    df = spark.createDataFrame(rows, "url string, publication string, title string, score string, scale string, grade string, want array<string>")
    for r in df.withColumn("got", R.source_reasons(["Guide"], ["shop.example"])).collect():
        assert r.got == r.want, r


def test_sources_are_green_by_counts(spark):
    rows = [("g", i, f"u{i % 3}", f"p{i}", ["no_score"] if i == 0 else []) for i in range(6)] + [("h", 1, "u", "p", [])]
    decided = R.accept_sources(spark.createDataFrame(rows, "game string, o int, url string, publication string, reasons array<string>"), "game", "o", 3)
    assert {(r.o, r.reason) for r in decided.filter("game = 'g'").collect()} == {(0, "no_score"), (1, ""), (2, ""), (3, ""), (4, "duplicate_url"), (5, "duplicate_url")}
    gate = {r.game: (r.accepted, r.contemporary, r.green, r.needs_more) for r in R.source_gate(decided, "game", F.col("o") > 1, 2, 2).collect()}
    assert gate == {"g": (3, 2, True, 0), "h": (1, 0, False, 1)}


def test_profiles_from_free_text(spark):
    texts = spark.createDataFrame([("a", "PC or Xbox, a long story without fights"), ("b", "nothing"), ("c", None)], "profile string, text string")
    needles = spark.createDataFrame([("platform", 1, "pc", "PC"), ("platform", 2, "xbox", "Xbox"), ("time", 1, "long", "long"), ("avoid", 1, "fights", "fights"), ("avoid", 2, "without", "text")], "field string, place int, needle string, value string")
    got = {tuple(r) for r in C.infer_profiles(texts, needles, ("avoid",)).collect()}
    assert got == {("a", "platform", "Xbox"), ("a", "time", "long"), ("a", "avoid", "fights"), ("a", "avoid", "text")}
    catalog = spark.createDataFrame([(1, ["Story", "story", "x"]), (2, ["puzzle"]), (3, [])], "k long, tokens array<string>")
    assert {tuple(r) for r in C.token_bonus(catalog, texts, "k", "tokens").collect()} == {("a", 1, 10.0)}

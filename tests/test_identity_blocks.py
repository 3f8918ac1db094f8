"""members of a class meet other classes as blocks, not as a row for each member and class met."""

from newsdesk.operators import registry as G


def test_members_of_a_class_are_shuffled_as_blocks(spark, monkeypatch):
    sides, real = [], G.dealt
    monkeypatch.setattr(G, "dealt", lambda left, right, on: sides.extend([left.count(), right.count()]) or real(left, right, on))
    kinds = ["game", "edition", "dlc"]
    c = spark.createDataFrame([(i, [f"x:{i}"] if i % 50 == 0 else [], "a b", "a", "game", 1990) for i in range(200)], "candidate int, ids array<string>, alias string, stripped string, kind string, year int")
    e = spark.createDataFrame([(1000 + i, [f"x:{i}"] if i % 100 == 0 else [], [f"a {i % 4}"], ["a"], kinds[i % 3], 1990) for i in range(120)], "entity int, ids array<string>, aliases array<string>, stripped_aliases array<string>, kind string, year int")
    got = G.identity_matches(c, e).collect()
    assert sides == [12, 12]  # one class meets twelve
    assert len({(r["candidate"], r["entity"]) for r in got}) == len(got) == 200 * 120
    assert sorted((r["candidate"], r["entity"]) for r in got if r["confidence"] == 1.0) == [(0, 1000), (100, 1100)]

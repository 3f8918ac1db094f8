"""Identity by classes: pairs of members, dealt over tasks, and counts without them."""

from newsdesk.operators import registry as G


def _tables(spark):
    kinds = ["game", "edition", "dlc"]
    c = [(i, [f"x:{i % 9}"] if i % 4 == 0 else [], "a b" if i % 2 else "a c", "a", kinds[i % 3], 1990 + i % 2 * 3) for i in range(24)]
    e = [(100 + i, [f"x:{i % 9}"] if i % 3 == 0 else [], ["a b", "z"] if i % 2 else ["q"], ["a"] if i % 5 else ["n"], kinds[i % 3], [1990, 1993, None][i % 3]) for i in range(24)]
    return spark.createDataFrame(c, "candidate int, ids array<string>, alias string, stripped string, kind string, year int"), spark.createDataFrame(e, "entity int, ids array<string>, aliases array<string>, stripped_aliases array<string>, kind string, year int"), c, e


def _brute(c, e):
    for k, ids, alias, stripped, kind, year in c:
        for n, own, aliases, shorts, other, then in e:
            same, exact, strip = bool(set(ids) & set(own)), alias in aliases, stripped in shorts
            if not (same or exact or strip):
                continue
            commercial = kind != "dlc" and other != "dlc"
            yield k, n, 1.0 if same else 0.0 if then is not None and year != then else 0.98 if exact and kind == other else 0.9 if exact and commercial else 0.84 if strip and commercial else 0.7 if kind != other else 0.0


def test_members_of_large_classes_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIRS", 2)
    c, e, rows, others = _tables(spark)
    got = sorted((r["candidate"], r["entity"], r["confidence"]) for r in G.identity_matches(c, e).collect())
    assert got == sorted(_brute(rows, others))


def test_counts_are_those_of_the_queue(spark):
    c, e, _, _ = _tables(spark)
    outcomes, queue = G.registration_outcomes(c, G.identity_matches(c, e))
    possible = {r["candidate"]: r["count"] for r in queue.groupBy("candidate").count().collect()}
    want = sorted((r["candidate"], r["decision"], r["entity"] or 0, possible.get(r["candidate"], 0)) for r in outcomes.collect())
    assert sorted((r["candidate"], r["decision"], r["entity"] or 0, r["possible"]) for r in G.registration_counts(c, e).collect()) == want

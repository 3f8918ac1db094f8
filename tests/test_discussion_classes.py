"""Signals with one token set meet members once."""

from newsdesk.operators import events as E


def test_equal_signals_are_one(spark, monkeypatch):
    met = []
    monkeypatch.setattr(E, "overlap_candidates", lambda sets, *a, f=E.overlap_candidates, **k: met.append(sets.count()) or f(sets, *a, **k))
    m = spark.createDataFrame([("c", ["a", "b"]), ("d", ["b", "a"]), ("d", ["x"])], "cluster string, tokens array<string>")
    s = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["b", "a"], 9, i % 2) for i in range(50)], "signal int, tokens array<string>, score int, comments int")
    got = sorted(map(tuple, E.discussion(m, s, "cluster", "tokens").collect()))
    assert [(c, n) for c, n, _ in got] == [("c", 50), ("d", 50)] and met[0] == 3

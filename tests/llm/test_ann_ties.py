"""Distinct vectors that tie at the boundary: the smallest ids are the ones returned."""

from __future__ import annotations

import numpy as np

from newsdesk.llm import ann


def test_ties_of_distinct_vectors_go_to_the_smallest_ids(spark):
    rows = [(i, [1.0, *(float(i >> k & 1) for k in range(9))]) for i in range(300)]
    vectors = dict(rows)
    got = {}
    for r in ann.search(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in range(0, 300, 20):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[c], strict=True)), c) for c in vectors if c != q)[:20]
        assert [got[q][k] for k in range(1, 21)] == [c for _, c in best]


def test_windows_prune_clustered_vectors(spark):
    """On vectors with structure a query meets a small share of the blocks and still finds its neighbours."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 0.2 * rng.normal(size=(6000, 32))
    curves = ann.Curves(x[:4096], 20)
    assert curves.curves * curves.share < 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, block=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    recall = np.mean([len(got[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)])
    print(f"recall {recall:.3f} at {curves.curves} curves of {curves.share:.3f}")
    assert recall >= 0.9

"""Operator 12 against plain scores of all documents, and where its search may stop."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k=10):
    own = [(d, Counter(terms_of(t))) for d, t in docs if d is not None]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, words = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, ts in asked.items():
        scores = []
        for d, c, n in own:
            m = 10 + (90 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def made(spark, docs, items, **kw):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in lexical.search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0)), **kw).select("item_id", "rank", "doc_id", "score").collect())


def random_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "straße", "日本"]
    return [rng.choice((" ", ", ", "_", "  "))[:2].join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_plain_scores(spark, seed):
    texts = random_texts(seed, 120)
    docs = [(i, t) for i, t in enumerate(texts + texts[:40])] + [(None, "w1"), (500, None), (501, ""), (502, "..."), (503, "w7 " * 20000), (3, "w1 w2")]
    items = [(i, t) for i, t in enumerate(random_texts(seed + 9, 12))] + [(0, "w5 W5 w6"), (99, "nowhere"), (98, ""), (97, None), (None, "w1")]
    assert made(spark, docs, items) == plain(docs, items)
    assert made(spark, docs, items, k=3, part_bytes=200) == plain(docs, items, 3)


def test_empty_tables(spark):
    assert made(spark, [], [(1, "a")]) == made(spark, [(1, "a")], []) == made(spark, [], []) == []


def random_shard(rng, n_docs, n_terms, first_id):
    sizes = rng.integers(1, n_terms + 1, n_docs)
    terms = np.concatenate([rng.permutation(n_terms)[:s] for s in sizes])
    impacts = rng.integers(1, 6, sizes.sum()) if rng.random() < 0.5 else (1000 / rng.integers(1, 900, sizes.sum())).astype(np.int64)
    return rng.permutation(n_docs) + first_id, sizes, terms, impacts


@pytest.mark.parametrize("seed", range(20))
def test_shards_one_after_the_other(seed):
    rng = np.random.default_rng(seed)
    n_terms, k, found, scores = 6, 5, [], []
    asked, weights = np.array([0, 2, 5]), np.zeros(6, dtype=np.int64)
    weights[asked] = rng.integers(0, 4, 3)
    for s in range(4):
        ids, sizes, terms, impacts = random_shard(rng, 200, n_terms, 1000 * (3 - s))
        found = lexical.Shard(ids, sizes, terms, impacts, n_terms).best(asked, weights, k, found)
        own = np.split(np.arange(sizes.sum()), np.cumsum(sizes)[:-1])
        scores += [(-int((weights[terms[o]] * impacts[o]).sum()), int(d)) for d, o in zip(ids, own, strict=True)]
        assert found == sorted(x for x in scores if x[0] < 0)[:k]


def test_search_stops_at_best_positions():
    """One document leads all lists: the others are hardly read, and not at all once a bound is known."""
    n, k = 5000, 1
    ids, sizes = np.arange(n), np.full(n, 2)
    impacts = np.repeat(np.arange(n, 0, -1), 2)
    shard = lexical.Shard(ids, sizes, np.tile([0, 1], n), impacts, 2)
    weights = np.array([1, 1])
    found = shard.best(np.array([0, 1]), weights, k, [])
    assert found == [(-2 * n, 0)] and shard.met <= 64
    assert shard.best(np.array([0, 1]), weights, k, [(-2 * n - 1, 7)]) == [(-2 * n - 1, 7)] and shard.met == 0


def test_best_position_runs_ahead_of_reading():
    """Two lists in opposite order: direct accesses mark what reading has not reached."""
    n = 1000
    ids, sizes = np.arange(n), np.full(n, 2)
    up = np.arange(n, 0, -1)
    impacts = np.stack([up, up[::-1]], axis=1).ravel()
    shard = lexical.Shard(ids, sizes, np.tile([0, 1], n), impacts, 2)
    assert shard.best(np.array([0, 1]), np.array([1, 1]), 10, []) == [(-n - 1, i) for i in range(10)]

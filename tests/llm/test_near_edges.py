"""Near copies: hot keys of texts just below the threshold, and rows that share a doc_id."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from newsdesk.llm import near_dedup, substring_dedup


def test_much_boilerplate_just_below_the_threshold(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    common = [word() for _ in range(200)]
    texts = {i: " ".join(common + [word() for _ in range(40)]) for i in range(5000)}
    for i in range(0, 5000, 500):  # near copies among them
        w = texts[i].split()
        texts[10_000 + i] = " ".join([*w[:230], *(word() for _ in range(10))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in texts.items()}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert not linked(1, 2) and linked(0, 10_000)
    # Ten near copies were planted; what is linked must be so, and every planted link must be found.
    want = {i: i - 10_000 if i >= 10_000 and linked(i - 10_000, i) else i for i in texts}
    assert got == want and Counter(got.values())[0] == 2


def test_hot_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 3)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common, texts = [word() for _ in range(60)], []
    for _ in range(150):
        texts.append(" ".join(common[: rng.randint(40, 60)] + [word() for _ in range(rng.choice([1, 5, 9, 14]))]))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "y"), (None, a, None), (4, None, "z")], "doc_id long, text string, sub string").withColumn("_id", F.lit(7))
    kept = near_dedup.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id is None, r.doc_id, r.sub) for r in kept.collect()) == [(False, 1, "x"), (False, 2, "y"), (False, 4, "z"), (True, None, None)]


def test_bytes_sent_for_a_word_hardly_grow_with_partitions():
    import pyarrow as pa

    rng, buffer = np.random.default_rng(0), substring_dedup._Buffer()
    for i in np.sort(rng.choice(10_000_000, 3000, replace=False)).tolist():
        buffer.add(i, int(rng.integers(1 << 32)), rng.integers(0, 1 << 63, int(rng.exponential(340)) + 13, dtype=np.uint64))

    def cost(parts):
        rows = substring_dedup.anchor_entries(buffer, 7, parts, 0)
        return sum(len(pa.compress(b"".join(x for x in r[1:] if x is not None), codec="lz4", asbytes=True)) for r in rows) / buffer.words

    assert cost(2500) < 2 * cost(8) and cost(8000) < 10


def test_asks_of_hot_keys_grow_with_members_alone(spark, monkeypatch):
    """Templates whose texts are just below the threshold: no pair inside a template asks, whichever way frequent shingles are met."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for t in range(8):
        common = [word() for _ in range(42)]
        rows += [(80 * t + i, 80 * t + i, " ".join(common + [word() for _ in range(11)])) for i in range(80)]
    rows += [(9000 + i, 9000 + i, rows[i][2] + " " + word()) for i in range(5)]  # near copies, to be found
    texts = spark.createDataFrame([(n, t) for n, _, t in rows], "node long, text string")
    members = spark.createDataFrame([(n, c) for n, c, _ in rows], "node long, component long").withColumn("others", F.lit(1000))
    for sent in (1 << 20, 0):
        asks = {tuple(r) for r in near_dedup._rare_asks(members, texts, sent=sent).collect()}
        assert {(9000 + i, i) for i in range(5)} <= {tuple(sorted(a, reverse=True)) for a in asks}
        assert len(asks) <= 8 * len(rows) // 10, len(asks)


def test_both_ways_of_meeting_frequent_shingles_agree(spark):
    rng = random.Random(4)
    common = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)]
    texts = [(i, 1000 + i, " ".join(common[rng.randrange(8) : rng.randint(20, 40)] + rng.choices(common, k=rng.randrange(6)))) for i in range(60)]
    rows = spark.createDataFrame(texts, "node long, component long, text string")
    frequent = near_dedup._shingles(rows).groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > near_dedup.RARE)
    sent, joined = ({tuple(r) for r in f(rows, frequent, 75).collect()} for f in (near_dedup._prefixes_sent, near_dedup._prefixes_joined))
    strip = lambda x: {(r[2], r[1], r[4]) for r in x}
    per = lambda x: Counter((r[2], r[1]) for r in x)
    assert per(sent) == per(joined) and strip(sent) == strip(joined)
    assert frequent.count() > 10

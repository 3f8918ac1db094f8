"""Operator 11: the patterns against plain regular expressions, the field on forms that it has not seen, odd rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, span):
    digits = [int(c) for c in span if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def named(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def random_text(rng):
    parts = ["1", "23", "255", "256", "007", "4111111111111111", "4111 1111-1111 1111", "5500005555555559", ".", ".", "@", "+", "-", " ", " ", "(", ")", "a", "b.c", "x_y", "é", "日", "\n", "%", "a@b.c", "1.2.3.4", "+1 (202) 555-0147"]
    return "".join(rng.choices(parts, k=rng.randrange(60)))


def test_patterns_equal_plain_expressions():
    rng = random.Random(5)
    for _ in range(4000):
        text = random_text(rng)
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000, "a." * 150_000 + "@b.c"])
def test_patterns_take_time_in_proportion(text):
    began = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - began < 5


def test_query_on_odd_rows(spark, field):
    rng = random.Random(6)
    texts = [None, "", "no data", "a@b.c", "a@b.c", "1." * 40_000, "x" * 200_000 + " a@b.c", "call (017) 555-7713 now, or +1 (017) 555-7713"] + [random_text(rng) for _ in range(60)]
    rows = [(None if i == 1 else i % 61, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("n_email", F.lit("x"))
    got = sorted(map(tuple, pii.spans_of(docs, field).collect()), key=repr)
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        base = plain(t)
        want.append((d, *(sum(k == x for x, _, _ in base) for k in PLAIN), hashlib.sha256(named(base).encode()).hexdigest()))
    assert [r[:6] for r in got] == sorted(want, key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[7][6] == "phone:5:19,phone:28:45" and by_id[7][7] == 1 and by_id[7][4] == 1
    assert pii.spans_of(docs.limit(0), field).count() == 0


def test_all_base_spans_stay_and_clean_documents_get_none(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.spans_of(docs, field).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    added = sum(r["n_added"] for r in got)
    for r in got:
        assert {named([s]) for s in plain(texts[r["doc_id"]])} <= set(r["spans"].split(",")) | {""}
    assert len(got) == len(texts) and added <= 2


FORMS = {
    "phone": ["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "0049 {0} {1} {2}"],
    "email": ["{3} (at) {4} (dot) org", "{3}[at]{4}[dot]net", "{3} at {4} dot com", "{3} (at) {4}.com"],
    "ip": ["{5}[.]{6}[.]{7}[.]{8}", "{5} . {6} . {7} . {8}"],
}


def test_held_out_forms(field):
    """New words, numbers and sentences; at least nine in ten are found, to the character."""
    rng, right, n, false = random.Random(7), 0, 0, 0
    word = lambda: "".join(rng.choices("bcdfglmnprstaeiou", k=rng.randrange(3, 9)))
    for _ in range(400):
        kind = rng.choice(list(FORMS))
        own = rng.choice(FORMS[kind]).format(f"{rng.randrange(200, 999)}", f"{rng.randrange(200, 999)}", f"{rng.randrange(1000, 9999)}", word(), word(), *(rng.randrange(256) for _ in range(4)))
        text = " ".join(word() for _ in range(8)) + " " + own + ", " * rng.randrange(2) + " " + " ".join(word() for _ in range(8))
        found = [(pii.KINDS[k], text[a:b]) for k, a, b in pii._added(field, [text], [pii.base_spans(text)])[0]]
        right, n = right + ((kind, own) in found), n + 1
        clean = " ".join(rng.choice((word(), str(rng.randrange(10_000)), f"{word()}.", f"{rng.randrange(30)}.{rng.randrange(99)}", f"19{rng.randrange(10, 99)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}")) for _ in range(30))
        false += len(pii._added(field, [clean], [pii.base_spans(clean)])[0])
    assert right >= 0.9 * n and false <= 8, (right, n, false)


def test_marginals_are_those_of_all_labellings():
    """Forward and backward sums, and Viterbi, against all labellings of short stretches."""
    import itertools

    rng = np.random.default_rng(1)
    field = pii.Field()
    for w in field.parameters():
        w += rng.normal(0, 0.3, w.shape)
    symbols, traits, sizes = rng.integers(0, pii.N_SYMBOLS, (2, 4)), rng.integers(0, pii.N_TRAITS, (2, 4)), np.array([4, 3])
    symbols[1, 3], traits[1, 3] = pii._EDGE, pii.N_TRAITS
    e = field.emissions(field.seen(symbols, traits))
    p, _ = field._marginals(e, np.arange(4)[None, :] < sizes[:, None])
    best = field.decode(symbols, traits, sizes)
    for r, n in enumerate(sizes):
        total, mass, top = 0.0, np.zeros((n, pii.N_LABELS)), (-1e9, None)
        for y in itertools.product(range(pii.N_LABELS), repeat=int(n)):
            if y[0] and y[0] % 2 == 0 or any(field.barred[a, b] for a, b in zip(y, y[1:])):
                continue
            s = sum(e[r, t, k] for t, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
            total += np.exp(s)
            mass[np.arange(n), list(y)] += np.exp(s)
            top = max(top, (s, y))
        assert np.allclose(mass / total, p[r, :n]) and tuple(best[r, :n]) == top[1]


def test_long_texts_are_cut_where_nothing_is_near(field, monkeypatch):
    monkeypatch.setattr(pii, "SLICE", 2000)
    text = ("plain words go on here and so they do " * 10 + "call (017) 555-7713 now " + "more plain words of no note at the end of it all " * 9) * 12
    assert len(list(pii._pieces(text))) > 2 and "".join(p for _, p in pii._pieces(text)) == text
    found = pii._added(field, [text], [[]])[0]
    assert [text[a:b] for _, a, b in found] == ["(017) 555-7713"] * 12

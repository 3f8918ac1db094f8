"""Scores of whole documents against a plain computation: edit distances to every term, no automaton, no trie."""

from __future__ import annotations

import math
import random
import re

import numpy as np

from newsdesk.llm import toxicity


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(word: str, scorer) -> tuple[int, str] | None:
    plain = [t for t in scorer.weights if not t.endswith("*")]
    if word in plain:
        return 0, word
    starts = sorted((t for t in scorer.weights if t.endswith("*") and word.startswith(t[:-1])), key=len)
    if starts:
        return 0, starts[0]
    allowed = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
    found = min(((d, t) for t in plain if (d := distance(word, t)) <= allowed(t)), default=None)
    return None if found is None or word in scorer.innocent else found


def plain_score(text: str | None, scorer) -> float:
    marks = '"“”«»„'
    words, quoted = [], []
    for line in (text or "").split("\n"):
        parts = re.split(f"[{marks}]", line)
        for k, part in enumerate(parts):
            own = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in part)) if w]
            words += own
            quoted += [k % 2 == 1 and k < len(parts) - 1] * len(own)
    hits = [(i, h) for i, w in enumerate(words) if (h := nearest(w, scorer))]
    sums, terms = [0.0] * 4, {t for _, (_, t) in hits}
    for i, (errors, term) in hits:
        near = {w.encode() for w in words[max(0, i - toxicity.CONTEXT) : i + toxicity.CONTEXT + 1]}
        weight = max(scorer.weights[term], 0.0)
        if quoted[i] or near & toxicity.REPORTING:
            sums[2] += weight
        else:
            sums[1 if errors else 0] += weight
            sums[3] += weight if near & toxicity.ADDRESS else 0.0
    x = [*map(math.log1p, sums), math.log1p(len(terms)), max((scorer.weights[t] for t in terms), default=0.0), min(1.0, 20 * len(hits) / len(words)) if hits else 0.0]
    z = scorer.model[0] + sum(a * b for a, b in zip(x, scorer.model[1:], strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_equal_a_plain_computation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 40)  # the automaton begins anew many times
    rng = random.Random(7)
    plain = [f"wort{i}é" if i % 5 == 0 else f"word{i}" for i in range(150)]
    slurs = ["scoundrel", "blockhead", "nincompoop", "wretchéd"]
    typo = lambda w: (lambda k: w[:k] + rng.choice(["", "x", w[k] * 2]) + w[k + 1 :])(rng.randrange(len(w)))
    rows = []
    for i in range(500):
        w = rng.choices(plain, k=rng.randint(1, 40))
        if i % 5 == 0:
            for s in rng.choices(slurs, k=3):
                w.insert(rng.randint(0, len(w)), s if rng.random() < 0.6 else typo(s))
        if i % 7 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(["you", "said", '"' + rng.choice(slurs) + '"', "«" + rng.choice(slurs) + " x»", "\n"]))
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, '"')]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(docs, labels.filter(toxicity.in_training()))
    assert {t.endswith("*") for t in scorer.weights} == {True, False} and set(slurs) & set(scorer.weights)  # both kinds of terms
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, folder).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert np.isclose(got[i].score, plain_score(text, scorer), atol=1e-9), (i, text)
        assert got[i].predicted == int(got[i].score >= 0.3)
    held = [r for i, r in got.items() if r.held_out and i < 500]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)

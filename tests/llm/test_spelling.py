"""Operator 13 against plain edits of every word, and its odd rows."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsdesk.llm import spelling

LETTERS = "abcdexyzàßÿ×"


def plain(rows):
    """The contract, word by word."""
    n = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = sorted({c for w in words for c in w})

    def near(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in letters}
        return {x for x in out if x in words and x != w}

    form, n_near = {}, {}
    for w in words:
        of = near(w)
        n_near[w] = len(of)
        best = min(of, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, k in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, k, n_near[w], None if form[w] is None else words[form[w]]))
    return sorted(out)


def made(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    return sorted(tuple(r) for r in spelling.variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect())


def random_rows(seed, n_docs=60):
    rng = random.Random(seed)
    roots = ["".join(rng.choice(LETTERS) for _ in range(rng.choice((4, 5, 5, 6, 7, 9, 17)))) for _ in range(12)]
    roots += ["aaaaa", "aaaaaa", "aaaaaaa", "abab" * 30]
    rows = []
    for d in range(n_docs):
        words = []
        for _ in range(rng.randrange(120)):
            w = rng.choice(roots)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2, 3))):
                i = rng.randrange(len(w) + 1)
                w = w[:i] + rng.choice(("", rng.choice(LETTERS))) + w[i + rng.choice((0, 1)) :]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((rng.choice((d, d % 7)), rng.choice((" ", "1", ", ", "日")).join(words)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_plain_edits(spark, seed):
    rows = random_rows(seed)
    got = made(spark, rows)
    assert got == plain(rows)
    assert any(r[1] for r in got)


def test_groups_cut_into_blocks(spark):
    rows = random_rows(7)
    assert made(spark, rows, block=4) == plain(rows)


def test_odd_rows(spark):
    word = "z" * 3000
    rows = [(None, "Hello hello HELLO"), (1, None), (2, ""), (3, "1 2 日本"), (4, f"{word} {word} {word} {word[1:]}"), (4, "hellp hello hello hello"), (4, "hellp hellp")]
    assert made(spark, rows) == plain(rows)
    assert made(spark, []) == []


def test_a_chain_leads_to_its_last_form(spark):
    rows = [(1, " ".join(["abcde"] * 3 + ["abcdf"] * 6 + ["abcgf"] * 12 + ["abhgf"] * 24 + ["aihgf"] * 48))]
    assert made(spark, rows) == plain(rows)

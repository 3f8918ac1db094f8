"""The whole pipeline against a plain computation, and its stages on odd tables."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from newsdesk.llm import toxicity

from .test_toxicity_brute import plain_score

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def write(spark, folder, docs, labels, bench, columns="doc_id long, text string, lang string"):
    spark.createDataFrame(docs, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def plain_pipeline(docs, bench, scorer):
    docs = [(i, t) for i, t in docs if plain_score(t, scorer) < toxicity.THRESHOLD]
    # Near copies: the smallest id of each component stays.
    sets = [set(zip(*((t or "").lower().split()[k:] for k in range(5)), strict=False)) or ({tuple((t or "").lower().split())} if (t or "").split() else set()) for _, t in docs]
    root = [i for i, _ in docs]
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = [d for d, r in zip(docs, root, strict=True) if d[0] == r]
    # Windows of 13 words that also start in a smaller document.
    first = {}
    for i, t in docs:
        w = (t or "").split()
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    cut = []
    for i, t in docs:
        w, gone = (t or "").split(), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        if gone and len(gone) == len(w):
            continue
        cut.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    # Benchmark windows of ten words.
    def words(t):
        return "".join(c.lower() if c.isascii() else c for c in "".join(c if not c.isascii() or c.isalnum() else " " for c in t or "")).split()

    windows = {tuple(w[k : k + 10]) for _, t in bench for w in [words(t)] for k in range(len(w) - 9)}
    kept = [(i, t) for i, t in cut if not any(tuple(w[k : k + 10]) in windows for w in [words(t)] for k in range(len(w) - 9))]
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for i, t in kept:
        ids = SP.encode(t or "")
        out.append((i, len(ids), hexed(",".join(map(str, ids))), hexed(SP.decode(ids))))
    return sorted(out)


def test_pipeline_equals_a_plain_computation(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(400)] + ["crème", "straße"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, item = text(30), text(14)
    docs = []
    for i in range(300):
        t = text(rng.randint(3, 60))
        if i % 6 == 0:
            t += " scoundrel nincompoop blockhead"
        elif i % 11 == 0:
            t = f"{t} {passage} {text(5)}"
        elif i % 13 == 0:
            t = f"{t} {item}"
        elif i % 17 == 0 and docs[-1][1]:
            t = docs[-1][1] + " tail"
        docs.append((i, t))
    docs += [(400, None), (401, ""), (402, docs[1][1]), (403, docs[1][1]), (404, passage), (405, "  \n ")]
    folder = f"file://{tmp_path}"
    write(spark, folder, [(*d, "en") for d in docs], [(i, int(i % 6 == 0)) for i in range(300)], [(1, item), (2, text(12))])
    scorer = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").filter(toxicity.in_training()))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = plain_pipeline(docs, [(1, item)], scorer)
    assert got == want and 150 < len(want) < 260


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, 1), (1, None, "b", 2, 1), (1, "a b c", "b", None, None), (2, "a b c", "b", 0, 1), (None, "a b c", None, None, 1), (2, "a b c", "b", 0, 1), (3, "x " * 20_000, "", 1, 1)]])
def test_stages_take_odd_tables(spark, tmp_path, rows):
    names = "doc_id long, text string, _at string, sub int, _toxicity int"
    folder = f"file://{tmp_path}"
    write(spark, folder, rows, [(1, None), (None, 1)], [(None, None), (1, "")], names)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("row", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.schema == docs.schema
        assert out.count() == (0 if not rows else 5 if name == "near_dedup" else 7), name

"""Trees that are kept as a table take batch after batch of edits."""

from __future__ import annotations

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsdesk.llm import token_counts
from newsdesk.llm.common import staged

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_later_batches_encode_only_what_they_touch(spark):
    bpe, rng = Tokenizer.from_file(BPE), random.Random(5)
    words = ["alpha", "béta", "gamma.", "x1", "don't", "  ", "\n", "delta,"]
    texts = {i: " ".join(rng.choice(words) for _ in range(n)) for i, n in enumerate((0, 1, 30, 4000))}
    trees = staged(token_counts.build_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), BPE), "trees")
    names = trees.columns
    for _ in range(3):
        rows = []
        for i, text in texts.items():
            data = text.encode()
            for seq in range(3):
                at, removed, new = rng.randint(0, len(data)), rng.choice([0, 2, 9]), rng.choice([" new", "", "é "])
                rows.append((i, seq, at, removed, new))
                while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
                    at -= 1
                end = min(rows[-1][2] + removed, len(data))
                while 0 < end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                data = data[:at] + new.encode() + data[max(at, end) :]
            texts[i] = data.decode()
        edits = spark.createDataFrame(rows, "doc_id long, seq int, at long, removed long, inserted string")
        after = staged(token_counts.apply_edits(token_counts.with_edits(trees, edits), BPE), "trees")
        for r in after.collect():
            assert r.text == texts[r.doc_id] and r.n_tokens == len(bpe.encode(r.text, add_special_tokens=False).ids)
            assert r.n_bytes == len(r.text.encode()) and r.n_bytes_encoded < 300
        trees = after.select(names)
    assert trees.filter(F.octet_length("chunk_bytes") != F.octet_length("chunk_tokens")).count() == 0


def test_a_leaf_that_grows_is_dealt_anew():
    from newsdesk.llm.token_store import BpeEncoder

    encoder = BpeEncoder(BPE)
    tree = token_counts.TokenTree.of(b"a b c d", encoder, 2)
    for _ in range(40):
        tree.edit(3, 0, b" one two three four five six seven eight nine ten eleven twelve thirteen fourteen")
    text = tree.text().decode()
    assert tree.total == len(encoder.tokenizer.encode(text, add_special_tokens=False).ids) and max(len(tree._leaf(i)[0]) for i in range(tree.n)) <= token_counts.FULL

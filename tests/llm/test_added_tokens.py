"""Strings of added tokens inside texts: the ids of an untouched Tokenizer."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from newsdesk.llm import token_counts, token_store

BPE = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = ["a b <|endoftext|> c", END, f"a  {END}\n{END}x", "plain text", None, "", f"é{END}  ü", "<|endoftext", "two  spaces"]


def test_encoder_equals_an_untouched_tokenizer():
    bpe, encoder, rng = Tokenizer.from_file(BPE), token_store.BpeEncoder(BPE, plain_specials=False), random.Random(3)
    parts = [" ", "  ", "\n", "a", "bc", "é", END, "<|", "|>", "你", "1", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)] + [t or "" for t in TEXTS]
    got = encoder.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == [bpe.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.encode(TEXTS[0], add_special_tokens=False).ids == [64, 275, 220, 50256, 269]


def test_queries_keep_the_default(spark, tmp_path):
    bpe = Tokenizer.from_file(BPE)
    folder = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    want = [[*bpe.encode(t or "", add_special_tokens=False).ids, token_store.END_ID] for t in TEXTS]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.op5_token_store(spark, folder).collect()}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for i, ids in enumerate(want)}
    counts = {r.doc_id: r.n_tokens for r in token_counts.op2_token_counts(spark, folder).collect()}
    assert counts == {i: len(ids) - 1 for i, ids in enumerate(want)}
    docs = spark.createDataFrame([(1, "a  b"), (2, f"a{END}b")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 0, 3, 0, END), (2, 0, 3, 4, "")], "doc_id long, seq int, at long, removed long, inserted string")
    edited = {r.doc_id: r.n_tokens_edited for r in token_counts.count_edits(token_counts.with_edits(docs, edits), BPE, plain_specials=False).collect()}
    assert edited == {i: len(bpe.encode(t, add_special_tokens=False).ids) for i, t in ((1, f"a  {END}b"), (2, "a<|ftext|>b"))}

"""What a task holds, and what a worker keeps of it (pipeline, near the memory of an executor)."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from newsdesk.llm import sentencepiece_codec, substring_dedup
from newsdesk.llm.common import tidy

WORDS = 1 << 18


def peak(run) -> int:
    """Bytes that a call holds at most, beyond what was there."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture
def buffer():
    rng, out = np.random.default_rng(3), substring_dedup._Buffer()
    for i in range(256):
        h = rng.integers(0, 1 << 63, WORDS // 256, dtype=np.uint64)
        out.add(i, i, h, np.arange(len(h) - 12))
    return out


def test_buffer_of_words_is_sent_within_a_hundred_bytes_a_word(buffer):
    assert peak(lambda: list(substring_dedup.anchor_entries(buffer, 7, 8, 0))) < 100 * WORDS
    assert peak(lambda: list(substring_dedup.window_entries(buffer, 13, 8, 0))) < 120 * WORDS


def test_answers_of_a_large_partition_are_bounded_and_those_of_the_whole():
    rng, n = np.random.default_rng(4), 1 << 21
    ids, h, tied = rng.integers(0, 50_000, n), rng.integers(0, n // 2, n).astype("<u4"), rng.random(n) < 0.15
    least, most = np.full(n // 2, n), np.full(n // 2, -1)
    np.minimum.at(least, h[tied], ids[tied])
    np.maximum.at(most, h, ids)
    got = substring_dedup.anchor_answers(ids, tied, h)
    assert (got == ((ids > least[h]) | (tied & (ids < most[h])))).all()
    assert peak(lambda: substring_dedup.anchor_answers(ids, tied, h)) < 30 * n
    both = np.empty(n, dtype=substring_dedup.WIDE)
    both["first"], both["second"] = h, h * 7
    np.minimum.at(least := np.full(n // 2, n), h, ids)
    assert (substring_dedup.window_answers(ids, tied, both) == (ids > least[h])).all()


def test_a_hot_hash_stays_in_one_slice():
    h = np.concatenate([np.zeros(600_000), np.arange(600_000)]).astype("<u4")
    slices = list(substring_dedup._slices(h))
    assert len(slices) > 1 and sorted(np.concatenate(slices).tolist()) == list(range(len(h)))
    assert sum((h[s] == 0).any() for s in slices) == 1


def test_table_of_chunks_goes_with_its_task():
    first = sentencepiece_codec.codec(model := public_tokenizers.path(sentencepiece_codec.MODEL))
    text = [b"one two three"]
    assert first.parts(text) and len(first.table.young) == 3
    again = sentencepiece_codec.codec(model)
    assert again.processor is first.processor and not again.table.young
    assert again.round_trips(text) == first.round_trips(text)


def test_arrow_gives_back_at_the_end_of_a_task(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert list(tidy(lambda batches: (b for b in batches))(iter([1, 2]))) == [1, 2] and calls == [1]

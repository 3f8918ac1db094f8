"""Exact substring de-duplication by fixed-block anchors (operator 3).

A repeat of ``window`` words in two documents holds, in the document that is the
reference, at least one whole block of ``window // 2 + 1`` words that starts at a
multiple of that length.  So only non-overlapping blocks are indexed, and every
rolling window of block length probes them:

1. *Anchors.*  Rolling block hashes go to hash partitions, packed to about five
   bytes each; a partition tells which probes meet an indexed block of a smaller
   document, and which blocks are met.
2. *Extension.*  Hits grow to all windows of ``window`` words around them.  Their
   hashes (two of 64 bits each) go to hash partitions that find the smallest
   document of each; later documents lose the window.  Runs of such windows are
   the maximal exact repeats.
3. Covered words are removed from each text.

Hot passages: a task first settles what it can among the documents it has at
hand, so that one hash sends at most a few entries from each buffer of
``BUFFER_WORDS`` words, however often it occurs.

A buffer's documents are named once, in a row of their own; an entry costs its hash,
the gap to the one before, and a share of its document's run (at most one run an
entry), so that the bytes sent for a word don't grow with the number of partitions
as long as a buffer has some tens of words for each: at 100 TB take larger buffers
and partitions (both are parameters of the memory of a task).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cover, free_name, map_batches, mix64, release, staged, table, text_bytes, tidy, utf8, window_hashes, words_of

#: Words in a window.
WINDOW = 13
#: Words that a task gathers before it sends their hashes.
BUFFER_WORDS = 1 << 20
#: Bytes of text for each hash partition.
PARTITION_BYTES = 24 << 20
#: Entries of a hash partition that are held against each other at once (all of one hash, if they are more).
SLICE_ENTRIES = 1 << 18
#: Distinct words whose hashes a task keeps; emptied when full.
WORD_TABLE = 1 << 18

_BLOBS = "p int, buffer long, ids binary, counts binary, low binary, high binary, tied binary, hashes binary, subs binary"
#: Two hashes of a window.
WIDE = np.dtype([("first", "<u8"), ("second", "<u8")])
_REPLIES = "buffer long, ids binary, subs binary, lengths binary, at binary"
_SPOTS = "doc_id long, sub long, at array<int>"


class _Words(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        h = self[word] = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORD_TABLE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class _Buffer:
    """Documents at hand: ids, a hash of each text, and word hashes in one run."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.subs: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.more: list[np.ndarray] = []
        self.words = 0

    def add(self, doc_id: int, sub: int, hashes: np.ndarray, more: np.ndarray | None = None) -> None:
        self.ids.append(doc_id)
        self.subs.append(sub)
        self.hashes.append(hashes)
        if more is not None:
            self.more.append(more)
        self.words += len(hashes)

    def arrays(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, all word hashes, starts of windows that lie in one document, their document, their place in it); places in 32 bits."""
        ids, lengths, run = np.array(self.ids, dtype=np.int64), np.array([len(h) for h in self.hashes], dtype=np.int64), np.concatenate(self.hashes)
        begins = np.cumsum(lengths) - lengths
        fits = np.maximum(lengths - width + 1, 0)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), fits)
        at = np.arange(len(doc), dtype=np.int32) - np.repeat((np.cumsum(fits) - fits).astype(np.int32), fits)
        return ids, lengths, run, at + np.repeat(begins.astype(np.int32), fits), doc, at


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Integers as byte planes: the high ones are mostly zeros, which compress to nothing."""
    return values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _packed(starts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending places as gaps in two byte planes."""
    gaps = np.diff(starts, prepend=0)
    wide = np.minimum(gaps, 0xFFFF).astype(np.uint16)
    far = np.flatnonzero(gaps >= 0xFFFF)  # rare: their gaps follow the high plane as they are
    return (wide & 0xFF).astype(np.uint8).tobytes(), (wide >> 8).astype(np.uint8).tobytes() + gaps[far].astype("<i8").tobytes()


def _unpacked(low: bytes, high: bytes) -> np.ndarray:
    small = np.frombuffer(low, np.uint8)
    gaps = small.astype(np.int64) | np.frombuffer(high[: len(small)], np.uint8).astype(np.int64) << 8
    gaps[gaps == 0xFFFF] = np.frombuffer(high[len(small) :], "<i8")
    return np.cumsum(gaps)


def _blobs(ids: np.ndarray, starts: np.ndarray, tied: np.ndarray, hashes: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of _BLOBS (but for the buffer's number): the entries at ``starts`` (ascending) of documents ``ids``, dealt by ``part``.

    Runs of entries of one document are sent as the step to its id and their number.
    """
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[p] : edges[p + 1]]
        docs = ids[own]
        heads = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1))
        yield (p, _planes(np.diff(docs[heads], prepend=0), "<i8"), _planes(np.diff(np.append(heads, len(own))), "<u4"), *_packed(starts[own]), np.packbits(tied[own]).tobytes(), hashes[own].tobytes(), None)


def _direct(buffer: _Buffer, lengths: np.ndarray, starts: np.ndarray, p: int) -> tuple:
    """The row of _BLOBS that names a buffer's documents, with the places that need no partition's answer."""
    return (p, np.array(buffer.ids, dtype="<i8").tobytes(), lengths.astype("<u4").tobytes(), *_packed(starts), None, None, np.array(buffer.subs, dtype="<u4").tobytes())


def _unpack(row: dict, kind: str | np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document id, whether it starts a block, place in the buffer, hash) of each entry of a blob."""
    hashes = np.frombuffer(row["hashes"], kind)
    ids = np.repeat(np.cumsum(_from_planes(row["ids"], "<i8")), _from_planes(row["counts"], "<u4"))
    return ids, np.unpackbits(np.frombuffer(row["tied"], np.uint8), count=len(hashes)).astype(bool), _unpacked(row["low"], row["high"]).astype("<u4"), hashes


def _spots(row: dict) -> pa.RecordBatch | None:
    """Rows of _SPOTS for a buffer: documents with the places that are answered yes."""
    starts = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in row["at"]]).astype(np.int64))
    if not len(starts):
        return None
    ids, subs, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["subs"], "<u4"), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    doc = np.searchsorted(begins, starts, side="right") - 1
    docs, firsts = np.unique(doc, return_index=True)
    offsets = np.append(firsts, len(doc)).astype(np.int32)
    at = pa.ListArray.from_arrays(pa.array(offsets), pa.array((starts - begins[doc]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(subs[docs].astype(np.int64)), at], ["doc_id", "sub", "at"])


def anchor_entries(buffer: _Buffer, block: int, parts: int, turn: int) -> Iterator[tuple]:
    """Step 1, sending side.

    Of each block hash: in a document one entry, at a block's start if it has one;
    of documents, those before the first with a block, that one, and the last.
    Places that a block at hand already settles go directly.
    """
    ids, lengths, run, starts, doc, at = buffer.arrays(block)
    h = window_hashes(run, block)[starts]
    del run
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)[doc]
    loose = (at % block != 0).astype(np.int8)
    # One entry for each hash, document and text: lexsort puts blocks first.
    order = np.lexsort((at, loose, doc, rank, h)).astype(np.int32)
    hs, ds = h[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    order, hs = order[new], hs[new]
    rs, tied = rank[order], loose[order] == 0
    del ds, rank, loose
    first = np.ones(len(order), dtype=bool)
    first[1:] = hs[1:] != hs[:-1]
    del hs
    group = np.cumsum(first, dtype=np.int32) - 1
    heads = np.flatnonzero(first)
    far = np.int32(np.iinfo(np.int32).max)
    least = np.minimum.reduceat(np.where(tied, rs, far), heads)[group] if len(heads) else rs
    most = np.maximum.reduceat(rs, heads)[group] if len(heads) else rs
    del group
    direct = (rs > least) | (tied & (rs < most))
    # The smallest document with a block and the largest document of all speak for the others at hand.
    send = ~direct | (tied & (rs == least)) | (rs == most)
    keep, settled = np.sort(order[send]), starts[np.sort(order[direct])]
    del order, rs, tied, least, most, direct, send
    part = (mix64(h[keep]) >> np.uint64(40)).astype(np.int64) % parts
    h = (h[keep] & np.uint64(0xFFFFFFFF)).astype("<u4")
    yield from _blobs(ids[doc[keep]], starts[keep], at[keep] % block == 0, h, part, parts)
    yield _direct(buffer, lengths, settled, turn % parts)


def window_entries(buffer: _Buffer, width: int, parts: int, turn: int) -> Iterator[tuple]:
    """Step 2, sending side: of each window hash only the first place in the smallest document at hand; the rest go directly.

    ``buffer.more`` has the starts of candidate windows of each document.
    """
    ids, lengths, run, starts, doc, at = buffer.arrays(width)
    begins = np.cumsum(lengths) - lengths
    wanted = np.zeros(len(run), dtype=bool)
    for b, more in zip(begins, buffer.more, strict=True):
        wanted[b + more] = True
    keep = wanted[starts]
    starts, doc, at = starts[keep], doc[keep], at[keep]
    h = window_hashes(run, width)[starts]
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)[doc]
    order = np.lexsort((at, doc, rank, h)).astype(np.int32)
    hs, rs, ds = h[order], rank[order], doc[order]
    del rank
    first = np.ones(len(order), dtype=bool)
    first[1:] = hs[1:] != hs[:-1]
    heads = np.flatnonzero(first)
    least = rs[heads][np.cumsum(first) - 1] if len(heads) else rs
    direct = rs > least
    again = np.zeros(len(order), dtype=bool)  # repeats inside one text share the fate of its first place
    again[1:] = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
    sent, settled = np.sort(order[~direct & ~again]), starts[np.sort(order[direct & ~again])]
    del order, hs, rs, ds, first, least, direct, again
    # A second hash of the words deals windows out and is compared as well.
    second = window_hashes(mix64(run ^ np.uint64(0xA5A5A5A5A5A5A5A5)), width)[starts[sent]]
    part = (second >> np.uint64(20)).astype(np.int64) % parts
    both = np.empty(len(sent), dtype=WIDE)
    both["first"], both["second"] = h[sent], second
    yield from _blobs(ids[doc[sent]], starts[sent], np.zeros(len(sent), dtype=bool), both, part, parts)
    yield _direct(buffer, lengths, settled, turn % parts)


def _extremes(ids: np.ndarray, h: np.ndarray, tied: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, smallest id of the hash among the tied entries, largest id of all) for each place of that order."""
    order = np.argsort(h, kind="stable") if h.dtype.names is None else np.lexsort((h["second"], h["first"]))
    hs = h[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = hs[1:] != hs[:-1]
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, len(order)))
    i = ids[order]
    least = np.minimum.reduceat(i if tied is None else np.where(tied[order], i, np.iinfo(np.int64).max), heads)
    return order, np.repeat(least, sizes), np.repeat(np.maximum.reduceat(i, heads), sizes)


def _slices(h: np.ndarray) -> Iterator[np.ndarray]:
    """Places of entries in slices of some SLICE_ENTRIES; a hash is in one slice."""
    parts = -(-len(h) // SLICE_ENTRIES)
    if parts < 2:
        yield np.arange(len(h), dtype=np.int32)
        return
    own = (mix64(h.astype(np.uint64) if h.dtype.names is None else h["first"]) % np.uint64(parts)).astype(np.int32)
    for k in range(parts):
        yield np.flatnonzero(own == k).astype(np.int32)


def anchor_answers(ids: np.ndarray, tied: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step 1, receiving side: mask of entries that meet a block of a smaller document, or are a block that a larger one meets."""
    out = np.zeros(len(h), dtype=bool)
    for some in _slices(h):
        order, least, most = _extremes(ids[some], h[some], tied[some])
        order = some[order]
        out[order] = (ids[order] > least) | (tied[order] & (ids[order] < most))
    return out


def window_answers(ids: np.ndarray, tied: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step 2, receiving side: mask of entries whose window also starts in a smaller document."""
    out = np.zeros(len(h), dtype=bool)
    for some in _slices(h):
        order, least, _ = _extremes(ids[some], h[some], None)
        order = some[order]
        out[order] = ids[order] > least
    return out


def _exchange(rows: DataFrame, load: Callable, entries: Callable, answers: Callable, width: int, kind: str | np.dtype, parts: int) -> DataFrame:
    """Sends hashes of rows to partitions and returns the places (_SPOTS) that are answered yes, written as a table."""
    names = [c.split()[0] for c in _BLOBS.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
    reply_names = [c.split()[0] for c in _REPLIES.split(", ")]

    def send(batches):
        words, buffer, turn = _Words(), _Buffer(), 0

        def close():
            number = TaskContext.get().partitionId() << 32 | turn
            rows_ = [(p, number, *rest) for p, *rest in entries(buffer, width, parts, turn)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for item in load(batch, words):
                buffer.add(*item)
                if buffer.words >= BUFFER_WORDS:
                    yield close()
                    buffer, turn = _Buffer(), turn + 1
        if buffer.words:
            yield close()

    def each_row(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a row is large
                yield batch.slice(i, 1).to_pylist()[0]

    def answer(batches):
        p, held, numbers = None, [], []

        def reply(*row):
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], reply_names)

        def close():
            if held:
                ids, tied, h = (np.concatenate([x[k] for x in held]) for k in (0, 1, 3))
                places = [x[2] for x in held]
                held.clear()
                mask, i = answers(ids, tied, h), 0
                for number, starts in zip(numbers, places, strict=True):
                    yes = starts[mask[i : i + len(starts)]]
                    i += len(starts)
                    if len(yes):
                        yield reply(number, None, None, None, yes.tobytes())

        for row in each_row(batches):
            if row["p"] != p:
                yield from close()
                p, held, numbers = row["p"], [], []
            if row["hashes"] is None:
                yield reply(row["buffer"], row["ids"], row["subs"], row["counts"], _unpacked(row["low"], row["high"]).astype("<u4").tobytes())
            else:
                held.append(_unpack(row, kind))
                numbers.append(row["buffer"])
        yield from close()

    def tell(batches):
        for row in each_row(batches):
            if (found := _spots(row)) is not None:
                yield found

    replies = rows.mapInArrow(tidy(send), _BLOBS).repartitionById(parts, F.col("p")).sortWithinPartitions("p").mapInArrow(tidy(answer), _REPLIES)
    # A buffer has a reply from each partition at most, and its words bound their size.
    buffers = replies.groupBy("buffer").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("ids", "subs", "lengths")), F.collect_list("at").alias("at"))
    spots = buffers.mapInArrow(tidy(tell), _SPOTS)
    return staged(spots, "spots")


def _sub() -> Column:
    """32 bits of a text's hash: tells rows with one doc_id apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("sub")


def _gathered(spots: DataFrame, name: str) -> DataFrame:
    """Places of each document in one array; its size is bounded by the document's words."""
    return spots.groupBy("doc_id", "sub").agg(F.flatten(F.collect_list("at")).alias(name))


def repeated_windows(docs: DataFrame, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """(doc_id, sub, at): of docs(doc_id, text), the starts of windows that also start in a document with a smaller doc_id.

    A start stands for all places of the same words in its text.  Rows without
    doc_id or text have none; rows with one doc_id don't count against each other.
    docs should come from a table, whose rows have the same order when read again.
    """
    block = window // 2 + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("sub", _sub())
    parts = parts or max(8, -(-text_bytes(texts) // PARTITION_BYTES))

    def load(batch, words):
        for doc_id, sub, text in zip(batch.column("doc_id").to_pylist(), batch.column("sub").to_pylist(), utf8(batch.column("text")), strict=True):
            w = words_of(text)
            if len(w) >= window:
                yield doc_id, sub, words.of(w)

    def load_hits(batch, words):
        for doc_id, sub, text, at in zip(batch.column("doc_id").to_pylist(), batch.column("sub").to_pylist(), utf8(batch.column("text")), batch.column("hits").to_pylist(), strict=True):
            h = words.of(words_of(text))
            blocks = window_hashes(h, block)
            hits = np.flatnonzero(np.isin(blocks, blocks[np.array(at)]))
            near = cover(np.maximum(hits - (window - block), 0), window - block + 1, len(h))
            more = np.flatnonzero(near[: len(h) - window + 1])
            if len(more):
                yield doc_id, sub, h, more

    anchors = _exchange(texts, load, anchor_entries, anchor_answers, block, "<u4", parts)
    # In a fixed order, so that a task that runs again fills its buffers alike.
    around = texts.join(_gathered(anchors, "hits").hint("shuffle_hash"), ["doc_id", "sub"]).sortWithinPartitions("doc_id", "sub", "text")
    windows = _exchange(around, load_hits, window_entries, window_answers, window, WIDE, parts)
    release(anchors)
    return windows


def _kept(text: bytes | None, at: list[int] | None, words: _Words, window: int) -> tuple[list[bytes], np.ndarray]:
    """(words of a text, mask of those that a repeated window covers)."""
    w = words_of(text)
    if not at:
        return w, np.zeros(len(w), dtype=bool)
    runs = window_hashes(words.of(w), window)
    return w, cover(np.flatnonzero(np.isin(runs, runs[np.array(at)])), window, len(w))


def _with_repeats(docs: DataFrame, window: int, parts: int | None) -> tuple[DataFrame, str]:
    """docs with the starts of repeated windows, and the name of that column, which docs does not have."""
    names = [free_name(n, docs.columns) for n in ("_id", "_sub", "_at", "_key")]
    doc, sub, at, key = names
    found = _gathered(repeated_windows(docs.select("doc_id", "text"), window, parts), "at").select(F.col("doc_id").alias(doc), F.col("sub").alias(sub), F.col("at").alias(at))
    keyed = docs.withColumn(key, _sub())
    return keyed.join(found.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(key) == F.col(sub)), "left").drop(doc, sub, key), at


def scan(docs: DataFrame, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space).

    Null and empty texts have no words, and texts shorter than a window lose none.
    """

    def make():
        words = _Words()

        def each(batch):
            n, removed, sha = [], [], []
            for text, at in zip(utf8(batch.column("text")), batch.column(name).to_pylist(), strict=True):
                w, gone = _kept(text, at, words, window)
                n.append(len(w))
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g] if removed[-1] else w)).hexdigest())
            return [batch.column("doc_id"), n, removed, sha]

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeats, name = _with_repeats(rows, window, parts)
    return map_batches(repeats, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """docs, columns unchanged, without the words of repeated windows.

    Texts without a repeat stay as they are; the others become their kept words,
    joined by one space, and documents of which no word is left go.
    """
    names = docs.columns
    repeats, name = _with_repeats(docs, window, parts)

    def run(batches):
        words = _Words()
        for batch in batches:
            texts, keep = [], []
            for text, at in zip(utf8(batch.column("text")), batch.column(name).to_pylist(), strict=True):
                if at:
                    w, gone = _kept(text, at, words, window)
                    text = b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
                    keep.append(not gone.all())
                else:
                    keep.append(True)
                texts.append(text)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return repeats.mapInArrow(tidy(run), docs.schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ORACLE_OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h, md5_number(array_to_string(w[i:i + 12], ' ')) AS m
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT h, m, min(doc_id) AS first_doc FROM g GROUP BY h, m HAVING count(*) > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f USING (h, m) WHERE f.first_doc < g.doc_id) GROUP BY doc_id),
x AS (SELECT w.doc_id, w.w, coalesce(c.gone, []) AS gone FROM w LEFT JOIN c USING (doc_id)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, gone, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM x) WHERE NOT list_contains(gone, i) GROUP BY doc_id)
SELECT x.doc_id, CAST(len(x.w) AS BIGINT) AS n_words, CAST(len(x.gone) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM x LEFT JOIN k USING (doc_id)
"""

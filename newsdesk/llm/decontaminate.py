"""Benchmark decontamination by a broadcast set of n-gram hashes (operator 1).

The benchmark's windows are hashed into a set that every task receives: sorted
arrays of hashes, places and items, beside the normalised text that they were cut
from.  A task scans each document once with rolling hashes of its words, verifies
every hit against that text, and marks, removes or rejects.  The broadcast is
checked: beyond ``BROADCAST_BYTES`` of benchmark text (some seven times that as
arrays) the set is dealt into parts by item, each within the bound; then the
documents are written once with row numbers, scanned for each part, and only hits
are joined to them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from .common import cover, folded_words, free_name, map_batches, staged, table, text_bytes, utf8, window_hashes
from .substring_dedup import _Words

#: Words in a window.
WINDOW = 10
#: Benchmark text whose windows are broadcast at once.
BROADCAST_BYTES = 16 << 20


class BenchmarkWindows:
    """The windows of benchmark items, by length and hash, with the text that verifies them.

    Rows without an item id mark words like others, but are no items.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        words, self.names, texts, at = _Words(), [], [], 0
        starts, ends, parts = [], [], {}
        first = 0  # number of the item's first word
        known: dict[str, int] = {}
        for item, text in items:
            own = folded_words(text)
            if not own:
                continue
            name = -1 if item is None else known.setdefault(str(item), len(known))
            long = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            begin = at + np.cumsum(long + 1) - (long + 1)
            starts.append(begin.astype(np.int32))
            ends.append((begin + long).astype(np.int32))
            texts.append(b" ".join(own))
            at += len(texts[-1]) + 1
            n = min(window, len(own))
            h = window_hashes(words.of(own), n)
            parts.setdefault(n, []).append((h, np.arange(first, first + len(h), dtype=np.int32), np.full(len(h), name, dtype=np.int32)))
            first += len(own)
        self.names = list(known)
        self.text = b"\n".join(texts)
        self.starts, self.ends = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (starts, ends))
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for n, own in parts.items():
            h, place, item = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.argsort(h, kind="stable")
            distinct, group = np.unique(h[order], return_index=True)
            self.tables[n] = distinct, np.append(group, len(h)), place[order], item[order]
        self.seen: dict[tuple[int, int], dict[bytes, frozenset[int]]] = {}
        self.words = _Words()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}, "words": _Words()}

    def _window(self, n: int, k: int) -> dict[bytes, frozenset[int]]:
        """Texts of the windows with hash number k, and their items; kept once it has been met."""
        if (n, k) not in self.seen:
            _, group, place, item = self.tables[n]
            found: dict[bytes, set[int]] = {}
            for e in range(group[k], group[k + 1]):
                p = place[e]
                found.setdefault(self.text[self.starts[p] : self.ends[p + n - 1]], set()).add(int(item[e]))
            self.seen[n, k] = {t: frozenset(i for i in own if i >= 0) for t, own in found.items()}
        return self.seen[n, k]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(mask of hit words, items that occur) of a document's words."""
        mask, items = np.zeros(len(words), dtype=bool), set()
        hashed = self.words.of(words)
        for n, (hashes, *_) in self.tables.items():
            if len(words) < n:
                continue
            h = window_hashes(hashed, n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            true = []
            for i in np.flatnonzero(hashes[at] == h).tolist():
                found = self._window(n, int(at[i])).get(b" ".join(words[i : i + n]))
                if found is not None:
                    true.append(i)
                    items |= found
            if true:
                mask |= cover(np.array(true), n, len(words))
        return mask, {self.names[i] for i in items}


def _parts(benchmark: DataFrame, item: str, text: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of about ``limit`` bytes at most, dealt by item; one part if it is small."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    n = -(-text_bytes(rows) // limit) or 1
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _windows(part: DataFrame, window: int):
    items = [(r["item"], r["text"].encode() if r["text"] is not None else None) for r in part.collect()]
    return part.sparkSession.sparkContext.broadcast(BenchmarkWindows(items, window))


MARKS = "mask binary, items array<string>, hits long"


def _marked(rows: DataFrame, held, names: tuple[str, ...], only_hits: bool = False) -> DataFrame:
    """rows with the mask, the sorted items and the number of hit words of one part of the benchmark under ``names``."""
    kinds = (pa.binary(), pa.list_(pa.string()), pa.int64())
    schema = StructType(list(rows.schema))
    for name, kind in zip(names, (BinaryType(), ArrayType(StringType()), LongType()), strict=True):
        schema = schema.add(name, kind)

    def run(batches):
        windows = held.value
        for batch in batches:
            found = [windows.scan(folded_words(t)) for t in utf8(batch.column("text"))]
            columns = [m.tobytes() for m, _ in found], [sorted(i) for _, i in found], [int(m.sum()) for m, _ in found]
            out = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names, *names])
            yield out.filter(pa.array([n > 0 for n in columns[2]])) if only_hits else out

    return rows.mapInArrow(run, schema)


def _joined(hits: DataFrame, row: str) -> DataFrame:
    """hits(row, mask, items, hits) of all parts, one row each: masks united, items without repeats.  A row has one entry a part at most."""

    def make():
        def each(batch):
            masks, items, counts = [], [], []
            for own in batch.column("own").to_pylist():
                mask = np.bitwise_or.reduce([np.frombuffer(o["mask"], dtype=np.uint8) for o in own])
                masks.append(mask.tobytes())
                counts.append(int(mask.sum()))
                items.append(sorted(set().union(*(o["items"] for o in own))))
            return [batch.column(row), masks, items, counts]

        return each

    grouped = hits.groupBy(row).agg(F.collect_list(F.struct("mask", "items")).alias("own"))
    return map_batches(grouped, make, f"{row} long, {MARKS}")


def _mark(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_bytes: int, names: tuple[str, ...]) -> DataFrame:
    parts = _parts(benchmark, "item_id", "text", broadcast_bytes)
    if len(parts) == 1:
        return _marked(docs, _windows(parts[0], window), names)
    row = free_name("row", [*docs.columns, *names])
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    hits = None
    for part in parts:
        one = _marked(rows.select(row, "text"), _windows(part, window), ("mask", "items", "hits"), True).select(row, "mask", "items", "hits")
        hits = one if hits is None else hits.unionByName(one)
    found = _joined(staged(hits, "hits"), row).select(F.col(row).alias("_r"), *(F.col(c).alias(f"_{c}") for c in ("mask", "items", "hits")))
    full = rows.join(found, rows[row] == found["_r"], "left")
    # A document without a hit has a byte for each of its words as well.
    clean = _marked(rows.select(row, "text"), _windows(benchmark.limit(0).select(F.lit("").alias("item"), F.lit("").alias("text")), window), ("mask", "items", "hits")).select(F.col(row).alias("_r0"), F.col("mask").alias("_m0"))
    full = full.join(clean, rows[row] == clean["_r0"])
    return full.select(*(rows[c] for c in docs.columns), F.coalesce("_mask", "_m0").alias(names[0]), F.coalesce("_items", F.array().cast("array<string>")).alias(names[1]), F.coalesce("_hits", F.lit(0)).cast("long").alias(names[2]))


_NAMES = ("_bench_mask", "_bench_items", "_bench_hits")


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with ``_bench_mask`` (binary, a byte for each word: 1 if a benchmark window covers it), ``_bench_items`` (sorted ids) and ``_bench_hits`` (words).

    Null and empty texts have no words.  Items without words have no window; an
    item_id counts once, however many rows carry it; a null item_id is no item, but
    its windows mark words.  Columns of docs that have the new names are replaced.
    """
    return _mark(docs.drop(*_NAMES), benchmark, window, broadcast_bytes, _NAMES)


def _own_names(docs: DataFrame) -> tuple[str, ...]:
    return tuple(free_name(n, docs.columns) for n in _NAMES)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0); repeated rows one by one."""

    def make():
        def each(batch):
            masks = [np.frombuffer(m, dtype=bool) for m in batch.column("_bench_mask").to_pylist()]
            items = batch.column("_bench_items").to_pylist()
            hits = [int(m.sum()) for m in masks]
            return [batch.column("doc_id"), [len(m) for m in masks], hits, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], [h > 0 for h in hits]]

        return each

    marked = mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, broadcast_bytes)
    return map_batches(marked.select("doc_id", "_bench_mask", "_bench_items"), make, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def reject(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, columns unchanged, without the documents that hold a benchmark window."""
    names = _own_names(docs)
    return _mark(docs, benchmark, window, BROADCAST_BYTES, names).filter(F.col(names[2]) == 0).select(docs.columns)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _without(text: bytes, mask: np.ndarray) -> bytes:
    """text without its marked words and what stands between them."""
    out, at, before = [], 0, False
    for m, hit in zip(_WORD.finditer(text), mask, strict=True):
        if hit and not before:
            out.append(text[at : m.start()])
        if hit or before:
            at = m.end() if hit else at
        before = bool(hit)
    out.append(text[at:])
    return b"".join(out)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, columns unchanged, with the words of benchmark windows cut out of each text; clean texts stay as they are."""
    names, (mask, *_) = docs.columns, (own := _own_names(docs))
    marked = _mark(docs, benchmark, window, BROADCAST_BYTES, own)

    def run(batches):
        for batch in batches:
            texts = [t if t is None or not any(m) else _without(t, np.frombuffer(m, dtype=bool)) for t, m in zip(utf8(batch.column("text")), batch.column(mask).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return marked.mapInArrow(run, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_OP1 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
d AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM b))),
h AS (SELECT d.doc_id, d.n, d.i, b.item FROM d JOIN b ON d.win = b.win AND d.n = b.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

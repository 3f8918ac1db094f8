"""Ranked lexical search by the Best Position Algorithm (operator 12).

Documents are cut into words once; of each, its length and the counts of the terms
that some item asks for are written as a table, whose sums are the corpus figures.
Then each task deals the documents that it reads into shards of bounded size.  A shard
holds an impact list for each term (documents by falling impact) and, for direct
access, each document's own terms with their places in these lists.

For an item, the lists of its terms are read in rounds of growing depth.  A document
that is met is looked up at once in all lists: that gives its score, and marks its
places there as seen.  The best position of a list ends its unbroken run of seen
places from the top; no unseen document can score more than the sum of the impacts
there.  The search of a shard stops when that sum is strictly below the score of the
k-th document that the task has found in any shard so far, so that equal scores are
all met and the smaller doc_id wins.  Each task hands on k rows an item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folded_words, map_batches, release, slices, staged, table, text_bytes, utf8

#: Documents that an item gets.
TOP = 10
#: Item text whose terms are looked for at once; a larger table of items is dealt into parts.
PART_BYTES = 4 << 20
#: Postings and documents of a shard, from which on it is searched.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 15
#: Places of each list that are read first; each round reads as many as all before.
DEPTH = 16


class Items:
    """Items and the numbers of their terms."""

    def __init__(self, rows: list[tuple[str, bytes | None]]):
        own: dict[str, set[bytes]] = {}
        for item, text in rows:
            own.setdefault(item, set()).update(folded_words(text))
        self.names = list(own)
        self.numbers = {t: i for i, t in enumerate(sorted(set().union(*own.values())))}
        self.terms = [np.array(sorted(self.numbers[t] for t in ts), dtype=np.int64) for ts in own.values()]


def _counted(docs: DataFrame, held) -> DataFrame:
    """(doc_id, n, terms, times): words of each document that has any, and the numbers and counts of terms that are asked for."""

    def make():
        numbers = held.value.numbers

        def each(batch):
            ids, n, size, terms, times = [], [], [0], [], []
            at = iter(batch.column("doc_id").to_pylist())
            for part in slices(utf8(batch.column("text"))):
                for text in part:
                    doc_id, words = next(at), folded_words(text)
                    if not words:
                        continue
                    counts = Counter(words)
                    asked = counts.keys() & numbers.keys()
                    ids.append(doc_id)
                    n.append(len(words))
                    terms += map(numbers.__getitem__, asked)
                    times += map(counts.__getitem__, asked)
                    size.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (times, pa.int64()))]
            return [ids, n, *lists]

        return each

    return map_batches(docs, make, "doc_id long, n long, terms array<int>, times array<long>")


def _holders(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: each task counts its own, and sends a row a term that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["term", "n"])

    out = np.zeros(n_terms, dtype=np.int64)
    for r in counted.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


class Shard:
    """Impact lists of some documents, and each document's postings for direct access."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        # Documents by doc_id, so that a smaller number is a smaller doc_id.
        order = np.argsort(ids, kind="stable")
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.ids, sizes = ids[order], sizes[order]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        take = _ranges(first[:-1][order], sizes)
        self.terms, self.impacts = terms[take], impacts[take]
        doc = np.repeat(np.arange(len(ids)), sizes)
        by_impact = np.lexsort((doc, -self.impacts, self.terms))
        self.list_doc, self.list_impact = doc[by_impact], self.impacts[by_impact]
        self.place = np.empty(len(by_impact), dtype=np.int64)
        self.place[by_impact] = np.arange(len(by_impact))
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=n_terms))])

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, doc_id) of ``found`` and of this shard for the terms; ``weights`` has one of each term, 0 for others.

        ``found`` is sorted; its k-th score bounds the search from the start.
        """
        self.met = 0
        begin, end = self.begin[terms], self.begin[terms + 1]
        held = end > begin
        begin, end, w = begin[held], end[held], weights[terms[held]]
        if not len(begin):
            return found
        position, seen = begin.copy(), np.zeros(len(self.place), dtype=bool)
        met, depth, read = np.zeros(len(self.ids), dtype=bool), DEPTH, begin.copy()
        while True:
            # What an unseen document can score at most: its places are at the best positions or below.
            most = int((w * np.where(position < end, self.list_impact[np.minimum(position, end - 1)], 0)).sum())
            if most == 0 or len(found) == k and most < -found[-1][0]:
                return found
            upto = np.minimum(begin + depth, end)
            docs = np.unique(self.list_doc[_ranges(read, upto - read)])
            docs = docs[~met[docs]]
            met[docs] = True
            self.met += len(docs)
            read, depth = upto, 2 * depth
            if len(docs):
                sizes = self.first[docs + 1] - self.first[docs]
                own = _ranges(self.first[docs], sizes)
                seen[self.place[own]] = True
                score = np.add.reduceat(weights[self.terms[own]] * self.impacts[own], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                if len(found) == k:
                    good = score >= -found[-1][0]
                    docs, score = docs[good], score[good]
                if len(docs) > k:  # documents with smaller numbers first among equals
                    top = np.lexsort((docs, -score))[:k]
                    docs, score = docs[top], score[top]
                found = sorted(found + [(-s, d) for s, d in zip(score.tolist(), self.ids[docs].tolist(), strict=True) if s > 0])[:k]
            for i in range(len(position)):
                position[i] = _run_end(seen, int(position[i]), int(end[i]))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those from start[1], and so on."""
    total = int(size.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(start - (ends - size), size)


def _run_end(seen: np.ndarray, at: int, end: int, step: int = 256) -> int:
    """The first place from ``at`` on that is not seen; ``end`` if all are."""
    while at < end:
        part = seen[at : min(at + step, end)]
        k = int(part.argmin())
        if not part[k]:
            return at + k
        at, step = at + len(part), 4 * step
    return end


def _ranked(counted: DataFrame, held, figures, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (weights, n_docs, n_words) = held.value, figures.value
        own = np.zeros(len(weights), dtype=np.int64)
        found: list[list[tuple[int, int]]] = [[] for _ in items.terms]
        parts: list[tuple[np.ndarray, ...]] = []
        postings = docs = 0

        def search() -> None:
            ids, sizes, terms, impacts = (np.concatenate(x) for x in zip(*parts, strict=True))
            shard = Shard(ids, sizes, terms, impacts, len(weights))
            for i, terms in enumerate(items.terms):
                own[terms] = weights[terms]
                found[i] = shard.best(terms, own, k, found[i])
                own[terms] = 0

        for batch in batches:
            n, lists = batch.column("n").to_numpy(), batch.column("terms")
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            m = 10 + (90 * n * n_docs) // n_words
            times = batch.column("times").flatten().to_numpy()
            impacts = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, sizes))
            keep = sizes > 0
            parts.append((batch.column("doc_id").to_numpy()[keep], sizes[keep], lists.flatten().to_numpy().astype(np.int64), impacts))
            postings, docs = postings + len(impacts), docs + int(keep.sum())
            if postings >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                search()
                parts, postings, docs = [], 0, 0
        if postings:
            search()
        rows = [(i, d, -s) for i, of in enumerate(found) for s, d in of]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def _part(docs: DataFrame, rows: list[tuple[str, bytes | None]], k: int) -> DataFrame:
    """(item_id, doc_id, score): the candidates of some items; their impact lists are read again when the result is."""
    spark, items = docs.sparkSession, Items(rows)
    held = spark.sparkContext.broadcast(items)
    counted = staged(_counted(docs, held), "term-counts")
    n_docs, n_words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _holders(counted, len(items.numbers))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    figures = spark.sparkContext.broadcast((weights, n_docs, max(n_words, 1)))
    names = items.names
    best = staged(map_batches(_ranked(counted, held, figures, k), lambda: lambda b: [[names[i] for i in b.column("item").to_pylist()], b.column("doc_id"), b.column("score")], "item_id string, doc_id long, score long"), "best")
    release(counted)
    return best


def search(docs: DataFrame, items: DataFrame, k: int = TOP, part_bytes: int = PART_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs(doc_id, text) for each of items(item_id, text).

    Null and empty texts have no terms, and such documents don't count; rows without
    doc_id or item_id are no documents and no items.  Rows that share an item_id are one
    item with the terms of all; rows that share a doc_id are documents of their own.
    Equal scores are ranked by doc_id.  Other columns are not read.  An item whose terms no
    document holds gets no row, nor do any from an empty table.
    """
    kind = items.schema["item_id"].dataType
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL")
    n = max(1, -(-text_bytes(asked) // part_bytes))
    found = None
    for part in range(n):
        rows = [(r["item_id"], r["text"].encode() if r["text"] is not None else None) for r in (asked if n == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part)).collect()]
        best = _part(texts, rows, k)
        found = best if found is None else found.unionAll(best)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE_OP12 = f"""
WITH counts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE doc_id IS NOT NULL) GROUP BY ALL),
lengths AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
figures AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_words FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, figures WHERE term IN (SELECT term FROM asked) GROUP BY term, all_docs
),
impacts AS (
  SELECT c.doc_id, c.term, (1000000000 * c.tf) // (1000 * c.tf + 8 * (10 + (90 * l.n * f.all_docs) // f.all_words)) AS impact
  FROM counts c JOIN lengths l USING (doc_id), figures f
),
scores AS (
  SELECT a.item_id, i.doc_id, sum(w.w * i.impact)::BIGINT AS score
  FROM asked a JOIN weights w USING (term) JOIN impacts i USING (term) GROUP BY a.item_id, i.doc_id HAVING sum(w.w * i.impact) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""

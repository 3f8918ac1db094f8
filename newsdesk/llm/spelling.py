"""Spelling variants grouped by a bit-sliced position index (operator 13).

Words are counted over all texts, each task adding up its own first.  Two words that
differ by one insertion, deletion or replacement agree in the first half of the
shorter one, or else in its other half at the end of both.  So each word goes to the
groups of its halves, for its own length and the one below, and a pair is told in one
group alone: that of the first half if these are equal, else that of the last.  Groups
of more words than a block holds are cut into blocks that each word of the group asks.

In a block, one bitset over its words stands for each (position, letter).  For many
asking words at once, recurrences over positions hold the set of words met without an
error and the sets met with one error (same place, one back, one on), 64 words an
operation; no pair is written.  Words lie in the order of their counts, so that the
lowest bit of a result is the most frequent near word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_partitions, release, staged, table

#: Code points and occurrences that a word needs.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form must occur so many times as often as its word.
RATIO = 2
#: One run in so many, by hash, loses a code point.
SLIP = 97
#: Words of a block, if they have 16 letters at most; longer ones count for more.
BLOCK = 2048
#: Bits of a set of results that is worked on at once, and asking words that are kept at most.
AT_ONCE, KEPT = 1 << 21, 1 << 16
#: Distinct words that a task adds up before it hands them on.
COUNTED = 400_000

#: Lower-cases A-Z, keeps a-z and C0-FF of Latin-1, and makes all else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Numbers of the letters: a-z, then C0-FF.
_CODES = np.array([c - 97 if 97 <= c <= 122 else c - 0xC0 + 26 if c >= 0xC0 else 90 for c in range(256)], dtype=np.uint8)
_N_CODES = 91


def runs_of(text: str | None) -> list[bytes]:
    """Runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text in Latin-1, A-Z lower-cased; none for null."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def _add_words(total: dict[bytes, int], doc_id: object, text: str | None) -> None:
    """Adds a document's words of the least length, some runs losing a code point by the hash of id and run."""
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, k in Counter(runs_of(text)).items():
        if len(run) >= LEAST_LENGTH:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
            if h % SLIP == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
            total[run] = total.get(run, 0) + k


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of docs(doc_id, text) that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for k, text in enumerate(batch.column("text")):
                _add_words(total, ids[k], text.as_py())
                if len(total) >= COUNTED:
                    yield out()
                    total = {}
        if total:
            yield out()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _asked(words: DataFrame, block: int) -> DataFrame:
    """(tail, least, half, sub, subs, own, word, n): for each word the groups, and in each the blocks, that it asks; ``own`` where it lies itself."""
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("least"), length.alias("length")).filter(F.col("least") >= LEAST_LENGTH)
    head = F.floor(F.col("least") / 2).cast("int")
    halves = both.select("word", "n", "least", F.explode(F.array(F.struct(F.lit(0).alias("tail"), F.expr("substring(word, 1, int(least div 2))").alias("half")), F.struct(F.lit(1).alias("tail"), F.expr("right(word, int(least - least div 2))").alias("half")))).alias("of"), head.alias("head")).select("word", "n", "least", "of.tail", "of.half")
    group = ["tail", "least", "half"]
    large = halves.groupBy(*group).agg(F.count(F.lit(1)).alias("held")).select(*group, F.ceil(F.col("held") * F.greatest(F.lit(16), F.col("least") + 1) / (16 * block)).cast("int").alias("subs")).filter("subs > 1")
    dealt = halves.join(large, group, "left").withColumn("subs", F.coalesce("subs", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("subs")).cast("int")
    return dealt.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(*group, "sub", "subs", (F.col("sub") == own).alias("own"), "word", "n")


class PositionIndex:
    """Bitsets over words, of lengths ``least`` and ``least + 1``, for each position and letter; the most frequent words first."""

    def __init__(self, words: list[bytes], counts: list[int], least: int):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words, self.counts, self.least = [words[i] for i in order], [counts[i] for i in order], least
        n, width = len(words), -(-len(words) // 64) * 64
        codes = _letters(self.words, least + 1)
        at = np.zeros((least + 1, _N_CODES, width), dtype=bool)
        at[np.arange(least + 1)[:, None], codes.T, np.arange(n)[None, :]] = True
        self.at = np.packbits(at, axis=-1, bitorder="little").view(np.uint64)
        long = np.zeros(width, dtype=bool)
        long[:n] = np.fromiter(map(len, self.words), dtype=np.int64, count=n) > least
        short = np.zeros(width, dtype=bool)
        short[:n] = ~long[:n]
        self.short, self.long = (np.packbits(x, bitorder="little").view(np.uint64) for x in (short, long))

    def near(self, asking: list[bytes], tail: int) -> tuple[np.ndarray, np.ndarray]:
        """For asking words of one length: how many words differ by one error, their first halves being equal (or not, for ``tail``), and the first of these (-1: none)."""
        m, least, at = len(asking[0]), self.least, self.at
        q, head = _letters(asking, m).astype(np.intp), least // 2
        zero = np.broadcast_to(self.short | self.long, (len(asking), at.shape[-1]))
        same = back = on = np.zeros_like(zero)
        equal = zero
        for i in range(m):
            here = at[i, q[:, i]]
            if m == least:  # words as long, and longer by one
                same = (same & here) | (zero & ~here)
                on = (on | zero) & at[i + 1, q[:, i]]
            else:  # words shorter by one
                back = (back & at[i - 1, q[:, i]]) | zero if i else zero
            zero = zero & here
            if i + 1 == head:
                equal = zero
        found = (same & self.short) | ((on | zero) & self.long) if m == least else back & self.short
        found = found & ~equal if tail else found & equal
        n = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
        block = (found != 0).argmax(axis=1)
        lowest = found[np.arange(len(asking)), block]
        bit = np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return n, np.where(n > 0, block * 64 + bit, -1)


def _letters(words: list[bytes], width: int) -> np.ndarray:
    """Letter numbers of words by place, the last number standing for no letter."""
    flat = np.frombuffer(b"".join(w.ljust(width) for w in words), dtype=np.uint8)
    return _CODES[flat].reshape(len(words), width)


def _near_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows that come sorted by (tail, least, half, sub) with their own words first."""
    kind, group, alone = None, None, False
    words: list[bytes] = []
    counts: list[int] = []
    asking: list[bytes] = []

    def told() -> Iterator[pa.RecordBatch]:
        index = PositionIndex(words, counts, kind[1])
        found: list[tuple[bytes, int, int, bytes]] = []
        for length in (kind[1], kind[1] + 1):
            of = [w for w in asking if len(w) == length]
            step = max(1, AT_ONCE // max(len(words), 64))
            for a in range(0, len(of), step):
                n, first = index.near(of[a : a + step], kind[0])
                found += [(of[a + i], int(n[i]), index.counts[first[i]], index.words[first[i]]) for i in np.flatnonzero(n).tolist()]
        if found:
            word, n, best_n, best = zip(*found, strict=True)
            text = [pa.array([w.decode("latin-1") for w in x], pa.string()) for x in (word, best)]
            yield pa.RecordBatch.from_arrays([text[0], pa.array(n, pa.int64()), pa.array(best_n, pa.int64()), text[1]], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        names = ("tail", "least", "half", "sub", "subs", "own", "word", "n")
        for tail, least, half, sub, subs, own, word, n in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if (tail, least, half, sub) != group:
                room = BLOCK * 16 // max(16, least + 1)
                if words and ((tail, least) != kind or alone or subs > 1 or len(words) >= room):
                    yield from told()
                    words, counts, asking = [], [], []
                elif not words:
                    asking = []
                kind, group, alone = (tail, least), (tail, least, half, sub), subs > 1
            elif len(asking) >= KEPT and not own:
                if words:
                    yield from told()
                asking = []
            w = word.encode("latin-1")
            if own:
                words.append(w)
                counts.append(n)
            asking.append(w)
    if words and asking:
        yield from told()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best): for each of words(word, n) with a near word, how many it has, and the most frequent of them (ties: the first in code-point order)."""
    rows = _asked(words, block)
    group = ["tail", "least", "half", "sub"]
    dealt = rows.repartition(max(default_partitions(words.sparkSession), 1), *group).sortWithinPartitions(*group, F.desc("own"))
    found = dealt.mapInArrow(_near_of_blocks, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("of")).select("word", "n_near", (-F.col("of.less")).alias("best_n"), "of.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, root): each step doubles how far a word has followed; counts double along a chain, so steps are few."""
    forms = staged(forms, "forms")
    while True:
        ahead = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(forms.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(forms)
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        forms = after.select("word", "root")
        forms.staged_path = after.staged_path


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Words of docs(doc_id, text) with their forms: (word, form, root, n, n_near, form_n).

    Null and empty texts hold no word; rows without doc_id count with an empty id,
    repeated rows each count; very long words are words (their blocks hold fewer).
    Other columns of docs are not read.  No text, no word: an empty table.
    """
    words = staged(vocabulary(docs), "words")
    near = words.join(near_words(words, block), "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    table_ = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    release(words)
    roots = _roots(table_.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return table_.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: One bit of crc32's table of 256 values.
_STEP = "list_transform({x}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)"


def _steps() -> str:
    x = "range(0, 256)"
    for _ in range(8):
        x = _STEP.format(x=x)
    return x


_BYTES = "flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))"

ORACLE_OP13 = f"""
WITH RECURSIVE steps AS MATERIALIZED (SELECT {_steps()} AS t),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents)
  WHERE length(r) >= {LEAST_LENGTH} GROUP BY ALL
),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format(x="coalesce(doc_id::VARCHAR, '') || ':' || run")}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM runs, steps
),
words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % {SLIP} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
),
cuts AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM pairs GROUP BY word
),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= {RATIO} * w.n THEN b.best_n END AS form_n,
    CASE WHEN b.best_n >= {RATIO} * w.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = w.word AND p.other_n = b.best_n) END AS form
  FROM words w LEFT JOIN best b ON w.word = b.word
),
walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON walk.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM walk JOIN formed e ON walk.root = e.word AND e.form IS NULL JOIN formed f ON f.word = walk.word
"""

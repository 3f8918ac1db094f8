"""Token counts that follow edits (operator 2).

A document is cut where a byte-level BPE surely begins a new pre-token, so that
its chunks are encoded independently.  Runs of chunks are the leaves of a segment
tree, of which every node holds the bytes and tokens below it.  Trees are kept in
a table, a row for each document: its text, and the bytes and tokens of its
chunks, from which the sums are added up without any encoding.  A later batch of
edits is joined to that table: an edit finds its leaves by descent along the byte
sums; only the chunks that it touches and one chunk of context on each side are
cut and encoded anew, the sums on the paths to the root are updated, and the rows
of the trees are written again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table, utf8
from .token_store import _EDGE, _NO_EDGE, TOKENIZER, BpeEncoder, bpe_encoder

#: Chunks in a leaf when a tree is built, and those from which a leaf that grew is dealt out anew.
LEAF, FULL = 16, 512
EDITS = "array<struct<at:bigint,removed:bigint,inserted:string>>"
#: A kept tree: ``chunk_bytes`` and ``chunk_tokens`` are little-endian 32-bit integers, one for each chunk of the text.
TREES = "doc_id long, text string, chunk_bytes binary, chunk_tokens binary, n_tokens long"


def _cut(text: bytes) -> list[bytes]:
    """A text's chunks: all but the first begin with their space."""
    first, *more = _EDGE.split(text) if _NO_EDGE.search(text) else text.split(b" ")
    return [first, *(b" " + c for c in more)] if text else []


class TokenTree:
    """A segment tree over runs of chunks; ``encoded`` counts the bytes that edits had encoded.

    ``long`` and ``count`` are the bytes and ids of the chunks of ``text``.  A leaf is
    cut into its chunks only when an edit comes near it.
    """

    def __init__(self, text: bytes, long: np.ndarray, count: np.ndarray, encoder: BpeEncoder, leaf: int = LEAF):
        self.encoder, self.encoded, self.leaf = encoder, 0, leaf
        self._deal(text, long, count)

    @classmethod
    def of(cls, text: bytes, encoder: BpeEncoder, leaf: int = LEAF) -> TokenTree:
        return cls(text, *encoder.sizes([text])[0], encoder, leaf)

    def _deal(self, text: bytes, long: np.ndarray, count: np.ndarray) -> None:
        self.base, self.long, self.count = text, long, count
        self.offset = np.append(0, np.cumsum(long, dtype=np.int64))
        starts = np.arange(0, len(long), self.leaf)
        self.n = max(1, len(starts))
        self.width = 1 << (self.n - 1).bit_length()
        self.loaded: dict[int, tuple[list[bytes], list[int]]] = {}
        self.bytes, self.tokens = (np.zeros(2 * self.width, dtype=np.int64) for _ in range(2))
        for sums, own in ((self.bytes, long), (self.tokens, count)):
            if len(starts):
                sums[self.width : self.width + self.n] = np.add.reduceat(own, starts)
            w = self.width
            while w > 1:
                sums[w // 2 : w] = sums[w : 2 * w : 2] + sums[w + 1 : 2 * w : 2]
                w //= 2

    def _leaf(self, i: int) -> tuple[list[bytes], list[int]]:
        """(chunks, counts) of a leaf."""
        if i not in self.loaded:
            at = self.offset[i * self.leaf : (i + 1) * self.leaf + 1].tolist()
            self.loaded[i] = [self.base[x:y] for x, y in zip(at, at[1:])], self.count[i * self.leaf : (i + 1) * self.leaf].tolist()
        return self.loaded[i]

    def _sum(self, i: int) -> None:
        self.bytes[i] = self.bytes[2 * i] + self.bytes[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.bytes[1])

    def rows(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(text, bytes, counts) of the chunks as they stand: what was not touched is copied in runs."""
        text, long, count, done = [], [], [], 0
        for i in sorted(self.loaded):
            a, b = done * self.leaf, i * self.leaf
            text += [self.base[self.offset[a] : self.offset[min(b, len(self.long))]], *self.loaded[i][0]]
            long += [self.long[a:b], [len(c) for c in self.loaded[i][0]]]
            count += [self.count[a:b], self.loaded[i][1]]
            done = i + 1
        a = min(done * self.leaf, len(self.long))
        text.append(self.base[self.offset[a] :])
        join = lambda own, rest: np.concatenate([np.asarray(x, dtype=np.int64) for x in (*own, rest[a:])])
        return b"".join(text), join(long, self.long), join(count, self.count)

    def text(self) -> bytes:
        return self.rows()[0]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, chunk, place in it) that hold byte ``at``; the end of the text is in the last chunk."""
        node, at = 1, min(at, max(self.length - 1, 0))
        while node < self.width:
            node *= 2
            if at >= self.bytes[node]:
                at -= int(self.bytes[node])
                node += 1
        leaf = min(node - self.width, self.n - 1)
        chunks = self._leaf(leaf)[0]
        for k, c in enumerate(chunks):
            if at < len(c):
                return leaf, k, at
            at -= len(c)
        return leaf, len(chunks), 0

    def _beside(self, leaf: int, chunk: int, by: int) -> tuple[int, int]:
        """The place of the chunk before or behind another; the same at an end of the text."""
        k, i = chunk + by, leaf
        while not 0 <= k < len(self._leaf(i)[0]):
            i += by
            if not 0 <= i < self.n:
                return leaf, chunk
            k = len(self._leaf(i)[0]) - 1 if by < 0 else 0
        return i, k

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replaces ``removed`` bytes from byte ``at`` on; both are moved back to the start of a character."""
        at = max(0, min(at, self.length))
        at, end = self._snapped(at), self._snapped(min(at + max(removed, 0), self.length))
        end = max(at, end)
        if not self.length:
            self._replace(0, 0, 0, 0, inserted)
            return
        a_leaf, a, a_at = self._find(at)
        if at == self.length:
            a_at = len(self._leaf(a_leaf)[0][a])
        b_leaf, b, b_at = self._find(max(end - 1, at))
        b_end = 0 if end == at else b_at + 1
        if end == at:
            b_leaf, b, b_end = a_leaf, a, a_at
        head, tail = self._leaf(a_leaf)[0][a][:a_at], self._leaf(b_leaf)[0][b][b_end:]
        # One chunk of context on each side: the edit may take away or complete their edges.
        p_leaf, p = self._beside(a_leaf, a, -1)
        n_leaf, n = self._beside(b_leaf, b, 1)
        before = self._leaf(p_leaf)[0][p] if (p_leaf, p) != (a_leaf, a) else b""
        behind = self._leaf(n_leaf)[0][n] if (n_leaf, n) != (b_leaf, b) else b""
        self._replace(p_leaf, p, n_leaf, n + 1, before + head + inserted + tail + behind)

    def _snapped(self, at: int) -> int:
        while 0 < at < self.length:
            leaf, k, i = self._find(at)
            if self._leaf(leaf)[0][k][i] & 0xC0 != 0x80:
                return at
            at -= 1
        return at

    def _replace(self, leaf: int, chunk: int, last: int, end: int, text: bytes) -> None:
        """Puts the chunks of ``text`` in place of those from (leaf, chunk) to (last, end)."""
        # The region's first chunk keeps its own space, which is an edge already.
        lead = text[:1] == b" " and (leaf, chunk) != (0, 0)
        new = [b" " + c if lead and not i else c for i, c in enumerate(_cut(text[1:] if lead else text))] or ([text] if text else [])
        counts = self.encoder.counts(new)
        self.encoded += len(text)
        rest = [own[end:] for own in self._leaf(last)]
        for i in range(leaf, last + 1):
            keep = chunk if i == leaf else 0
            self.loaded[i] = tuple(own[:keep] for own in self._leaf(i))
        for own, fresh in zip(self.loaded[leaf], (new, counts), strict=True):
            own += fresh
        for own, behind in zip(self.loaded[last], rest, strict=True):
            own += behind
        nodes = set()
        for i in range(leaf, last + 1):
            self.bytes[self.width + i], self.tokens[self.width + i] = sum(map(len, self.loaded[i][0])), sum(self.loaded[i][1])
            nodes.add((self.width + i) // 2)
        while nodes and max(nodes) > 0:
            for i in nodes:
                self._sum(i)
            nodes = {i // 2 for i in nodes if i > 1}
        if max(len(self.loaded[i][0]) for i in (leaf, last)) > FULL:
            self._deal(*self.rows())


def build_trees(docs: DataFrame, tokenizer_file: str, plain_specials: bool = False) -> DataFrame:
    """The trees (TREES) of docs(doc_id, text), a row for each, to be written as a table; a null text counts as empty.

    Edits that come along in a column ``edits`` stay beside their trees.
    """
    schema, more = (f"{TREES}, edits {EDITS}", ["edits"]) if "edits" in docs.columns else (TREES, [])

    def run(batches):
        encoder = bpe_encoder(tokenizer_file, plain_specials)
        for batch in batches:
            out = [[], [], []]
            for texts in slices(utf8(batch.column("text")), 1 << 22):
                for t, (long, count) in zip(texts, encoder.sizes(texts), strict=True):
                    for column, x in zip(out, (long.astype("<u4").tobytes(), count.astype("<u4").tobytes(), encoder.total(t, int(count.sum()))), strict=True):
                        column.append(x)
            text = batch.column("text").fill_null("")
            sums = [pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.binary(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, *sums, *(batch.column(c) for c in more)], [*(c.split()[0] for c in TREES.split(", ")), *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast(EDITS).alias(c) for c in more))
    return rows.mapInArrow(run, schema)


EDITED = f"{TREES}, n_tokens_before long, n_bytes long, n_bytes_encoded long, sha256 string"


def apply_edits(trees: DataFrame, tokenizer_file: str, plain_specials: bool = False) -> DataFrame:
    """Trees (TREES with a column ``edits``) after their edits: EDITED, whose first columns are the trees to be kept.

    ``edits``: (at, removed, inserted) in bytes of the text as the edits before it
    left it; places beyond the text mean its end, null numbers 0 and null texts
    nothing, null edits none.  Only edited regions are encoded; a text that holds an
    added token is counted whole, as that may join chunks.  Repeated rows are edited
    one by one.
    """

    def run(batches):
        encoder = bpe_encoder(tokenizer_file, plain_specials)
        names = [c.split()[0] for c in EDITED.split(", ")]
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out = [[] for _ in kinds]
            columns = (batch.column(c).to_pylist() for c in ("chunk_bytes", "chunk_tokens", "n_tokens", "edits"))
            for text, long, count, before, edits in zip(utf8(batch.column("text")), *columns, strict=True):
                tree = TokenTree(text, np.frombuffer(long, "<u4").astype(np.int64), np.frombuffer(count, "<u4").astype(np.int64), encoder)
                for e in edits or ():
                    if e:
                        tree.edit(e["at"] or 0, e["removed"] or 0, (e["inserted"] or "").encode())
                edited, long_, count_ = tree.rows()
                for column, x in zip(out, (edited.decode(), long_.astype("<u4").tobytes(), count_.astype("<u4").tobytes(), encoder.total(edited, tree.total), before, tree.length, tree.encoded, hashlib.sha256(edited).hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    return trees.mapInArrow(run, EDITED)


def count_edits(docs: DataFrame, tokenizer_file: str, plain_specials: bool = False) -> DataFrame:
    """Token counts of docs(doc_id, text, edits) before and after their edits, by trees that are kept as a table in between.

    Columns: doc_id, n_tokens, n_tokens_edited, n_bytes_edited, n_bytes_encoded (by
    the edits) and edited_sha256.  Null texts count as empty; repeated rows are
    counted one by one.
    """
    trees = staged(build_trees(docs.select("doc_id", "text", "edits"), tokenizer_file, plain_specials), "trees")
    after = apply_edits(trees, tokenizer_file, plain_specials)
    names = {"n_tokens_before": "n_tokens", "n_tokens": "n_tokens_edited", "n_bytes": "n_bytes_edited", "n_bytes_encoded": "n_bytes_encoded", "sha256": "edited_sha256"}
    return after.select("doc_id", *(F.col(c).alias(name) for c, name in names.items()))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs, or kept trees, with the rows of edits(doc_id, seq, at, removed, inserted) of each document, in order of seq.

    Every row of a repeated doc_id gets all of its edits.
    """
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("e"))
    own = own.select("doc_id", F.transform("e", lambda x: F.struct(x["at"], x["removed"], x["inserted"])).cast(EDITS).alias("edits"))
    return docs.drop("edits").join(own, "doc_id", "left")


def revision_edits(text: Column, doc_id: Column, n: int = 3) -> Column:
    """``n`` edits of a text that depend on it and its doc_id alone: each moves up to 40 bytes' worth of it elsewhere."""

    def one(k: int) -> Column:
        spread = lambda salt, size: F.pmod(F.xxhash64(doc_id, F.lit(k), F.lit(salt)), F.greatest(size, F.lit(1)))
        size = F.octet_length(text).cast("bigint")
        start = spread(3, F.char_length(text).cast("bigint")).cast("int") + 1
        return F.struct(spread(1, size).alias("at"), spread(2, F.lit(40).cast("bigint")).alias("removed"), F.substring(text, start, spread(4, F.lit(24).cast("bigint")).cast("int")).alias("inserted"))

    return F.array(*(one(k) for k in range(n))).cast(EDITS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return count_edits(docs.withColumn("edits", revision_edits(F.col("text"), F.col("doc_id"))), public_tokenizers.path(TOKENIZER))

"""Token ids in files of wavelet matrices (operator 5).

A shard holds the token ids of consecutive documents as one wavelet matrix: a
bit-plane for each bit of an id, from the highest; after each plane the ids are
stably divided by that bit.  Beside each plane stands a directory of ones, a
32-bit count before every 512 bits.  Rank (a count and at most 64 bytes) leads from
a position to the next plane, select back up, both on the packed bits, so single
tokens are read, counted and found without unpacking the ids.

File format: Parquet, zstd, one row a shard, written by Spark in one job:
``part, shard, n_tokens, doc_ids, lengths, zeros, planes, ranks`` (``planes``:
packed bits, highest bit first; ``zeros``: the zero bits of each plane; ``ranks``:
its counts, little-endian).  A part is a range of doc_ids and one file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KnownTable, default_partitions, map_batches, shared_dir, slices, table, text_bytes, utf8

TOKENIZER = "byte_bpe_50k.json"
#: Token ids in a shard, at which it is closed after the document at hand.
SHARD_TOKENS = 1 << 21
#: Bytes of text in a part (a task and a file), about.
PART_BYTES = 64 << 20
#: Bytes of text whose chunks are told apart at once.
SLICE_BYTES = 16 << 20
#: Bits between two counts of a plane's directory.
RANK_BITS = 512
#: Chunks of each of the two generations of a worker's table.
TABLE_SIZE = 400_000
#: Separates documents.
END_ID = 0

SHARDS = "part int, shard int, n_tokens long, doc_ids array<bigint>, lengths array<int>, zeros array<int>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of ids below 2 ** levels."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        at, zeros, planes, ranks = ids, [], [], []
        for level in range(levels - 1, -1, -1):
            one = (at & at.dtype.type(1 << level)) != 0
            packed = np.packbits(one)
            planes.append(packed.tobytes())
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), RANK_BITS // 8), dtype=np.int64) if len(packed) else np.empty(0, np.int64)
            ranks.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
            low = at[~one]
            zeros.append(len(low))
            at = np.concatenate([low, at[one]])
        return cls(len(ids), zeros, planes, ranks)

    @cached_property
    def directory(self) -> list[np.ndarray]:
        return [np.frombuffer(r, "<u4") for r in self.ranks]

    def ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane: its block's count, and the bits of the block before i."""
        block, inside = divmod(i, RANK_BITS)
        if not inside:
            return int(self.directory[level][block]) if i < self.n else self.n - self.zeros[level]
        start = block * RANK_BITS // 8
        held = self.planes[level][start : start + (inside + 7) // 8]
        return int(self.directory[level][block]) + (int.from_bytes(held) >> (-inside % 8)).bit_count()

    def find(self, level: int, k: int, one: bool) -> int:
        """Position of the one, or zero, number k (from 0) of a plane: a binary search of its directory, then one block."""
        counts = self.directory[level]
        before = (lambda b: int(counts[b])) if one else (lambda b: b * RANK_BITS - int(counts[b]))
        block = bisect_right(range(len(counts)), k, key=before) - 1
        start = block * RANK_BITS // 8
        bits = np.unpackbits(np.frombuffer(self.planes[level][start : start + RANK_BITS // 8], np.uint8))
        return block * RANK_BITS + int(np.flatnonzero(bits == one)[k - before(block)])

    def access(self, i: int) -> int:
        """The id at position i."""
        token = 0
        for level, zero in enumerate(self.zeros):
            one = self.planes[level][i >> 3] >> (7 - (i & 7)) & 1
            ones = self.ones(level, i)
            token = token << 1 | one
            i = zero + ones if one else i - ones
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level, zero in enumerate(self.zeros):
            a, b = self.ones(level, lo), self.ones(level, hi)
            lo, hi = (zero + a, zero + b) if token >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs in positions lo to hi."""
        if token < 0 or token >> len(self.zeros):
            return 0
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the occurrence number k (from 0) of an id; -1 if there are fewer."""
        if k < 0 or token < 0 or token >> len(self.zeros):
            return -1
        lo, hi = self._range(token, 0, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            zero = self.zeros[level]
            i = self.find(level, i - zero, True) if i >= zero else self.find(level, i, False)
        return i

    def ids(self) -> np.ndarray:
        """All ids: the same steps for every position at once, plane by plane from the lowest up."""
        at = np.zeros(self.n, dtype=np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n).view(bool)
            up = np.empty_like(at)
            up[~one] = at[: self.zeros[level]]
            up[one] = at[self.zeros[level] :] | at.dtype.type(1 << (len(self.zeros) - 1 - level))
            at = up
        return at


#: A space before a character that is surely not white space: here a byte-level BPE always begins a new pre-token, as
#: a run of white space gives its last space to the word behind it.  The lead bytes left out start some white space.
_EDGE = re.compile(rb" (?=[!-~\xc3-\xe0\xe4-\xf4])")
#: Pieces that are encoded as one text.
JOINED = 2000
#: Marks the chunk that begins a text.
_FIRST = b"\xff"
_NO_EDGE = re.compile(rb" (?![!-~\xc3-\xe0\xe4-\xf4])")
#: For each byte whether it begins a chunk behind such a space, or marks a text's beginning.
_BEGINS = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xE0 or 0xE4 <= b <= 0xF4 or b == 0xFF for b in range(256)])
#: A chunk of words, ASCII digits, signs other than apostrophes, and single line breaks before any of these: its pre-tokens
#: can be told without tables of Unicode (the two bytes of Latin-1 letters are letters in all of them).
_PLAIN = r"^\xff?(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])(?:\n?(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))*$"
#: Its pre-tokens; the first of a chunk begins with the chunk's space, or its mark.
_PIECE = re.compile(rb"[ \xff]?(?:[A-Za-z]++|\xc3[\x80-\xbf])++|[ \xff]?[!-&(-/:-@\[-`{-~]++|[ \xff]?[0-9]++|\n")
#: Printable characters that byte-level vocabularies write for bytes: those that print stand for themselves.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_WRITTEN = {b: chr(b) for b in _PRINTS} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}
_BREAK = _WRITTEN[10]


def _leads(values: pa.Array) -> np.ndarray:
    """First bytes of the values of a whole binary array; 0 for empty ones."""
    data, offsets = np.frombuffer(values.buffers()[2], np.uint8), np.frombuffer(values.buffers()[1], "<i4")[: len(values) + 1]
    return np.where(np.diff(offsets) == 0, 0, data[np.minimum(offsets[:-1], max(len(data) - 1, 0))]) if len(data) else np.zeros(len(values), np.uint8)


def _gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the runs named by codes, one behind the other; length of each); a run is values[start : start + size]."""
    n = size[codes]
    ends = np.cumsum(n, dtype=np.int32)
    return values[np.repeat(start[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)], n


class BpeEncoder:
    """Encodes with the tokenizers library; chunks and pre-tokens that are known come from bounded tables.

    ``plain_specials``: strings of special tokens inside a text are ordinary text.
    By default, as in the library, texts are cut at added tokens.
    """

    def __init__(self, tokenizer_file: str, plain_specials: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = plain_specials
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items() if t.content}
        # A string that is found in normalised text, takes white space along or holds some cannot be told from the bytes of a chunk.
        plain = all(not (t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content)) for t in added.values())
        self.whole = not plain_specials and bool(added) and (self.tokenizer.normalizer is not None or not plain)
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added and not plain_specials else None
        self.levels = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2") if self.levels <= 16 else np.dtype("<u4")
        self.table = KnownTable(self._whole_chunks, TABLE_SIZE)
        self.pieces = KnownTable(self._new_pieces, TABLE_SIZE)
        parts = json.loads(self.tokenizer.to_str())
        level = parts["pre_tokenizer"] or {}
        self.line = self.tokenizer.token_to_id(_BREAK)
        self.fast = None
        if parts["normalizer"] is None and level.get("type") == "ByteLevel" and not level["add_prefix_space"] and level.get("use_regex", True) and self.line is not None:
            # The same model behind a division at line breaks alone: what it is given is cut and written in its characters already.
            self.fast = Tokenizer.from_file(tokenizer_file)
            self.fast.encode_special_tokens = True
            self.fast.pre_tokenizer = pre_tokenizers.Split(_BREAK, "isolated")

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, many to a text; a line break, which is an id of its own, ends each."""
        out, size = [], self.kind.itemsize
        for i in range(0, len(pieces), JOINED):
            own = pieces[i : i + JOINED]
            text = (b"\n".join(own) + b"\n").replace(_FIRST, b"").decode("latin-1").translate(_WRITTEN)
            ids = np.array(self.fast.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
            packed, at = ids.tobytes(), 0
            ends = (np.flatnonzero(ids == self.line) * size).tolist()
            if len(ends) != len(own):
                raise ValueError("a line break is no id of its own in this vocabulary")
            for end in ends:
                out.append(packed[at:end])
                at = end + size
        return out

    def _whole_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of chunks, each a text of its own; one that begins a text is marked, others lost their space."""
        return self._one_by_one([c[1:].decode() if c[:1] == _FIRST else " " + c.decode() for c in chunks])

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of distinct chunks: where in the ids each begins, and how many it has."""
        plain = pc.match_substring_regex(chunks, _PLAIN) if self.fast is not None else pa.array(np.zeros(len(chunks), dtype=bool))
        mask = plain.to_numpy(zero_copy_only=False)
        size = np.zeros(len(chunks), dtype=np.int32)
        own = chunks.filter(plain)
        ids = np.empty(0, dtype=self.kind)
        if len(own):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.scalar(b" ", pa.binary()))[0].as_py()
            coded = pa.array(_PIECE.findall(b" " + text), pa.binary()).dictionary_encode()
            codes, lead = coded.indices.to_numpy(), _leads(coded.dictionary)
            packs = [np.array([self.line], dtype=self.kind).tobytes()] * len(lead)
            words = np.flatnonzero(lead != 10)  # all but the line break
            for i, pack in zip(words.tolist(), self.pieces.values(coded.dictionary.take(pa.array(words)).to_pylist()), strict=True):
                packs[i] = pack
            begins = ((lead == 0x20) | (lead == 0xFF))[codes]
            ids, n = _gathered(*self._packed(packs), codes)
            size[mask] = np.add.reduceat(n, np.flatnonzero(begins))
        if not mask.all():
            more, _, size[~mask] = self._packed(self.table.values(chunks.filter(pc.invert(plain)).to_pylist()))
            ids = np.concatenate([ids, more])
        start = np.empty(len(chunks), dtype=np.int32)
        order = np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])
        start[order] = np.cumsum(size[order]) - size[order]
        return ids, start, size

    def _packed(self, packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of packed ids."""
        size = np.fromiter(map(len, packs), dtype=np.int32, count=len(packs)) // np.int32(self.kind.itemsize)
        return np.frombuffer(b"".join(packs), dtype=self.kind), np.cumsum(size, dtype=np.int32) - size, size

    def _chunks(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[int]]:
        """(distinct chunks, number of each chunk of the texts among them, first chunk of each text, texts to cut by _EDGE).

        All texts are cut at spaces at once.  A space that is no edge leaves a chunk
        that is empty or begins with a byte out of _BEGINS.
        """
        flat = pc.split_pattern(pa.array([b" ".join([_FIRST + t for t in texts])], pa.binary()), " ").values
        coded = flat.dictionary_encode()
        codes, chunks = coded.indices.to_numpy(), coded.dictionary
        loose = ~_BEGINS[_leads(chunks)]
        doc = np.cumsum([0, *(t.count(b" ") + 1 for t in texts)])
        held = np.unique(np.searchsorted(doc, np.flatnonzero(loose[codes]), side="right") - 1).tolist() if loose.any() else []
        return chunks, codes, doc, held

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, packed as little-endian integers of ``kind``."""
        if self.whole:
            return self._one_by_one([t.decode() for t in texts])
        if self.specials is not None and any(self.specials.search(t) for t in texts):
            cut = [self.specials.split(t) for t in texts]
            parts = iter(self._by_chunks([p for own in cut for p in own[::2]]))
            ids = {t: np.array([i], dtype=self.kind).tobytes() for t, i in self.added.items()}
            return [b"".join([ids[p] if k % 2 else next(parts) for k, p in enumerate(own)]) for own in cut]
        return self._by_chunks(texts)

    def _by_chunks(self, texts: list[bytes]) -> list[bytes]:
        """Each distinct chunk is looked up once; ids are gathered by its number."""
        if not texts:
            return []
        chunks, codes, doc, held = self._chunks(texts)
        ids, n = _gathered(*self._distinct(chunks), codes)
        at = np.append(0, np.cumsum(n, dtype=np.int64))[doc]
        out = [ids[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in held:
            first, *more = _EDGE.split(texts[i])
            out[i] = b"".join(self.table.all_values([_FIRST + first, *more]))
        return out

    def sizes(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the bytes of its chunks, all but the first with their space, and their numbers of ids."""
        if not texts:
            return []
        chunks, codes, doc, held = self._chunks(texts)
        size = self._distinct(chunks)[2]
        long = np.diff(np.frombuffer(chunks.buffers()[1], "<i4")[: len(chunks) + 1]) + 1
        out = []
        for i, j in zip(doc[:-1].tolist(), doc[1:].tolist(), strict=True):
            own = long[codes[i:j]]
            own[0] -= 2  # its mark, and no space
            out.append((own, size[codes[i:j]]))
        for i in held:
            own = _EDGE.split(texts[i])
            cut = [len(c) + 1 for c in own]
            cut[0] -= 1
            packs = self.table.all_values([_FIRST + own[0], *own[1:]])
            out[i] = np.array(cut), np.array([len(p) for p in packs]) // self.kind.itemsize
        return out

    def total(self, text: bytes, by_chunks: int) -> int:
        """Number of ids of a text whose chunks, each on its own, have ``by_chunks``: more or less if an added token cuts it."""
        if self.whole or self.specials is not None and self.specials.search(text):
            return len(self.encode([text])[0]) // self.kind.itemsize
        return by_chunks

    def counts(self, chunks: list[bytes]) -> list[int]:
        """Numbers of ids of chunks, each encoded on its own."""
        keys = [c[1:] if c[:1] == b" " else _FIRST + c for c in chunks]
        size = self.kind.itemsize
        return [len(x) // size for x in self.table.all_values(keys)]


_ENCODERS: dict[tuple[str, bool], BpeEncoder] = {}


def bpe_encoder(tokenizer_file: str, plain_specials: bool = False) -> BpeEncoder:
    """The worker's encoder for a tokenizer, with what it has encoded so far."""
    key = tokenizer_file, plain_specials
    if key not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        _ENCODERS[key] = BpeEncoder(*key)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, partitions: int | None = None, shard_tokens: int = SHARD_TOKENS, plain_specials: bool = False) -> None:
    """Writes the token ids of docs(doc_id, text) to wavelet files in ascending doc_id order.

    A null text counts as empty and still gets its end id.  Rows with one doc_id
    are all written, ordered by text; rows without doc_id come first.  A document
    is never cut, so a shard may exceed ``shard_tokens`` by one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or max(default_partitions(docs.sparkSession), -(-text_bytes(rows) // PART_BYTES))

    def run(batches):
        encoder = bpe_encoder(tokenizer_file, plain_specials)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids, lengths, packs, held = [], [], [], 0
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()))

        def close():
            ids = np.frombuffer(b"".join(packs), dtype=encoder.kind)
            m = WaveletMatrix.build(ids, encoder.levels)
            values = (part, shard, len(ids), doc_ids, lengths, m.zeros, m.planes, m.ranks)
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            packed_texts = (p + end for texts in slices(utf8(batch.column("text")), SLICE_BYTES) for p in encoder.encode(texts))
            for doc, packed in zip(batch.column("doc_id").to_pylist(), packed_texts, strict=True):
                doc_ids.append(doc)
                lengths.append(len(packed) // encoder.kind.itemsize)
                packs.append(packed)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield close()
                    shard, doc_ids, lengths, packs, held = shard + 1, [], [], [], 0
        if doc_ids:
            yield close()

    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(path)


def _shards(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path).select("part", "shard", "n_tokens", *columns)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])


def _before(sizes: DataFrame, size: str, name: str) -> DataFrame:
    """sizes(part, shard, ...) with the sum of ``size`` over the shards before each, as two levels of running sums.

    Only the sums of parts, one row a part of PART_BYTES, meet in one task.
    """
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum(size).alias("_n")).select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return sizes.withColumn("_own", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(parts, "part").withColumn(name, F.col("_own") + F.col("_base")).drop("_own", "_base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32 (of its ids as little-endian 32-bit integers)."""

    def make():
        def each(batch):
            out = [[], [], [], [], [], []]
            for r in batch.to_pylist():
                ids = _matrix(r).ids().astype("<u4")
                at = 0
                for doc, n in zip(r["doc_ids"], r["lengths"], strict=True):
                    for column, v in zip(out, (r["part"], r["shard"], doc, at, n, zlib.crc32(ids[at : at + n].tobytes())), strict=True):
                        column.append(v)
                    at += n
            return out

        return each

    # A row is a shard of some MB, and Spark bounds a batch by bytes.
    shards = _shards(spark, path, "doc_ids", "lengths", "zeros", "planes", "ranks")
    docs = map_batches(shards, make, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    bases = _before(_shards(spark, path), "n_tokens", "base").select("part", "shard", "base")
    return docs.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _asked(shards: DataFrame, answer, schema: str) -> DataFrame:
    """Rows that ``answer`` gives for each shard's row; a shard may give none."""

    def make():
        def each(batch):
            rows = [x for r in batch.to_pylist() for x in answer(r)]
            return list(map(list, zip(*rows, strict=True))) if rows else None

        return each

    return map_batches(shards, make, schema)


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Per shard that holds a token: part, shard, occurrences, and ``before``, those in the shards before it; by rank alone."""
    counts = _asked(_shards(spark, path, "zeros", "planes", "ranks"), lambda r: [(r["part"], r["shard"], n)] if (n := _matrix(r).count(token)) else [], "part int, shard int, occurrences long")
    return _before(counts, "occurrences", "before")


def locate(spark: SparkSession, path: str, token: int, k: int) -> DataFrame:
    """(doc_id, position): where the token's occurrence number k (from 0) of all files stands; no row if there are fewer.

    Ranks find the shard, a select in its planes the place.
    """
    own = occurrences(spark, path, token).filter((F.lit(k) >= F.col("before")) & (F.lit(k) < F.col("before") + F.col("occurrences")))
    held = _shards(spark, path, "doc_ids", "lengths", "zeros", "planes", "ranks").join(own.select("part", "shard", (F.lit(k) - F.col("before")).alias("k")), ["part", "shard"])
    places = _asked(held, lambda r: [(r["part"], r["shard"], at := _matrix(r).select(token, r["k"]), r["doc_ids"][int(np.searchsorted(np.cumsum(r["lengths"]), at, side="right"))])], "part int, shard int, at long, doc_id long")
    bases = _before(_shards(spark, path), "n_tokens", "base")
    return places.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("position"))


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, token) of a bounded list of positions, each read by ranks in its shard; none beyond the files' end."""
    asked = spark.createDataFrame([(int(p),) for p in positions], "position long")
    bases = _before(_shards(spark, path), "n_tokens", "base")
    own = bases.join(F.broadcast(asked), (F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("n_tokens")))
    own = own.groupBy("part", "shard").agg(F.collect_list("position").alias("asked"), F.first("base").alias("base"))
    held = _shards(spark, path, "zeros", "planes", "ranks").join(own, ["part", "shard"])
    return _asked(held, lambda r: [(p, _matrix(r).access(p - r["base"])) for p in r["asked"]], "position long, token long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}-tokens"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_documents(spark, path)

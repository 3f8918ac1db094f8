"""SentencePiece encoding and decoding by a table of distinct chunks (operator 7).

Where no piece of the model holds a white-space marker after another character,
no merge can cross the start of a marked word.  A text then falls into chunks
(a run of markers and the word behind it) that are segmented on their own: each
task keeps a table of distinct chunks, segments a chunk once, and joins ids back
by position.  Nothing is shuffled, the table is bounded and goes with its task.
"""

from __future__ import annotations

import copy
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import KnownTable, map_batches, slices, table, tidy, utf8

MODEL = "piece_bpe_32k.model"
#: Chunks of each of the two generations of a task's table.
TABLE_SIZE = 300_000
_MARK = "▁".encode()
_CHUNK = re.compile(rb" +[^ ]*")


class ChunkCodec:
    """Encodes and decodes by distinct chunks.

    Raises ValueError for a model whose pieces may cross a marker, or whose
    normaliser changes more than spaces: there chunks are not independent.
    """

    def __init__(self, model_file: str, table_size: int = TABLE_SIZE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = pb.ModelProto.FromString(self.processor.serialized_model_proto())
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or not spec.normalizer_spec.add_dummy_prefix:
            raise ValueError("the model's normaliser is not a plain marker prefix")
        if any(re.search("[^▁]▁", p.piece) or p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces):
            raise ValueError("pieces of the model cross white-space markers")
        self.marker = self.processor.piece_to_id("▁")
        self.table = KnownTable(self._segment, table_size)

    def emptied(self) -> ChunkCodec:
        """This codec with a table of its own."""
        own = copy.copy(self)
        own.table = KnownTable(own._segment, self.table.limit)
        return own

    def _segment(self, chunks: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Number of ids, ids in decimal, and decoded bytes of chunks, each of which begins with its first marker."""
        if not chunks:
            return []
        # The library puts a marker before a text and takes one off what it decodes; a marker alone has no text.
        ids = [i or [self.marker] for i in self.processor.encode([c[1:].decode() for c in chunks], num_threads=1)]
        back = [b" " + t.encode() for t in self.processor.decode(ids, num_threads=1)]
        return [(len(i), ",".join(map(str, i)).encode(), c if c == t else t) for c, i, t in zip(chunks, ids, back, strict=True)]

    def chunks(self, text: bytes) -> list[bytes]:
        """A text's chunks; joined they are the marked text."""
        if not text:
            return []
        marked = b" " + (text.replace(_MARK, b" ") if _MARK in text else text)
        if b"  " not in marked and not marked.endswith(b" "):
            return [b" " + w for w in marked.split(b" ")[1:]]
        return _CHUNK.findall(marked)

    def parts(self, texts: list[bytes]) -> list[list[tuple[int, bytes, bytes]]]:
        """What the table holds of each chunk of each text; distinct chunks are segmented once."""
        chunks = [self.chunks(t) for t in texts]
        held = self.table.holding(set().union(*chunks))
        return [[held[c] for c in own] for own in chunks]

    def round_trips(self, texts: list[bytes]) -> list[tuple[list[int], bytes]]:
        """Ids of each text and the bytes they decode to."""
        return [([int(i) for p in own for i in p[1].split(b",")], b"".join([p[2] for p in own])[1:]) for own in self.parts(texts)]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


_CODECS: dict[str, ChunkCodec] = {}


def codec(model_file: str) -> ChunkCodec:
    """A codec with an empty table; the model, which does not grow, is read once a worker."""
    if model_file not in _CODECS:
        _CODECS[model_file] = ChunkCodec(model_file)
    return _CODECS[model_file].emptied()


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with an array of token ids (int) in column ``ids``.

    Null and empty texts get an empty array.  Repeated rows stay repeated.  A
    column that already has the name ``ids`` is replaced.
    """
    kept = [c for c in docs.columns if c != ids]
    spark_schema = docs.select(kept).schema.add(ids, ArrayType(IntegerType()))

    def run(batches):
        import pyarrow as pa

        own = codec(model_file)
        for batch in batches:
            out = [ids for texts in slices(utf8(batch.column(text))) for ids, _ in own.round_trips(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.list_(pa.int32()))], [*kept, ids])

    return docs.mapInArrow(tidy(run), spark_schema)


def decode(tokens: DataFrame, model_file: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """tokens with the decoded text of column ``ids``; null ids give an empty text."""
    kept = [c for c in tokens.columns if c != text]
    spark_schema = tokens.select(kept).schema.add(text, "string")

    def run(batches):
        import pyarrow as pa

        own = codec(model_file)
        for batch in batches:
            out = [own.decode(x) if x else "" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], [*kept, text])

    return tokens.mapInArrow(tidy(run), spark_schema)


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its round trip.

    A null text counts as empty: no ids, and the digests of empty strings.
    """

    def make():
        own = codec(model_file)

        def each(batch):
            counts, ids_hex, text_hex = [], [], []
            for texts in slices(utf8(batch.column("text"))):
                for parts in own.parts(texts):
                    counts.append(sum([p[0] for p in parts]))
                    ids_hex.append(hashlib.sha256(b",".join([p[1] for p in parts])).hexdigest())
                    text_hex.append(hashlib.sha256(b"".join([p[2] for p in parts])[1:]).hexdigest())
            return [batch.column("doc_id"), counts, ids_hex, text_hex]

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))

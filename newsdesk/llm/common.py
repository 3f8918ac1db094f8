"""Shared helpers of the training-text operators.

Conventions that hold for every operator of this subpackage:

* Words are cut from UTF-8 bytes, so that only the ASCII characters a contract
  names act as separators (``str.split`` would also cut at other white space).
* Python code sees Arrow batches inside tasks.  Spark bounds a batch by rows and
  by bytes, and no helper keeps more than one batch.
* Intermediate tables are written to the folder named by ``spark.checkpoint.dir``
  and read again.  They cut lineage and survive the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII byte outside 0-9 and a-z into a space.
ALNUM_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Lower-cases A-Z alone.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, which only a local master can
    share with its tasks; on a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Lets Spark delete the shuffle files of a query when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str = "stage", codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back; the shuffle files behind it go."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}-{name}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores before it as it takes to be the name of no column, whatever its case."""
    held = {c.lower() for c in columns}
    while name in held:
        name = f"_{name}"
    return name


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when the task ends, Arrow gives back what it holds unused, as a Python worker outlives its tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return tidied


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list | pa.RecordBatch | None]], schema: str) -> DataFrame:
    """df through a function of Arrow batches.

    ``make`` runs once in each task and returns that function, which returns
    columns in the order of ``schema`` (lists, numpy or Arrow arrays).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (columns := each(batch)) is not None:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; None for null."""
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return text.split() if text else []


def folded_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text; none for null."""
    return text.translate(ALNUM_FOLD).split() if text else []


class KnownTable:
    """Values of keys that are computed in batches when first met.

    Two generations bound it: when ``limit`` keys are young, they become old and
    the old ones go; an old key that is met again is young again.  It only saves
    time, and lives as long as its owner.
    """

    def __init__(self, compute: Callable[[list[bytes]], Iterator], limit: int):
        self.compute, self.limit = compute, limit
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def holding(self, keys: set[bytes]) -> dict[bytes, object]:
        """A mapping that holds all of the keys."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        missing = []
        for k in keys.difference(self.young):
            value = self.old.get(k)
            if value is None:
                missing.append(k)
            else:
                self.young[k] = value
        self.young.update(zip(missing, self.compute(missing), strict=True))
        return self.young

    def values(self, keys: list[bytes]) -> list:
        """The values of distinct keys, in their order."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, keys))
        lacking = [i for i, v in enumerate(out) if v is None]
        found = [self.old.get(keys[i]) for i in lacking]
        missing = [keys[i] for i, v in zip(lacking, found, strict=True) if v is None]
        fresh = iter(self.compute(missing))
        for i, v in zip(lacking, found, strict=True):
            out[i] = self.young[keys[i]] = next(fresh) if v is None else v
        return out

    def all_values(self, keys: list[bytes]) -> list:
        """The values of keys that may occur more than once."""
        distinct = list(set(keys))
        held = dict(zip(distinct, self.values(distinct), strict=True))
        return [held[k] for k in keys]


def slices(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in runs of about ``limit`` bytes, null as empty: what is split into words at once stays small."""
    out, held = [], 0
    for t in texts:
        out.append(t or b"")
        held += len(out[-1])
        if held >= limit:
            yield out
            out, held = [], 0
    if out:
        yield out


#: Odd multipliers of the polynomial hash and of its finishing mix (both are fixed constants of this file).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher; wraps around silently."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive word hashes (len(h) - n + 1 of them, none if h is shorter)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=np.uint64)
        for i in range(n):
            out = out * _BASE + h[i : i + m]
        return mix64(out + np.uint64(n))


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean mask of n words of which each start covers ``width``."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def default_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a column over all rows: one small aggregate."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]

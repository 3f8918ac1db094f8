"""Sharding by size-tiered compaction (operator 6): DataFrame functions only.

Arrivals become small immutable shards (Parquet files).  A compaction looks at
the sizes in the manifest: shards of one tier (sizes within a factor of
``FANIN``) are taken in order of arrival into runs of up to the target size, and
each run is rewritten as one shard.  Rows move only when their shard is merged.

Versions.  The manifest of a version names all live shards: those of the version
before, plus what arrived, or less what was merged.  It is written as a folder
under a name of its own, which is then renamed to ``_manifest/<version>``: that
fails if the name is taken.  So of two writers one commits, and the other builds
its manifest anew on the version that won (an arrival always can, a merge if its
shards are still live).  Readers take the highest version, or any that is not
vacuumed, and read just the files that it names; a failed step leaves files that
no version names.  The file system must rename atomically, as HDFS and local ones do.

Layout: ``data/<commit>/part-*.parquet`` and ``_manifest/<version>/part-*.parquet``.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, shared_dir, table

#: Bytes at which a shard is finished, and bytes of rows that an arriving shard holds at most (as text).
TARGET_BYTES = 32 << 20
ARRIVAL_BYTES = 4 << 20
#: Ratio of sizes between tiers.
FANIN = 4
#: Shards that a run merges at most (more make several runs, merged again later), and runs that one commit rewrites at
#: most (further commits take the rest): the driver names no more than their product of paths at a time.
RUN_SHARDS, COMMIT_RUNS = 64, 1000
#: Small shards whose sizes are summed up in one task, about.
LANE_SHARDS = 100_000

MANIFEST = "shard string, path string, bytes long, n_rows long, first_id long, last_id long, arrival long"
_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]


def _store(spark: SparkSession, path: str):
    """(Hadoop FileContext, Path) of a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, ascending."""
    store, at = _store(spark, f"{root}/_manifest")
    if not store.util().exists(at):
        return []
    return sorted(int(n) for s in store.util().listStatus(at) if (n := s.getPath().getName()).isdigit())


def latest_version(spark: SparkSession, root: str) -> int:
    """The highest version; 0 of a root without any."""
    return max(versions(spark, root), default=0)


def _named(root: str, version: int) -> str:
    return f"{root}/_manifest/{version:08d}"


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The live shards of a version, the latest by default; none before the first."""
    version = latest_version(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(_named(root, version))


def _commit(shards: DataFrame, root: str, version: int) -> bool:
    """Writes a manifest and renames it to the version; False if another writer has committed that one."""
    spark = shards.sparkSession
    name = f"{root}/_manifest/_{uuid.uuid4().hex}"
    shards.select(_COLUMNS).write.parquet(name)
    store, old = _store(spark, name)
    none = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        store.rename(old, _store(spark, _named(root, version))[1], none)
    except Py4JJavaError:
        store.delete(old, True)
        if version in versions(spark, root):
            return False
        raise
    return True


def _files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(path, bytes, n_rows, first_id, last_id) of the files below a folder; of their rows only doc_id is read."""
    rows = spark.read.schema(schema).parquet(path).select(F.col("doc_id").alias("id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).withColumn("shard", F.sha1("path"))


def append(docs: DataFrame, root: str, arrival_bytes: int = ARRIVAL_BYTES) -> int:
    """Writes docs(doc_id, ...) as arriving shards without a shuffle and commits them on top of the latest version; returns the new one.

    A shard holds as many rows as have ``arrival_bytes`` of text at the mean size of
    a row.  Other columns may have any names but ``_metadata``.  Rows are kept as they
    are: nulls, empty texts and repeated rows too; an empty table commits a version
    without new shards.
    """
    if "_metadata" in (c.lower() for c in docs.columns):
        raise ValueError("a column named _metadata hides what Spark knows of files")
    spark = docs.sparkSession
    mean = docs.agg(F.avg(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 16)).first()[0] or 1.0
    folder = f"{root}/data/{uuid.uuid4().hex}"
    docs.write.option("compression", "zstd").option("maxRecordsPerFile", max(1, int(arrival_bytes / mean))).parquet(folder)
    files = _files(spark, folder, docs.schema)
    while True:
        base = latest_version(spark, root)
        if _commit(manifest(spark, root, base).unionByName(files.withColumn("arrival", F.lit(base + 1).cast("long"))), root, base + 1):
            return base + 1


def plan(shards: DataFrame, target_bytes: int = TARGET_BYTES, fanin: int = FANIN, fewest: int = 2) -> DataFrame:
    """(path, arrival, run) of the shards that are to be merged: within a tier, in order of arrival, runs of up to the target size.

    Shards of at least half the target stay as they are; so do runs of less than
    ``fewest``.  Each task orders the small shards of a tier in one lane; there are
    more lanes from LANE_SHARDS small shards on.
    """
    small = shards.filter(F.col("bytes") < target_bytes / 2)
    lanes = -(-small.count() // LANE_SHARDS) or 1
    tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1))) / F.log(F.lit(float(fanin)))).cast("int")
    dealt = small.select("path", "arrival", "bytes", tier.alias("tier"), F.pmod(F.xxhash64("path"), F.lit(lanes)).alias("lane"))
    order = Window.partitionBy("tier", "lane").orderBy("arrival", "path")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = dealt.withColumn("run", F.concat_ws("-", "tier", "lane", F.floor(before / target_bytes), F.floor((F.row_number().over(order) - 1) / RUN_SHARDS)))
    enough = F.count(F.lit(1)).over(Window.partitionBy("run")) >= fewest
    return runs.withColumn("enough", enough).filter("enough").select("path", "arrival", "run")


def compact(spark: SparkSession, root: str, schema: StructType, target_bytes: int = TARGET_BYTES, fanin: int = FANIN, fewest: int = 2) -> int | None:
    """One compaction of the latest version; returns the version that it commits, or None where no run has ``fewest`` shards.

    Up to COMMIT_RUNS runs are rewritten, each by one task into one shard.  If
    another writer has merged one of their shards meanwhile, nothing is committed
    and the plan is made anew.
    """
    while True:
        base = latest_version(spark, root)
        shards = manifest(spark, root, base)
        runs = plan(shards, target_bytes, fanin, fewest)
        first = runs.groupBy("run").agg(F.min("arrival").alias("oldest")).orderBy("oldest", "run").limit(COMMIT_RUNS).withColumn("n", F.row_number().over(Window.orderBy("oldest", "run")) - 1)
        # At most COMMIT_RUNS * RUN_SHARDS rows: they bound the driver's list and what is broadcast.
        picked = runs.join(first, "run").select("path", "n", "oldest").collect()
        if not picked:
            return None
        number = free_name("run", schema.names)
        source = free_name("file", schema.names)
        own = spark.createDataFrame([(r["path"], int(r["n"])) for r in picked], f"{source} string, {number} int")
        rows = spark.read.schema(schema).parquet(*(r["path"] for r in picked)).withColumn(source, F.col("_metadata.file_path")).join(F.broadcast(own), source).drop(source)
        folder = f"{root}/data/{uuid.uuid4().hex}"
        count = max(r["n"] for r in picked) + 1
        rows.repartitionById(count, F.col(number)).drop(number).write.option("compression", "zstd").parquet(folder)
        oldest = spark.createDataFrame([(n, a) for n, a in {r["n"]: r["oldest"] for r in picked}.items()], "n int, arrival long")
        merged = _files(spark, folder, schema).withColumn("n", F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int")).join(F.broadcast(oldest), "n")
        gone = spark.createDataFrame([(r["path"],) for r in picked], "path string")
        while True:
            now = manifest(spark, root, base)
            if now.join(F.broadcast(gone), "path", "left_semi").count() < len(picked):
                break  # a shard is no longer live: another compaction was faster
            if _commit(now.join(F.broadcast(gone), "path", "left_anti").select(_COLUMNS).unionByName(merged.select(_COLUMNS)), root, base + 1):
                return base + 1
            base = latest_version(spark, root)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the ``keep`` latest versions, and the data folders that only those name; their readers must be done.

    A version names few folders, one for each commit that has live shards.  Folders
    of no version (of failed or running steps) stay.
    """
    held = versions(spark, root)
    old, kept = held[:-keep], held[-keep:]
    folders = lambda vs: {r[0] for v in vs for r in manifest(spark, root, v).select(F.regexp_extract("path", "/data/([0-9a-f]+)/", 1)).distinct().collect()}
    retired = folders(old) - folders(kept) if old else ()
    for path in (*(f"{root}/data/{f}" for f in retired), *(_named(root, v) for v in old)):
        store, at = _store(spark, path)
        store.delete(at, True)


def read(spark: SparkSession, root: str, version: int | None, schema: StructType) -> DataFrame:
    """The rows of a version (None: the latest).  The driver names each live shard, as Spark's own list of a scan's files does."""
    paths = [r["path"] for r in manifest(spark, root, version).select("path").toLocalIterator()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def shard_documents(docs: DataFrame, root: str, target_bytes: int = TARGET_BYTES, arrival_bytes: int = ARRIVAL_BYTES) -> int:
    """Appends docs and compacts until no run of similar shards is left; returns the final version."""
    spark, version = docs.sparkSession, append(docs, root, arrival_bytes)
    while (new := compact(spark, root, docs.schema, target_bytes)) is not None:
        version = new
    return version


#: Arrivals of the query below.
ARRIVALS = 3


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the final shards: doc_id, n_bytes, text_sha256, and whether its shard keeps to the target size.

    All documents arrive in ARRIVALS parts, by hash of doc_id; after each, tiers that
    have FANIN shards are merged, at the end all that have two.
    """
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    root = f"{shared_dir(spark)}-shards"
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        append(docs.filter(part == k), root)
        while compact(spark, root, docs.schema, fewest=FANIN if k < ARRIVALS - 1 else 2) is not None:
            vacuum(spark, root)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = read(spark, root, None, docs.schema)
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), (F.col("_metadata.file_size") <= 2 * TARGET_BYTES).alias("within_target"))


ORACLE_OP6 = """
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, true AS within_target FROM documents
"""

"""Scans and sinks.  Everything goes through Spark's readers and writers, so any store that Spark knows will do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import relevant, strip_markup


def scan_items(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Items of JSON documents that are an array or an object with ``items``; a column ``file`` names their source.

    A document that can't be read gives one row with null items and its text in
    ``_corrupt_record``, so it can be counted.
    """
    wide = StructType([*schema.fields, StructField("items", ArrayType(schema)), StructField("_corrupt_record", StringType())])
    rows = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))
    own = F.struct(*(F.col(f.name) for f in schema.fields))
    listed = F.when(F.col("items").isNotNull(), F.col("items")).when(F.col("_corrupt_record").isNull(), F.array(own))
    return rows.select("file", "_corrupt_record", F.explode_outer(listed).alias("i")).select("file", "_corrupt_record", "i.*")


def scan_candidates(origins: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Rows of several origins in one shape: missing columns are null, ``origin`` tells them apart."""
    out = None
    for name in sorted(origins):
        df = origins[name]
        one = df.select(*(c for c in columns if c in df.columns)).withColumn("origin", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _tag(block: Column, *names: str) -> Column:
    """The text of the first of some tags that a block has."""
    inner = [F.nullif(F.trim(F.regexp_extract(block, f"(?is)<{n}(?:\\s[^>]*)?>(.*?)</{n}>", 1)), F.lit("")) for n in names]
    return F.coalesce(*inner, F.lit(""))


#: Fixed value: characters of an item's summary.
SUMMARY = 280


def parse_feeds(feeds: DataFrame, per_feed: int = 40, only_relevant: bool = True) -> DataFrame:
    """Items of landed feed bodies feeds(feed, source, weight, language, body), RSS or Atom, the first ``per_feed`` of each.

    Items need a title and an http address; the id is 16 digits of the address's sha1.
    """
    blocks = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)(<item\b.*?</item>|<entry\b.*?</entry>)"), F.lit(1))
    rows = feeds.select("feed", "source", "weight", "language", F.posexplode(F.slice(blocks, 1, per_feed)).alias("position", "b"))
    link = F.coalesce(F.nullif(_tag(F.col("b"), "link"), F.lit("")), F.regexp_extract("b", r"(?i)<link\b[^>]*\bhref\s*=\s*[\"']([^\"']+)", 1))
    out = rows.select("feed", "source", "weight", "language", "position", strip_markup(_tag(F.col("b"), "title")).alias("title"), strip_markup(link).alias("url"), F.substring(strip_markup(_tag(F.col("b"), "description", "summary", "content:encoded", "content")), 1, SUMMARY).alias("summary"), strip_markup(_tag(F.col("b"), "pubDate", "published", "updated", "dc:date")).alias("published"))
    ok = (F.col("title") != "") & F.col("url").rlike("(?i)^https?://")
    out = out.filter(ok & relevant(F.concat_ws(" ", "title", "summary", "url")) if only_relevant else ok)
    times = F.coalesce(F.try_to_timestamp("published"), F.try_to_timestamp(F.regexp_replace("published", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(F.regexp_replace("published", r"^\w{3},\s*", ""), " GMT$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    return out.select(F.substring(F.sha1("url"), 1, 16).alias("id"), *out.columns).withColumn("published_at", times)


def page_meta(html: Column) -> Column:
    """struct(title, description, published, image) of a page, each the first that is not empty in a fixed order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def meta(*keys: str) -> list[Column]:
        pick = lambda k: F.try_element_at(F.filter(tags, lambda t: t.rlike(f"(?i)(?:property|name|itemprop)\\s*=\\s*[\"']{k}[\"']")), F.lit(1))
        return [F.nullif(F.trim(F.regexp_extract(pick(k), r"(?i)content\s*=\s*[\"']([^\"']*)", 1)), F.lit("")) for k in keys]

    title = F.nullif(strip_markup(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    link = F.nullif(F.regexp_extract(html, r"(?i)<link\b[^>]*rel\s*=\s*[\"']image_src[\"'][^>]*href\s*=\s*[\"']([^\"']+)", 1), F.lit(""))
    return F.struct(
        F.coalesce(*meta("og:title"), title).alias("title"), F.coalesce(*meta("og:description", "description")).alias("description"),
        F.coalesce(*meta("article:published_time", "date", "datePublished")).alias("published"), F.coalesce(*meta("og:image:secure_url", "og:image", "twitter:image", "twitter:image:src"), link).alias("image"),
    )


def scan_listing(spark: SparkSession, path: str, folder: str = "snapshots") -> DataFrame:
    """(key, size, modified, version, file) of the objects below a prefix, split behind ``folder``; no contents are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    pattern = f"/{folder}/([^/]+)/(.*)$"
    return rows.withColumns({"version": F.regexp_extract("key", pattern, 1), "file": F.regexp_extract("key", pattern, 2)})


#: What a version may be called, and the bytes of a file.
VERSION = r"^[A-Za-z0-9._:-]{1,160}$"
FILE_BYTES = (1, 100_000_000)


def publish_snapshot(frames: dict[str, DataFrame], root: str, version: str, max_bytes: int = 8_000_000, channel: str = "news") -> DataFrame:
    """Writes frames below snapshots/<version>/, then their manifest, and last the pointer ``current``; returns the manifest.

    The manifest has channel, version, key, bytes and sha256 of each file.  Over
    ``max_bytes`` the files are deleted again and ValueError is raised: no manifest
    names them, and the pointer stays where it was.
    """
    if not re.match(VERSION, version):
        raise ValueError(f"{version!r} is no version")
    spark = next(iter(frames.values())).sparkSession
    base = f"{root}/snapshots/{version}"
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load([f"{base}/{name}" for name in frames])
    total = files.agg(F.sum("length")).first()[0] or 0
    if total > max_bytes:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        raise ValueError(f"the snapshot has {total} bytes, more than {max_bytes}")
    file = F.regexp_extract("path", f"/snapshots/{re.escape(version)}/(.*)$", 1)
    listed = files.select(F.lit(channel).alias("channel"), F.lit(version).alias("version"), file.alias("file"), F.concat(F.lit(f"{channel}/snapshots/{version}/"), file).alias("key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{base}/_manifest")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{root}/current")
    return spark.read.parquet(f"{base}/_manifest")


def verify_snapshot(spark: SparkSession, root: str, version: str, channel: str = "news") -> DataFrame:
    """(file, problem) of a published version, the first that holds of: missing, unlisted, channel, version, key, format, bytes, sha256.

    The manifest must be of the channel and version, name keys below them, digests of
    64 hex digits and possible sizes, and agree with the files.
    """
    base = f"{root}/snapshots/{version}"
    said = spark.read.parquet(f"{base}/_manifest").select("file", *(F.col(c).alias(f"_{c}") for c in ("channel", "version", "key", "bytes", "sha256")))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(base).filter(~F.col("path").contains("/_manifest/"))
    real = rows.select(F.regexp_extract("path", f"/snapshots/{re.escape(version)}/(.*)$", 1).alias("file"), F.col("length").alias("_rb"), F.sha2("content", 256).alias("_rs"))
    formed = F.col("_sha256").rlike("^[a-f0-9]{64}$") & F.col("_bytes").between(*FILE_BYTES)
    key = F.concat(F.lit(f"{channel}/snapshots/{version}/"), F.col("file"))
    problem = (
        F.when(F.col("_rb").isNull(), "missing").when(F.col("_bytes").isNull(), "unlisted").when(F.col("_channel") != channel, "channel").when((F.col("_version") != version) | ~F.col("_version").rlike(VERSION), "version")
        .when(F.col("_key") != key, "key").when(~formed, "format").when(F.col("_bytes") != F.col("_rb"), "bytes").when(F.col("_sha256") != F.col("_rs"), "sha256")
    )
    return said.join(real, "file", "full_outer").select("file", problem.alias("problem")).filter("problem IS NOT NULL")


#: Rows of a month that one task of the archive writes, about.
ARCHIVE_ROWS = 1_000_000


def write_monthly_archive(df: DataFrame, path: str, ts: str, key: str, index: DataFrame | None = None) -> DataFrame:
    """Rewrites the months of df whose rows differ from ``index``, and deletes those that are gone; returns the new index (month, n, newest, oldest, digest)."""
    spark = df.sparkSession
    rows = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    # A sum of row digests: order-free, and combined before the shuffle.
    digest = F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).cast("string")
    new = rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest"), F.min(ts).alias("oldest"), digest.alias("digest"))
    changed = new
    if index is not None:
        old = index.select("month", F.col("digest").alias("_d"))
        changed = new.join(old, "month", "left").filter("_d IS NULL OR _d <> digest")
        gone = old.join(new, "month", "left_anti").select("month").collect()  # a row a month
        for r in gone:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/month={r[0]}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    # A large month is dealt over several tasks.
    dealt = rows.join(F.broadcast(changed.select("month", F.ceil(F.col("n") / ARCHIVE_ROWS).alias("_parts"))), "month")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts"))).repartition("month", "_part").drop("_part", "_parts")
    dealt.sortWithinPartitions("month", F.desc(ts), key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return new


def read_archive(spark: SparkSession, path: str, ts: str, key: str, first: str | None = None, last: str | None = None, legacy: str | None = None) -> DataFrame:
    """The archive's rows, newest first per key; months outside the range aren't read.

    Where there is no archive, the full snapshot ``legacy`` is read instead; a
    month whose name is none is an error.
    """
    from ..operators.dedup import keep_newest

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if legacy is not None and not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        rows = spark.read.parquet(legacy)
        rows = rows.withColumn("month", F.date_format(ts, "yyyy-MM"))
    else:
        rows = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
        month = F.when(F.col("month").rlike(r"^\d{4}-\d{2}$"), F.col("month")).otherwise(F.raise_error(F.concat(F.lit("no month: "), F.col("month"))).cast("string"))
        rows = rows.filter(month.isNotNull())
    if first:
        rows = rows.filter(F.col("month") >= first)
    if last:
        rows = rows.filter(F.col("month") <= last)
    return keep_newest(rows, key, ts, key)

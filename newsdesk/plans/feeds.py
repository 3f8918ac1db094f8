"""Queries of scans, sinks and streams: what they read is first written from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import ratings
from ..sources import io
from ..sources.scratch import scratch_dir
from ..streaming import streams
from .registry import ORACLES, query, table

#: Rows in a landed document.
_CHUNK = 50


@query("SELECT p_partkey, p_name, p_brand, false AS corrupt FROM part")
def envelope_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts landed as JSON documents, arrays and objects with items by turns, and read back."""
    path = scratch_dir(spark)
    n = F.floor(F.col("p_partkey") / _CHUNK)
    items = F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_brand")))
    docs = table(spark, sf_dir, "part").groupBy(n.alias("n")).agg(items.alias("items"))
    text = F.when(F.col("n") % 2 == 0, F.col("items")).otherwise(F.concat(F.lit('{"items":'), F.col("items"), F.lit("}")))
    docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    schema = StructType([StructField("p_partkey", LongType()), StructField("p_name", StringType()), StructField("p_brand", StringType())])
    return io.scan_items(spark, path, schema).select("p_partkey", "p_name", "p_brand", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query(
    """SELECT 'customer' AS origin, c_custkey AS id, c_name AS title, c_nationkey AS nation, c_acctbal AS score FROM customer UNION ALL
SELECT 'part', p_partkey, p_name, NULL, p_retailprice FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, NULL FROM supplier"""
)
def candidate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = {
        "customer": table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS title", "c_nationkey AS nation", "c_acctbal AS score", "c_mktsegment"),
        "supplier": table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS title", "s_nationkey AS nation"),
        "part": table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS title", "p_retailprice AS score"),
    }
    return io.scan_candidates(origins, ["id", "title", "nation", "score"]).select("origin", "id", "title", "nation", "score")


@query(
    """WITH p AS (SELECT page_id, page_id // 50 AS feed, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS position, url FROM pages WHERE url IS NOT NULL)
SELECT feed, CAST(position AS INTEGER) AS position, substr(sha1(u), 1, 16) AS id, 'Game & more ' || page_id AS title, u AS url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'New release, page ' || page_id END AS summary, TIMESTAMP '2024-01-01' + INTERVAL (page_id % 28) DAY + INTERVAL (page_id % 60) MINUTE AS published_at
FROM (SELECT *, trim(url) AS u FROM p) WHERE position < 40 AND regexp_matches(u, '(?i)^https?://')"""
)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed as feeds of fifty, RSS and Atom by turns, parsed into items."""
    p = table(spark, sf_dir, "pages").filter("url IS NOT NULL").withColumn("feed", F.floor(F.col("page_id") / 50))
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") % 28) * 86400 + (F.col("page_id") % 60) * 60)
    name = F.col("page_id").cast("string")
    link = F.replace(F.trim("url"), F.lit("&"), F.lit("&amp;"))
    text = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<description><![CDATA[<p>New release,</p> page "), name, F.lit("]]></description>"))).otherwise("")
    rss = F.concat(F.lit("<item><title>Game &amp; more "), name, F.lit("</title><link>"), link, F.lit("</link>"), text, F.lit("<pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title type='html'>Game &amp; more "), name, F.lit("</title><link rel='alternate' href='"), link, F.lit("'/>"), F.replace(text, F.lit("description"), F.lit("summary")), F.lit("<published>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</published></entry>"))
    blocks = p.select("feed", F.struct("page_id", F.when(F.col("feed") % 2 == 0, rss).otherwise(atom).alias("b")).alias("b")).groupBy("feed").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    feeds = blocks.select("feed", F.lit("s").alias("source"), F.lit(1.0).alias("weight"), F.lit("en").alias("language"), F.concat(F.lit("<rss><channel><title>head</title>"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), F.lit("</channel></rss>")).alias("body"))
    return io.parse_feeds(feeds).select("feed", "position", "id", "title", "url", "summary", "published_at")


@query(
    """SELECT 'nation' AS frame, (SELECT count(*) FROM nation) AS n_rows, 0 AS problems, true AS listed UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 0, true UNION ALL SELECT 'part', (SELECT count(*) FROM part), 1, true"""
)
def snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables published as a snapshot, one of which gets a file more than its manifest names: rows, problems and listing of each."""
    root, version = scratch_dir(spark), "2024-01-31T00:00:00Z"
    names = ("nation", "orders", "part")
    manifest = io.publish_snapshot({n: table(spark, sf_dir, n) for n in names}, root, version, 1 << 40)
    counts = None
    for n in names:
        one = spark.read.parquet(f"{root}/snapshots/{version}/{n}").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("frame", F.lit(n))
        counts = one if counts is None else counts.unionByName(one)
    counts = spark.createDataFrame(counts.collect(), counts.schema)  # three rows, counted before the extra file
    table(spark, sf_dir, "part").limit(1).coalesce(1).write.mode("append").parquet(f"{root}/snapshots/{version}/part")
    frame = F.substring_index("file", "/", 1)
    problems = io.verify_snapshot(spark, root, version).groupBy(frame.alias("frame")).agg(F.count(F.lit(1)).alias("problems"))
    listing = io.scan_listing(spark, root).filter(F.col("version") == version).select(frame.alias("frame")).distinct().join(manifest.select(frame.alias("frame")).distinct(), "frame", "left_semi").withColumn("listed", F.lit(True))
    return counts.join(problems, "frame", "left").join(listing, "frame", "left").select("frame", "n_rows", F.coalesce("problems", F.lit(0)).cast("int").alias("problems"), F.coalesce("listed", F.lit(False)).alias("listed"))


@query("""SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, max(event_id) AS newest_id, sum(value) AS value FROM events GROUP BY 1""")
def monthly_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events archived by month, first half of them with other values, then all: the archive's rows by month."""
    path = scratch_dir(spark)
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    first = io.write_monthly_archive(e.filter("event_id % 2 = 0").withColumn("value", F.lit(0.0)), path, "ts", "event_id")
    io.write_monthly_archive(e, path, "ts", "event_id", spark.createDataFrame(first.collect(), first.schema))
    a = io.read_archive(spark, path, "ts", "event_id", legacy=f"{path}-none")
    return a.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest_id"), F.sum("value").alias("value"))


@query("""SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""")
def archive_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no archive is, its rows come from the full snapshot."""
    e = table(spark, sf_dir, "events")
    legacy = scratch_dir(spark)
    e.select("event_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(legacy)
    return io.read_archive(spark, f"{legacy}-none", "ts", "event_id", "2024-01", "2024-01", legacy=legacy).select("event_id", "month")


def _landed(df: DataFrame, batches: int) -> DataFrame:
    """df as a stream of so many micro-batches; each takes a file for each core, or more if the scan of df has more parts."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    each = max(spark.sparkContext.defaultParallelism, -(-df.rdd.getNumPartitions() // batches))
    df.repartition(batches * each).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def _drained(stream: DataFrame, mode: str) -> tuple[str, int]:
    """(path, last batch) of a stream run to its end; each batch is a folder."""
    path = scratch_dir(stream.sparkSession)
    run = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return path, run.lastProgress["batchId"] if run.lastProgress else 0


@query(
    """WITH v AS (SELECT l_partkey AS game, l_suppkey AS voter, l_linenumber AS rating FROM lineitem WHERE l_linenumber BETWEEN 1 AND 10 QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1)
SELECT CAST(game AS VARCHAR) AS game, count(*) AS votes, floor(avg(rating) * 100 + 0.5) / 100 AS mean FROM v GROUP BY 1"""
)
def vote_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as a stream of votes in three micro-batches: the last vote of each voter counts."""
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("game"), F.col("l_suppkey").cast("string").alias("voter"), F.col("l_linenumber").alias("rating"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    path = scratch_dir(spark)
    streams.vote_stream(_landed(votes, 3), path, f"{path}-state").awaitTermination()
    return ratings.vote_totals(streams.read_votes(spark, path), "game", "rating")


@query("""SELECT DISTINCT user_id || '-' || strftime(ts, '%Y-%m-%d') AS canonical_url FROM events""")
def intake_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an intake of one address for each user and day: each is let in once."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("canonical_url"), F.col("ts").cast("timestamp").alias("published_at"))
    path, _ = _drained(streams.dedupe_intake(_landed(e, 1)), "append")
    return spark.read.parquet(path).select("canonical_url")


@query(ORACLES["mention_windows"])
def mention_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the batch query, from the panes of a stream of events in two micro-batches."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    path, last = _drained(streams.mention_panes(_landed(e, 2), "ts", "user_id", "event_type", "value", "24 hours"), "complete")
    return streams.windows_of_panes(spark.read.parquet(f"{path}/batch={last}"), "user_id", "event_type", 96, 24)


@query(
    """WITH s AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error' AND event_type <> 'view') AS last FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS source, count(*) FILTER (event_type = 'error' AND (last IS NULL OR (ts, event_id) > last)) AS failures, count(*) FILTER (event_type = 'error' AND (last IS NULL OR (ts, event_id) > last)) >= 3 AS persistent FROM events JOIN s USING (user_id) GROUP BY 1"""
)
def source_health_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checks of sources: errors fail, views don't check, others succeed."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped").otherwise("ok")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status.alias("status"))
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(key)
    spark.conf.set(key, rocks)
    try:
        path, _ = _drained(streams.source_health(_landed(e, 1)), "update")
    finally:
        spark.conf.set(key, old)
    return spark.read.parquet(path).select("source", "failures", "persistent")


@query(
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS revisions FROM orders)
SELECT o_orderkey, revisions, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, CAST(3 AS BIGINT) AS runs FROM a"""
)
def snapshot_import_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders imported as snapshots: all, the same again, then a quarter of them changed; revisions, items and successful runs."""
    path = scratch_dir(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    columns = ["o_orderstatus", "o_totalprice"]
    streams.snapshot_stream(_landed(o, 1), f"{path}-ledger", "o_orderkey", columns, f"{path}-state", f"{path}-items", f"{path}-runs").awaitTermination()
    for run, items in ((1, o), (2, o.filter("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("X")))):
        streams.import_snapshot(items, f"{path}-ledger", "o_orderkey", columns, f"{path}-items", f"{path}-runs", f"batch-{run}", run)
    revisions = spark.read.parquet(f"{path}-ledger").groupBy("o_orderkey").agg(F.max("revision_no").alias("revisions"))
    runs = spark.read.schema(streams.RUNS).parquet(f"{path}-runs").agg(F.count_if(F.col("status") == "success").alias("runs"))
    return streams.current_items(spark, f"{path}-items", o, "o_orderkey", columns).join(revisions, "o_orderkey").crossJoin(runs).select("o_orderkey", "revisions", "o_orderstatus", "o_totalprice", "runs")

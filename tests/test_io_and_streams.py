from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from newsdesk.operators import popularity, ratings
from newsdesk.operators.dedup import latest
from newsdesk.operators.ledger import failure_streaks
from newsdesk.sources import io
from newsdesk.streaming import streams


def test_scan_items(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": "1"}, {"id": "2"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "3"}]))
    (tmp_path / "c.json").write_text("{broken")
    rows = io.scan_items(spark, f"file://{tmp_path}", StructType([StructField("id", StringType())])).collect()
    assert sorted(r.id for r in rows if r.id) == ["1", "2", "3"]
    assert sum(r._corrupt_record is not None for r in rows) == 1


def test_feeds(spark):
    rss = "<rss><item><title>Game &amp; launch</title><link>https://x.com/1</link><pubDate>Sun, 09 Aug 2026 10:00:00 GMT</pubDate><description><![CDATA[<b>Big</b> release]]></description></item><item><title>Quiz</title><link>https://x.com/2</link></item></rss>"
    atom = '<feed><entry><title>PC patch</title><link href="https://y.com/3"/><updated>2026-08-09T10:00:00Z</updated></entry><entry><title></title></entry></feed>'
    df = spark.createDataFrame([("a", "A", 1.0, "en", rss), ("b", "B", 2.0, "en", atom), ("c", "C", 1.0, "en", None)], "feed string, source string, weight double, language string, body string")
    rows = {r.title: r for r in io.parse_feeds(df).collect()}
    assert set(rows) == {"Game & launch", "PC patch"}
    assert rows["Game & launch"].summary == "Big release" and rows["PC patch"].url == "https://y.com/3"
    assert str(rows["Game & launch"].published_at) == str(rows["PC patch"].published_at) == "2026-08-09 10:00:00"


def test_page_meta(spark):
    html = '<title>T</title><meta property="og:image" content="i.png"><meta name="description" content="D"><meta property="article:published_time" content="2026-01-01">'
    r = spark.createDataFrame([(html,)], "h string").select(io.page_meta(F.col("h")).alias("m")).first().m
    assert (r.title, r.description, r.published, r.image) == ("T", "D", "2026-01-01", "i.png")


def test_snapshot_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    io.publish_snapshot({"news": spark.range(10)}, root, "v1")
    assert io.verify_snapshot(spark, root, "v1").count() == 0
    assert io.scan_listing(spark, root).filter("version = 'v1'").count() > 0
    part = next(p for p in (tmp_path / "snapshots/v1/news").iterdir() if p.suffix == ".parquet")
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink()
    assert [r.problem for r in io.verify_snapshot(spark, root, "v1").collect()] == ["bytes"]
    with pytest.raises(ValueError, match="more than"):
        io.publish_snapshot({"news": spark.range(10)}, root, "v2", max_bytes=10)


def test_archive_rewrites_changed_months_only(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    df = spark.createDataFrame([("a", "2026-01-05"), ("b", "2026-02-05")], "url string, d string").select("url", F.col("d").cast("timestamp").alias("ts"))
    index = io.write_monthly_archive(df, path, "ts", "url")
    index = spark.createDataFrame(index.collect(), index.schema)
    before = {p.name for p in (tmp_path / "archive/month=2026-01").iterdir()}
    more = df.unionByName(spark.createDataFrame([("c", "2026-02-06")], "url string, d string").select("url", F.col("d").cast("timestamp").alias("ts")))
    io.write_monthly_archive(more, path, "ts", "url", index)
    assert {p.name for p in (tmp_path / "archive/month=2026-01").iterdir()} == before
    assert io.read_archive(spark, path, "ts", "url").count() == 3
    assert io.read_archive(spark, path, "ts", "url", first="2026-02").count() == 2


def _votes(spark):
    rows = [("g", "v1", 5, 10), ("g", "v1", 7, 20), ("g", "v1", 3, 5), ("g", "v2", 11, 1), ("g", "v3", 9, 1), ("h", "v1", 2, 1)]
    return spark.createDataFrame(rows, "game string, voter string, rating int, t long").select("game", "voter", "rating", F.timestamp_seconds("t").alias("ts"))


def test_vote_stream_equals_its_batch(spark, tmp_path):
    votes = _votes(spark)
    votes.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(votes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.vote_stream(stream, f"{tmp_path}/votes", f"{tmp_path}/cp").awaitTermination()
    got = ratings.vote_totals(streams.read_votes(spark, f"{tmp_path}/votes"), "game", "rating")
    want = ratings.vote_totals(latest(votes.filter("rating between 1 and 10"), ["game", "voter"], ["ts", "rating"]), "game", "rating")
    assert sorted(got.collect()) == sorted(want.collect())


def test_intake_and_mentions_streams(spark, tmp_path):
    rows = [("u1", 0, "a"), ("u1", 3600, "a"), ("u2", 7200, "b")]
    df = spark.createDataFrame(rows, "canonical_url string, t long, game string").select("canonical_url", F.timestamp_seconds("t").alias("published_at"), "game", F.lit("f").alias("family"), F.lit(1.0).alias("value"))
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streams.dedupe_intake(source).writeStream.format("memory").queryName("intake").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("intake").count() == 2
    q = streams.mention_panes(source, "published_at", "game", "family", "value", "1 hour").writeStream.format("memory").queryName("mentions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    twin = popularity.mention_windows(df, "published_at", "game", "family", "value", "2 hours", "1 hour")
    windows = streams.windows_of_panes(spark.table("mentions"), "game", "family", 2, 1)
    assert sorted(windows.collect()) == sorted(twin.select(windows.columns).collect())
    # Each row is in one pane: no Expand before the state.
    assert spark.table("mentions").agg(F.sum("mentions")).first()[0] == df.count()


def test_source_health_stream_equals_its_batch(spark, tmp_path):
    rows = [("a", 1, 1, "error"), ("a", 2, 2, "error"), ("a", 3, 3, "skipped"), ("a", 4, 4, "error"), ("b", 1, 5, "error"), ("b", 2, 6, "ok")]
    df = spark.createDataFrame(rows, "source string, ts int, seq int, status string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = streams.source_health(source).writeStream.format("memory").queryName("health").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    ok = F.when(F.col("status") == "ok", True).when(F.col("status") == "error", False)
    twin = failure_streaks(df, "source", "ts", "seq", ok)
    assert {(r.source, r.failures, r.persistent) for r in spark.table("health").collect()} == {(r.source, r.failures, r.persistent) for r in twin.collect()}


def test_snapshot_import_is_idempotent(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("v", LongType())])
    items = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    ledger = f"{tmp_path}/ledger"
    for _ in range(2):
        streams.import_snapshot(items, ledger, "id", ["v"])
    assert spark.read.parquet(ledger).count() == 2
    streams.import_snapshot(items.withColumn("v", F.col("v") + 1).filter("id = 'a'"), ledger, "id", ["v"])
    assert sorted((r.id, r.revision_no) for r in spark.read.parquet(ledger).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def _bytes(path):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path, monkeypatch):
    """A large table of votes, then small batches: each writes its own rows, merges now and then, and reading gives the last vote."""
    monkeypatch.setattr(streams, "BUCKETS", 4)
    monkeypatch.setattr(streams, "RUNS_A_LEVEL", 3)
    table = f"{tmp_path}/votes"
    votes = lambda n, first, ts: spark.range(n).select(F.concat(F.lit("g"), F.col("id") % 50).alias("game"), (F.col("id") + first).cast("string").alias("voter"), (F.lit(ts) % 10 + 1).cast("int").alias("rating"), F.timestamp_seconds(F.lit(ts)).alias("ts"))
    streams.latest_votes(votes(20_000, 0, 1), table)
    first, lone = _bytes(f"{table}/v1"), 0
    for k in range(2, 9):
        streams.latest_votes(votes(20, 10 * k, k), table)
        noted = spark.read.schema(streams._RUN).parquet(f"{table}/_runs").filter(F.col("version") == k)
        alone = [r.bucket for r in noted.collect() if not r.merged]  # in the others the runs of a level became one
        assert sum(_bytes(f"{table}/v{k}/bucket={b}") for b in alone) < first / 4
        lone += len(alone)
    assert lone >= 14  # of 28, as each third run of a bucket merges
    got = {(r.game, r.voter): (r.rating, r.ts.timestamp()) for r in streams.read_votes(spark, table).collect()}
    want = {(f"g{i % 50}", str(i)): (2, 1.0) for i in range(20_000)}
    for k in range(2, 9):
        want |= {(f"g{i % 50}", str(i + 10 * k)): (k % 10 + 1, float(k)) for i in range(20)}
    assert got == want
    live = streams._live(spark, table)
    assert all(len(runs) <= 6 for runs in live.values()) and max(len(runs) for runs in live.values()) >= 2


def test_heads_of_a_ledger(spark, tmp_path):
    """What a batch compares with: the last revision of its items, also for a ledger that had no heads."""
    ledger = f"{tmp_path}/ledger"
    items = spark.createDataFrame([(str(i), i) for i in range(40)], "id string, v long")
    streams.import_snapshot(items, ledger, "id", ["v"])
    schema = "id string, revision_no int, digest string"
    few = items.filter("id = '7'")
    near = streams.read_touched(few, f"{ledger}-heads", ["id"], ["revision_no"], schema)
    assert 1 <= near.count() < 20 and near.filter("id = '7'").count() == 1
    old = f"{tmp_path}/old"
    spark.read.parquet(ledger).write.parquet(old)
    streams.import_snapshot(few.withColumn("v", F.lit(99).cast("long")).unionByName(items.filter("id = '8'")), old, "id", ["v"])
    assert sorted((r.id, r.revision_no) for r in spark.read.parquet(old).filter("id IN ('7', '8')").collect()) == [("7", 1), ("7", 2), ("8", 1)]

"""Streams of votes, intake, source checks, mentions and snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import latest
from ..operators.ledger import append_revisions, content_hash
from ..sources.scratch import release, stored


#: Buckets of a table of latest rows.
BUCKETS = 64
#: Runs of one level that a bucket holds; one more, and they become a run of the next level.
RUNS_A_LEVEL = 8


def _parts(spark: SparkSession) -> int:
    """Tasks that rows are dealt over before they are sorted."""
    return max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _live(spark: SparkSession, table: str) -> dict[int, dict[int, int]]:
    """Of each bucket its runs (versions) that no other has taken in, and their levels: a few for each level, which are few."""
    if not _exists(spark, f"{table}/_runs"):
        return {}
    noted = spark.read.schema(_RUN).parquet(f"{table}/_runs")
    gone = noted.select("bucket", F.explode("merged").alias("version"))
    out: dict[int, dict[int, int]] = {}
    for r in noted.join(gone, ["bucket", "version"], "left_anti").select("bucket", "version", "level").distinct().collect():
        out.setdefault(r["bucket"], {})[r["version"]] = r["level"]
    return out


_RUN = "bucket int, version int, level int, merged array<int>"


def _stored(spark: SparkSession, table: str, runs: list[tuple[int, int]], schema) -> list[DataFrame]:
    """The rows of runs (bucket, version) with their bucket, a DataFrame for each version that holds some."""
    out = []
    for v in sorted({v for _, v in runs}):
        paths = [f"{table}/v{v}/bucket={b}" for b, x in sorted(runs) if x == v]
        out.append(spark.read.schema(StructType([*schema, StructField("bucket", IntegerType())])).option("basePath", f"{table}/v{v}").parquet(*paths))
    return out


def upsert_latest(rows: DataFrame, table: str, keys: list[str], order: list[str]) -> None:
    """Adds rows to a table that keeps the last of each key, by ``order``.

    A batch is written as a new run of each bucket that it touches, and no more: a
    bucket's runs of one level become one run of the next when there are
    ``RUNS_A_LEVEL`` of them, so that a row is written once a level, however large the
    table is.  A run counts when it has been noted, with the runs that it took in.  The
    order is total up to equal rows, so replaying a batch changes nothing.
    """
    spark = rows.sparkSession
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    touched = {r[0] for r in new.select("bucket").distinct().collect()}
    if not touched:
        return
    live = _live(spark, table)
    version = max((v for runs in live.values() for v in runs), default=0) + 1
    noted, taken = [], []
    for b in sorted(touched):
        level, merged = 0, []
        while len(same := [v for v, at in live.get(b, {}).items() if at == level]) + 1 >= RUNS_A_LEVEL:
            merged, level = merged + same, level + 1
        noted.append((b, version, level, merged))
        taken += [(b, v) for v in merged]
    for old in _stored(spark, table, taken, rows.schema):
        new = new.unionByName(old)
    # Dealt by bucket first: rows are sorted once, in the task that writes them, and not where they are read as well.
    latest(new.repartition(BUCKETS, "bucket"), ["bucket", *keys], order).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{version}")
    spark.createDataFrame(noted, _RUN).coalesce(1).write.mode("append").parquet(f"{table}/_runs")


def _latest_of(spark: SparkSession, table: str, schema, keys: list[str], order: list[str], buckets: set[int] | None = None) -> DataFrame:
    out = spark.createDataFrame([], schema)
    runs = [(b, v) for b, own in _live(spark, table).items() if buckets is None or b in buckets for v in own]
    for part in _stored(spark, table, runs, out.schema):
        out = out.unionByName(part.drop("bucket"))
    return latest(out.repartition(_parts(spark), *keys), keys, order)


def read_touched(rows: DataFrame, table: str, keys: list[str], order: list[str], schema) -> DataFrame:
    """The last rows of the buckets that the keys of ``rows`` are in; other buckets are not read."""
    touched = {r[0] for r in rows.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).distinct().collect()}
    return _latest_of(rows.sparkSession, table, schema, keys, order, touched)


def read_latest(spark: SparkSession, table: str, schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of a table of latest rows."""
    return _latest_of(spark, table, schema, keys, order)


VOTES = "game string, voter string, rating int, ts timestamp"


def latest_votes(votes: DataFrame, table: str) -> None:
    """foreachBatch step: upserts the latest vote of each (game, voter), by time and rating; ratings are 1 to 10."""
    rows = votes.filter(F.col("rating").between(1, 10)).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in VOTES.split(", ")))
    upsert_latest(rows, table, ["game", "voter"], ["ts", "rating"])


def read_votes(spark: SparkSession, table: str) -> DataFrame:
    return read_latest(spark, table, VOTES, ["game", "voter"], ["ts", "rating"])


def vote_stream(stream: DataFrame, table: str, checkpoint: str):
    """Starts the upsert of a stream of votes(game, voter, rating, ts)."""
    return stream.writeStream.foreachBatch(lambda df, _: latest_votes(df, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_intake(stream: DataFrame, ts: str = "published_at", key: str = "canonical_url", window: str = "96 hours") -> DataFrame:
    """Each key once within the watermark; later copies are dropped."""
    return stream.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def mention_panes(stream: DataFrame, ts: str, game: str, family: str, value: str, slide: str = "1 hour", late: str = "96 hours") -> DataFrame:
    """Mentions and engagement per game and family in panes of one slide, under a watermark: each row is in one pane, and so is the state."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, slide).alias("w"), game, family).agg(F.count(F.lit(1)).alias("mentions"), F.sum(value).alias("engagement"))
    return out.select(F.col("w.start").alias("pane_start"), game, family, "mentions", "engagement")


def windows_of_panes(panes: DataFrame, game: str, family: str, hours: int = 96, slide: int = 1) -> DataFrame:
    """The sliding windows of mention_panes: what was one row a pane is combined for each window that it is in."""
    ahead = F.explode(F.sequence(F.lit(0), F.lit(hours // slide - 1))).alias("_k")
    each = panes.select(game, family, "mentions", "engagement", "pane_start", ahead)
    start = F.col("pane_start") - F.make_dt_interval(hours=F.col("_k") * slide)
    out = each.groupBy(start.alias("window_start"), game, family).agg(F.sum("mentions").alias("mentions"), F.sum("engagement").alias("engagement"))
    return out.select("window_start", (F.col("window_start") + F.make_dt_interval(hours=F.lit(hours))).alias("window_end"), game, family, "mentions", "engagement")


class SourceHealth(StatefulProcessor):
    """Failures in a row of each source; unchanged where a run did not check."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "failures long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        seen = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for status in seen["status"]:
            n = 0 if status == "ok" else n + 1 if status == "error" else n
        self.failures.update((int(n),))
        yield pd.DataFrame({"source": [key[0]], "failures": [int(n)], "persistent": [n >= 3]})

    def close(self) -> None:
        pass


def source_health(stream: DataFrame) -> DataFrame:
    """Failure streaks of a stream of checks(source, ts, seq, status)."""
    return stream.groupBy("source").transformWithStateInPandas(SourceHealth(), "source string, failures long, persistent boolean", "Update", "None")


RUNS = "run long, version string, status string, item_count long, message string"


def import_snapshot(items: DataFrame, ledger: str, key: str, columns: list[str], current: str | None = None, runs: str | None = None, version: str = "", run: int = 0) -> None:
    """foreachBatch step: appends revisions of items whose content changed; the same snapshot again appends none.

    What is compared is the head table beside the ledger, the last revision of each item
    in buckets, of which a batch reads those that its items are in.  A batch that is run
    again after it failed between the two may append its revisions twice, number for number.

    With ``current`` the items themselves are upserted there, and with ``runs`` the
    run is noted as running, then as success with its item count, or as failed.  Of
    several contents of a key in one batch the one with the largest digest counts.
    """
    spark = items.sparkSession

    def note(status: str, count: int | None = None, message: str | None = None) -> None:
        if runs:
            spark.createDataFrame([(run, version, status, count, message)], RUNS).coalesce(1).write.mode("append").parquet(runs)

    note("running")
    try:
        digest = content_hash(columns)
        rows = items.select(key, F.struct(digest.alias("digest"), *(F.col(c) for c in columns)).alias("_i")).repartition(_parts(spark), key)
        chosen = stored(rows.groupBy(key).agg(F.max("_i").alias("_i")).select(key, "_i.*"))
        schema, heads = f"{key} {dict(items.dtypes)[key]}, revision_no int, digest string", f"{ledger}-heads"
        if _exists(spark, ledger) and not _exists(spark, heads):  # a ledger from before there were heads
            upsert_latest(spark.read.schema(schema).parquet(ledger), heads, [key], ["revision_no"])
        old = read_touched(chosen.select(key), heads, [key], ["revision_no"], schema)
        new = stored(append_revisions(old, chosen.select(key, "digest"), key, "digest").select(key, F.col("revision_no").cast("int"), "digest"))
        new.write.mode("append").parquet(ledger)
        upsert_latest(new, heads, [key], ["revision_no"])
        release(new)
        if current:
            upsert_latest(chosen.withColumn("run", F.lit(run).cast("long")), current, [key], ["run", "digest"])
    except Exception as e:
        note("failed", message=str(e)[:500])
        raise
    note("success", chosen.count())
    release(chosen)


def current_items(spark: SparkSession, current: str, items: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The items of an imported ledger as they stand; ``items`` gives their types."""
    kinds = dict(items.dtypes)
    return read_latest(spark, current, f"{key} {kinds[key]}, digest string, {', '.join(f'{c} {kinds[c]}' for c in columns)}, run long", [key], ["run", "digest"])


def snapshot_stream(stream: DataFrame, ledger: str, key: str, columns: list[str], checkpoint: str, current: str | None = None, runs: str | None = None):
    """Starts the import of a stream of snapshot items, a run for each micro-batch."""
    step = lambda df, i: import_snapshot(df, ledger, key, columns, current, runs, f"batch-{i}", i)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

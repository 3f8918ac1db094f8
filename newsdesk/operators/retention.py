"""Snapshots: listings, roll-ups and what to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_groups(listing: DataFrame, version: str, key: str, size: str, modified: str, manifest: str) -> DataFrame:
    """Per version: bytes, objects, whether its manifest is there, and its time (from the name, else the last change)."""
    named = F.try_to_timestamp(F.regexp_extract(F.col(version), r"^(\d{8}T\d{6})Z", 1), F.lit("yyyyMMdd'T'HHmmss"))
    return listing.groupBy(version).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("objects"), F.bool_or(F.col(key).endswith(manifest)).alias("complete"), F.max(modified).alias("_m")).withColumn("ts", F.coalesce(named, "_m")).drop("_m")


def retention_plan(groups: DataFrame, version: str, ts: str, recent: int = 12, daily: int = 7, current: str = "", drop_incomplete: bool = True) -> DataFrame:
    """groups with keep and reason: the current one, the newest complete ones, then the newest of up to ``daily`` other days."""
    is_current = F.col(version).cast("string") == current
    order = [F.col(ts).desc(), F.col(version).desc()]
    done = groups.filter("complete")
    newest = done.orderBy(*order).limit(recent).select(version, F.lit(True).alias("_recent"))
    marked = groups.join(newest, version, "left").withColumn("_recent", F.coalesce("_recent", F.lit(False))).withColumn("day", F.to_date(ts))
    shown = marked.filter(F.col("_recent") | is_current).select("day").distinct()
    first = marked.filter(F.col("complete") & ~F.col("_recent") & ~is_current).join(shown, "day", "left_anti")
    per_day = first.withColumn("_n", F.row_number().over(Window.partitionBy("day").orderBy(*order))).filter("_n = 1")
    days = per_day.orderBy(*order).limit(daily).select(version, F.lit(True).alias("_daily"))
    out = marked.join(days, version, "left")
    reason = F.when(is_current, "current").when(~F.col("complete") & F.lit(drop_incomplete), "incomplete").when(F.col("_recent"), "recent").when(F.col("_daily"), "daily").otherwise("expired")
    return out.withColumn("reason", reason).withColumn("keep", F.col("reason").isin("current", "recent", "daily")).drop("_recent", "_daily", "day")


def unreferenced(objects: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Objects that no reference names."""
    return objects.join(references.select(key).distinct(), key, "left_anti")

"""Validators, gates, work queues and health.  Each rule gives rows (rule, key, detail)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key, detail) of rows that break a rule (a condition that must hold; null breaks it), in one scan."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.explode(found).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))


def duplicate_keys(df: DataFrame, key: str | Column, rule: str = "unique") -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), "key", F.col("n").cast("string").alias("detail"))


def rank_violations(ranking: DataFrame, group: str, rank: str, score: str) -> DataFrame:
    """Ranks that don't count from 1, and scores that rise along them, within each group."""
    w = Window.partitionBy(group).orderBy(rank)
    rows = ranking.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.lag(score).over(w))
    found = F.array_compact(F.array(F.when(F.col("_n") != F.col(rank), F.lit("rank_sequence")), F.when(F.col("_s") < F.col(score), F.lit("score_order"))))
    return rows.select(F.explode(found).alias("rule"), F.concat_ws(":", F.col(group).cast("string"), F.col(rank).cast("string")).alias("key"), F.lit(None).cast("string").alias("detail"))


def all_violations(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def retained_fraction(current: DataFrame, baseline: DataFrame, least: float) -> DataFrame:
    """One row: counts, their ratio, and whether it is at least ``least`` (an empty baseline passes)."""
    c, b = current.agg(F.count(F.lit(1)).alias("current")), baseline.agg(F.count(F.lit(1)).alias("baseline"))
    ratio = F.when(F.col("baseline") > 0, F.col("current") / F.col("baseline"))
    return c.crossJoin(b).withColumn("ratio", ratio).withColumn("ok", F.coalesce(ratio >= least, F.lit(True)))


def health(rows: DataFrame, group: str, ts: str, failed: Column, thresholds: DataFrame, as_of: Column) -> DataFrame:
    """Per group of thresholds(group, minimum, max_age_minutes): volume, age, success ratio and status.

    error: no rows, too old or below the minimum; degraded: within 1.25 of the
    minimum or fewer than 0.8 successes; else healthy.
    """
    seen = rows.groupBy(group).agg(F.count(F.lit(1)).alias("volume"), F.max(ts).alias("newest"), F.count_if(failed).alias("failures"))
    out = thresholds.join(seen, group, "left").withColumn("volume", F.coalesce("volume", F.lit(0)))
    age = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 60)
    out = out.withColumn("age_minutes", age).withColumn("success_ratio", F.when(F.col("volume") > 0, F.round(1 - F.col("failures") / F.col("volume"), 6)))
    status = F.when((F.col("volume") < F.col("minimum")) | F.col("newest").isNull() | (F.col("age_minutes") > F.col("max_age_minutes")), "error").when((F.col("volume") <= 1.25 * F.col("minimum")) | (F.col("success_ratio") < 0.8), "degraded").otherwise("healthy")
    return out.select(group, "volume", "age_minutes", "success_ratio", status.alias("status"))


def publication_gate(df: DataFrame, key: str, required: dict[str, Column]) -> DataFrame:
    """(key, missing, passed): names of requirements that don't hold."""
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in required.items())))
    return df.select(key, F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("passed"))


def reason_audit(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(reason, n): how many rows each reason holds back; a row may count under several."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return df.select(key, F.explode(found).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def work_queue(df: DataFrame, key: str, signals: dict[str, tuple[Column, float]], cap: float, kind: Column, per_kind: int) -> DataFrame:
    """(kind, rank, key, priority, reasons): capped sums of signals (condition, points), the first of each kind."""
    points = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(p)).otherwise(0.0) for c, p in signals.values()), F.lit(0.0))
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, (c, _) in signals.items())))
    rows = df.select(key, kind.alias("kind"), F.least(F.lit(cap), points).alias("priority"), F.array_join(reasons, ",").alias("reasons")).filter("kind IS NOT NULL")
    w = Window.partitionBy("kind").orderBy(F.desc("priority"), key)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_kind)


def completeness(df: DataFrame, by: str, fields: dict[str, Column]) -> DataFrame:
    """Per group the mean share of fields that hold something, and rows below half."""
    filled = sum((F.when(F.coalesce(ok, F.lit(False)), 1).otherwise(0) for ok in fields.values()), F.lit(0)) / len(fields)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(filled), 6).alias("completeness"), F.count_if(filled < 0.5).alias("needs_enrichment"))


def task_states(df: DataFrame, key: str, topics: dict[str, Column], order: list[Column], batch: int) -> tuple[DataFrame, DataFrame]:
    """(tasks, summary): the first ``batch`` rows that each topic still needs, and counts of green and open rows by topic."""
    states = F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), F.coalesce(ok, F.lit(False)).alias("green")) for t, ok in topics.items())))
    long = df.select("*", states.alias("_t")).select(*df.columns, "_t.topic", "_t.green")
    w = Window.partitionBy("topic").orderBy(*order)
    tasks = long.filter(~F.col("green")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= batch).select("topic", "place", key)
    summary = long.groupBy("topic").agg(F.count_if("green").alias("green"), F.count_if(~F.col("green")).alias("needs_revision"))
    return tasks, summary

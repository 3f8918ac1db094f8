"""Releases: events, confirmation, quality, anticipation, calendar status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_events(events: DataFrame, key: str) -> DataFrame:
    """Events(key, date, date_start, date_end, precision, region, platforms, source_ids, confidence, confirmations) with one date and region as one.

    Arrays become unique unions, confirmations (map of platform to source ids) are united by platform.
    """
    by = [key, "date", "date_start", "date_end", "precision", "region"]
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(c)))
    # One shuffle: equal arrays are merged before it, and platforms are united inside the few rows of an event.
    g = events.groupBy(*by).agg(united(F.collect_set("platforms")).alias("platforms"), united(F.collect_set("source_ids")).alias("source_ids"), F.max("confidence").alias("confidence"), F.flatten(F.collect_set(F.map_entries("confirmations"))).alias("_said"))
    g = g.withColumn("_p", F.array_sort(F.array_distinct(F.transform("_said", lambda e: e["key"]))))
    ids = F.transform("_p", lambda p: united(F.transform(F.filter("_said", lambda e: e["key"] == p), lambda e: e["value"])))
    return g.withColumn("confirmations", F.when(F.size("_p") > 0, F.map_from_arrays("_p", ids))).drop("_said", "_p")


def is_public(platforms: Column, confirmations: Column) -> Column:
    """Whether an event has platforms and each of them a confirmation."""
    return (F.size(platforms) > 0) & F.forall(platforms, lambda p: F.coalesce(F.size(F.try_element_at(confirmations, p)) > 0, F.lit(False)))


def join_claims(events: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Events with official claims(key, date, platforms, source_id): equal dates are extended, others become events."""
    made = claims.select(key, "date", F.col("date").alias("date_start"), F.col("date").alias("date_end"), F.lit("exact").alias("precision"), F.lit("worldwide").alias("region"), "platforms", F.array("source_id").alias("source_ids"), F.lit(1.0).alias("confidence"), F.map_from_arrays("platforms", F.transform("platforms", lambda _: F.array("source_id"))).alias("confirmations"))
    return merge_events(events.unionByName(made), key)


def dense_days(releases: DataFrame, date: str, status: str, n: int = 10) -> DataFrame:
    """The n days with most releases, and how many of them are public."""
    g = releases.groupBy(date).agg(F.count(F.lit(1)).alias("releases"), F.count_if(F.col(status) == "public").alias("n_public"))
    return g.orderBy(F.desc("releases"), date).limit(n)


def change_counts(changes: DataFrame, type_: str) -> DataFrame:
    return changes.groupBy(type_).agg(F.count(F.lit(1)).alias("n"))


def anticipation(rows: DataFrame) -> DataFrame:
    """Rows(popularity, steam_position, publications, families) with a score and routes of eligibility."""
    p, s, n, f = F.coalesce("popularity", F.lit(0.0)), F.col("steam_position"), F.coalesce("publications", F.lit(0)), F.coalesce("families", F.lit(0))
    steam = F.when(s.isNotNull(), F.greatest(F.lit(0.0), 30 - 1.25 * (s - 1))).otherwise(0.0)
    score = F.least(F.lit(40.0), p) + steam + F.least(F.lit(36.0), 6.0 * n) + F.least(F.lit(16.0), 5.0 * f)
    routes = F.array_compact(F.array(F.when(p >= 30, F.lit("popular")), F.when(s <= 12, F.lit("steam")), F.when(n >= 4, F.lit("coverage")), F.when((n >= 2) & (f >= 2), F.lit("corroborated")), F.when((s <= 30) & (n >= 1), F.lit("steam_coverage"))))
    return rows.withColumn("anticipation", F.round(score, 6)).withColumn("routes", F.array_join(routes, ",")).withColumn("eligible", F.size(routes) > 0)


def home_quality(rows: DataFrame, signals: dict[str, tuple[Column, float]], blocking: dict[str, Column]) -> DataFrame:
    """rows with the sum of their signals' points, blocking reasons, and whether none blocks."""
    points = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0.0) for c, w in signals.values()), F.lit(0.0))
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in blocking.items())))
    return rows.withColumn("quality", points).withColumn("blocked_by", F.array_join(reasons, ",")).withColumn("shown", F.size(reasons) == 0)


def notability(rows: DataFrame) -> DataFrame:
    """Rows(sources, mentions, sites, momentum, niche) with the class of their notability."""
    s, m = F.col("sources"), F.col("momentum")
    kind = F.when(s >= 4, "broad").when((s >= 3) & (m > 0), "corroborated").when((s >= 2) & (F.col("sites") >= 2) & (m >= 100), "intense").when(F.col("niche") & (s >= 1), "niche_franchise").otherwise("none")
    return rows.withColumn("notability", kind)


def calendar_status(rows: DataFrame) -> DataFrame:
    """Rows(excluded, duplicate_edition, public_event, manual, significance) with their status in the calendar and its reason."""
    reason = F.when(F.col("manual") == "reject", "manual_reject").when(F.col("manual") == "approve", "manual_approve").when(F.col("excluded"), "excluded_type").when(F.col("duplicate_edition"), "duplicate_edition").when(~F.col("public_event"), "unconfirmed").when(F.col("significance") < 20, "insignificant").otherwise("ok")
    return rows.withColumn("reason", reason).withColumn("status", F.when(reason.isin("ok", "manual_approve"), "public").when(reason.isin("unconfirmed", "insignificant"), "review").otherwise("rejected"))


def expectation_ratings(releases: DataFrame, popularity: DataFrame, key: str) -> DataFrame:
    """Ratings of expectation: overall the expected score, else anticipation / 1.22; players 0.7 of 2.5 popularity and 0.3 of 101 - position, or one side alone."""
    full = releases.join(popularity.select(key, "popularity", "position"), key, "left")
    a, b = 2.5 * F.col("popularity"), (101 - F.col("position")).cast("double")
    players = F.coalesce(0.7 * a + 0.3 * b, a, b)
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    return full.select(key, F.round(held(F.coalesce("expected", F.col("anticipation") / 1.22)), 4).alias("overall"), F.round(held(players), 4).alias("players"))


def keep_releases(df: DataFrame, end: str, precision: str, as_of: Column, days: int = 7) -> DataFrame:
    """Releases until ``days`` after their end; without a date always."""
    return df.filter((F.col(precision) == "tbd") | (F.col(end) >= F.date_sub(as_of, days)))


def excluded_kind(title: Column) -> Column:
    """Why a title is no release of its own: demo, prologue, playtest, soundtrack, cosmetic, technical_app, minor_dlc; null if it is."""
    rules = (("demo", r"\bdemo\b"), ("prologue", r"\bprologue\b"), ("playtest", r"\bplay\s?test\b"), ("soundtrack", r"\b(soundtrack|ost)\b"), ("cosmetic", r"\b(skin|cosmetic|costume) pack\b"), ("technical_app", r"\b(sdk|dedicated server|benchmark|editor)\b"), ("minor_dlc", r"\b(bonus content|starter pack|art\s?book|wallpaper)\b"))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(title.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out

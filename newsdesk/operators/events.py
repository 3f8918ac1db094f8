"""News events: clusters scored and rolled up, eligibility, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_hours
from ..sources.scratch import stored
from .similarity import overlap_candidates


def discussion(members: DataFrame, signals: DataFrame, cluster: str, tokens: str, threshold: float = 0.55) -> DataFrame:
    """Per cluster: mentions and momentum of signals(signal, tokens, score, comments) similar to one of its members.

    Members with one token set are compared once, and so are signals, whose scores and
    comments are counted a set; sets meet under the rarest tokens of
    the smaller one (overlap_candidates), so that common tokens join nothing.
    """
    hashed = lambda c: F.array_distinct(F.transform(c, lambda t: F.xxhash64(t)))
    own = members.select(cluster, F.xxhash64(F.array_sort(hashed(tokens))).cast("string").alias("_m"), hashed(tokens).alias("t"))
    said = signals.select(F.xxhash64(F.array_sort(hashed("tokens"))).cast("string").alias("_b"), hashed("tokens").alias("t"), "score", "comments")
    a = own.groupBy(F.col("_m").alias("k")).agg(F.first("t").alias("t")).withColumn("side", F.lit("a"))
    b = said.groupBy(F.col("_b").alias("k")).agg(F.first("t").alias("t")).withColumn("side", F.lit("b"))
    sets = stored(a.unionByName(b).filter(F.size("t") > 0).withColumn("n", F.size("t")))
    met = overlap_candidates(sets, threshold, apart="side")
    of = lambda wanted: F.when(F.col("side_x") == wanted, F.col("x")).otherwise(F.col("y"))
    side = lambda s: sets.filter(F.col("side") == s).select(F.col("k").alias(f"_{s}"), F.col("t").alias(f"t_{s}"))
    full = met.select(of("a").alias("_a"), of("b").alias("_b")).join(side("a"), "_a").join(side("b"), "_b")
    similar = full.withColumn("s", F.size(F.array_intersect("t_a", "t_b")) / F.least(F.size("t_a"), F.size("t_b"))).filter(F.col("s") >= threshold)
    near = similar.join(own.select(cluster, F.col("_m").alias("_a")).distinct(), "_a").select(cluster, "_b").distinct()
    full = near.join(said.groupBy("_b", "score", "comments").agg(F.count(F.lit(1)).alias("_n")), "_b")
    value = F.floor(F.sum(8 * F.log10(F.col("score") + 1) * F.col("_n")) + F.sum(10 * F.log10(F.col("comments") + 1) * F.col("_n")) + 0.5)
    return full.groupBy(cluster).agg(F.sum("_n").alias("mentions"), value.alias("momentum"))


def cluster_scores(members: DataFrame, cluster: str, source: str, weight: str, ts: str, as_of: Column, momentum: DataFrame | None = None) -> DataFrame:
    """Per cluster: 120 for each source beyond the first, 18 times the weights, momentum, and twice what its age leaves of 36 hours; rounded."""
    g = members.groupBy(cluster).agg(F.count_distinct(source).alias("sources"), F.sum(weight).alias("_w"), F.max(ts).alias("newest"), F.count(F.lit(1)).alias("items"))
    g = g.join(momentum, cluster, "left") if momentum is not None else g.withColumn("momentum", F.lit(0))
    fresh = 2 * F.greatest(F.lit(0.0), 36 - F.greatest(F.lit(0.0), age_hours(F.col("newest"), as_of)))
    score = F.floor((F.col("sources") - 1) * 120 + F.col("_w") * 18 + F.coalesce("momentum", F.lit(0)) + fresh + 0.5)
    return g.withColumn("trend", score.cast("long")).drop("_w")


def roll_up(items: DataFrame, cluster: str) -> DataFrame:
    """Events from items(cluster, url, source, official, trend, global_score, regional, mentions, regions, ts, title)."""
    media = ~F.col("official")
    return items.groupBy(cluster).agg(
        F.max("trend").alias("trend"), F.max("global_score").alias("global_score"), F.max("regional").alias("regional"), F.max("mentions").alias("mentions"),
        F.size(F.collect_set(F.when(media, F.col("source")))).cast("long").alias("media_sources"), F.bool_or("official").alias("official"), F.max("ts").alias("published"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("regions")))).alias("regions"),
        F.max_by("title", F.struct(F.when(media, 1).otherwise(0), "global_score", "trend", "ts", "url")).alias("title"),
        F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list("url")), "|")), 1, 16).alias("event_id"),
    )


def eligibility(events: DataFrame) -> DataFrame:
    """Events with global and regional eligibility, importance, editorial score, type, and hours on the front page."""
    m, d, t, g, r = (F.col(c) for c in ("media_sources", "mentions", "trend", "global_score", "regional"))
    wide = (m >= 2) | (d >= 3) | (t >= 450) | (g >= 450)
    confirmed = F.col("official") & ((m >= 1) | (d >= 2) | (t >= 300) | (g >= 300))
    out = events.withColumn("global_eligible", wide | confirmed).withColumn("regional_eligible", (F.size("regions") > 0) & (r > 0))
    critical = (t >= 700) | (m >= 6) | (d >= 7) | (g >= 700)
    out = out.withColumn("public", F.col("global_eligible") | F.col("regional_eligible"))
    out = out.withColumn("importance", F.when(critical, "critical").when(F.col("global_eligible") | (r >= 250), "major").otherwise("normal"))
    out = out.withColumn("editorial_score", g + t + m * 120 + d * 80 + r + F.when(F.col("official"), 80).otherwise(0))
    out = out.withColumn("type", F.when(F.col("official") & (m > 0), "confirmed").when(F.col("official"), "official").otherwise("ranked"))
    return out.withColumn("home_hours", F.when(F.col("public"), F.when(critical, 168).when(F.col("global_eligible"), 72).otherwise(48)))


def industry_eligibility(topics: DataFrame) -> DataFrame:
    """Topics(sources, mentions, trend) with eligibility and global, regional and super scores' classes."""
    s, d, t = F.col("sources"), F.col("mentions"), F.col("trend")
    ok = (s >= 3) | (d >= 3) | (t >= 450)
    out = topics.withColumn("global_eligible", ok).withColumn("global_score", F.when(ok, t + 90 * s + 35 * d).otherwise(0.0))
    out = out.withColumn("regional_score", 170 + 0.45 * t + 35 * s)
    return out.withColumn("super", (s >= 6) | (d >= 7) | (t >= 700))


def visibility(events: DataFrame, region: str) -> DataFrame:
    """Events with global_visible (a declared flag, else thresholds for official and other ones) and region_visible."""
    m, d, t, g = (F.col(c) for c in ("media_sources", "mentions", "trend", "global_score"))
    said = F.when(F.col("official"), (m >= 1) | (d >= 2) | (t >= 300) | (g >= 300)).otherwise((m >= 2) | (d >= 3) | (t >= 450) | (g >= 450))
    return events.withColumn("global_visible", F.coalesce(F.col("declared"), said)).withColumn("region_visible", F.col("regional_eligible") & F.array_contains("regions", region))


def regional_impact(df: DataFrame, text: Column, regions: Column, ts: str, as_of: Column, impact: str, days: int = 7) -> DataFrame:
    """Rows with a region, an impact word, and at most ``days`` of age."""
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))).filter((F.size(regions) > 0) & text.rlike(f"(?iu){impact}"))

"""Popularity: decayed evidence by family, scores, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_hours, recency
from .topk import top

#: Weights of the five families and of breadth.
FAMILY_WEIGHTS = (0.30, 0.15, 0.15, 0.20, 0.15)
BREADTH_WEIGHT = 0.05
#: Rows of a ranking and of its evidence.
RANKED, EVIDENCE = 60, 24


def popularity_signals(evidence: DataFrame, game: str, family: str, ts: str, value: str, publisher: str, as_of: Column, families: list[str], peaks: tuple[str, ...] = (), window_h: float = 96, half_life_h: float = 24) -> DataFrame:
    """Per game a column for each family (decayed evidence, summed; of families in ``peaks`` the maximum), publishers and families.

    One aggregate with conditional sums: partial sums are made before the shuffle.
    """
    fresh = evidence.filter(age_hours(F.col(ts), as_of) <= window_h).withColumn("_v", F.col(value) * recency(F.col(ts), as_of, window_h, half_life_h))
    columns = [F.coalesce((F.max if f in peaks else F.sum)(F.when(F.col(family) == f, F.col("_v"))), F.lit(0.0)).alias(f) for f in families]
    return fresh.groupBy(game).agg(*columns, F.count_distinct(publisher).alias("publishers"), F.count_distinct(F.when(F.col(family).isin(*families) & (F.col("_v") > 0), F.col(family))).alias("n_families"))


def popularity_score(signals: DataFrame, game: str, families: list[str], n: int = RANKED, weights: tuple[float, ...] = FAMILY_WEIGHTS) -> DataFrame:
    """The n best games: families over their maxima, weighted, with a part for breadth; 0 to 100, and a confidence up to 1.

    The maxima are one row, sent to every task.
    """
    maxima = signals.agg(*(F.greatest(F.max(f), F.lit(1.0)).alias(f"_max_{f}") for f in families))
    parts = sum((w * F.col(f) / F.col(f"_max_{f}") for f, w in zip(families, weights, strict=True)), F.lit(0.0))
    score = 100 * (parts + BREADTH_WEIGHT * F.col("n_families") / len(families))
    confidence = F.least(F.lit(1.0), 0.35 + 0.09 * F.col("n_families") + 0.04 * F.least("publishers", F.lit(6)))
    scored = signals.crossJoin(F.broadcast(maxima)).select(game, *families, "publishers", "n_families", F.round(score, 6).alias("score"), F.round(confidence, 6).alias("confidence"))
    return top(scored, [F.desc("score"), F.col(game)], n)


def tiers(signals: DataFrame, game: str, media: str, community: str, platform: str, publishers: str) -> DataFrame:
    """signals with a tier and its reasons: confirmed, community_dominant, platform_corroborated, platform_chart or none."""
    m, c, p, n = F.col(media), F.col(community), F.col(platform), F.col(publishers)
    reasons = F.array_compact(F.array(F.when(n >= 3, F.lit("publishers")), F.when(m > 0, F.lit("media")), F.when(c > 0, F.lit("community")), F.when(p > 0, F.lit("platform"))))
    tier = F.when((n >= 3) & (m > 0) & ((c > 0) | (p > 0)), "confirmed").when((c > m) & (c > p) & (c > 0), "community_dominant").when((p > 0) & ((m > 0) | (c > 0)), "platform_corroborated").when(p > 0, "platform_chart").otherwise("none")
    return signals.withColumn("tier", tier).withColumn("reasons", F.array_join(reasons, ","))


def fresh_evidence(evidence: Column, as_of: Column, window_h: int, live_families: list[str]) -> Column:
    """Of an array of struct(family, independent, observed_at) the independent ones seen within the window, undated only of live families."""
    from_ = as_of - F.make_dt_interval(F.lit(0), F.lit(window_h))
    to = as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(5))
    return F.filter(evidence, lambda e: e["independent"] & F.when(e["observed_at"].isNull(), e["family"].isin(*live_families)).otherwise(e["observed_at"].between(from_, to)))


def mention_windows(events: DataFrame, ts: str, game: str, family: str, value: str, window: str = "96 hours", slide: str = "24 hours") -> DataFrame:
    """Mentions and engagement per game and family in sliding windows (batch twin of the stream).

    Rows are summed by slide first, so that a row is copied into its windows only
    after it has been combined.
    """
    base = events.groupBy(F.window(ts, slide).alias("_s"), game, family).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    w = F.window(F.col("_s.start"), window, slide)
    out = base.groupBy(w.alias("_w"), game, family).agg(F.sum("n").alias("mentions"), F.sum("v").alias("engagement"))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), game, family, "mentions", "engagement")


def community_rollup(videos: DataFrame, game: str, video: str, channel: str, views: str, comments: str) -> DataFrame:
    """Per game distinct videos and channels, views, comments, and min(35, 6 + 3 log10(v + 1) + 1.5 ln(1 + n) + 1.5 ln(1 + c))."""
    g = videos.groupBy(game).agg(F.count_distinct(video).alias("videos"), F.count_distinct(channel).alias("channels"), F.sum(views).alias("views"), F.sum(comments).alias("comments"))
    score = F.least(F.lit(35.0), 6 + 3 * F.log10(F.col("views") + 1) + 1.5 * F.log1p("videos") + 1.5 * F.log1p("comments"))
    return g.withColumn("score", F.round(score, 6))


def without_blocked(df: DataFrame, title: str, slug: str, slugs: list[str]) -> DataFrame:
    """df without hardware, tools, soundtracks, servers, benchmarks and the given slugs."""
    return df.filter(~F.col(title).rlike(r"(?i)\b(hardware|sdk|soundtrack|dedicated server|benchmark|driver)\b") & ~F.col(slug).isin(*slugs))

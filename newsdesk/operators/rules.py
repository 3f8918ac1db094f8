"""Editorial rules with their thresholds: tiers, home quality, notability, gates, significance.

Each operator adds columns to its rows and leaves the others as they are.  A policy
is a mapping; what it leaves out keeps its default.  Null numbers count as 0, null
flags as false, null arrays as empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the popular list.
POPULAR = {
    "window_h": 96, "skew_min": 5, "families": ("news", "youtube", "reddit", "twitch"), "live": ("youtube", "reddit", "twitch"),
    "publishers": 3, "breadth": 2, "confirmed_confidence": 0.0, "confirmed_score": 0.0,
    "videos": 5, "channels": 3, "views": 250_000, "community_confidence": 0.0, "community_score": 0.0,
    "steam_one": 20, "steam_two": 50, "twitch_one": 25, "twitch_two": 60, "platform_confidence": 0.0, "platform_score": 0.0, "charts_allowed": True,
}
#: Families of stores, which are no independent coverage; thresholds of the home page.
STORES = ("official_store", "store", "steam", "steam_chart", "rawg")
HOME = {"quality": 7, "steam_position": 50, "coverage": 2}
#: Thresholds of global notability.
NOTABILITY = {
    "broad": 4, "corroborated": 3, "intense": 2, "popular_score": 10.0, "popular_confidence": 0.5, "popular_families": 2,
    "intense_score": 15.0, "intense_confidence": 0.6, "intense_families": 3, "global_score": 450.0, "trend_score": 450.0, "mentions": 3,
    "historical": 4, "niche_press": 1, "niche_families": 2,
}
#: Fixed value: commercial editions in a title.
EDITION = r"(?i)\b(deluxe|ultimate|gold|complete|collector'?s?|goty|game of the year|premium)\b"


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _named(**flags: Column) -> Column:
    """Names of the flags that hold, in their order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))


def popular_tiers(rows: DataFrame, as_of: Column, policy: Mapping | None = None) -> DataFrame:
    """rows(score, confidence, news_publishers, has_image, evidence) with the tier of the popular list and its reasons.

    evidence: array of struct(family, observed_at, position, url, channel, views).
    Fresh is what an independent family has shown within the window (five minutes of
    skew allowed), undated only for live families.  Tiers, the first that holds:
    *confirmed* by publishers or breadth, *community_dominant* by videos, channels
    and views, *platform_corroborated* by a chart position with fresh families beside
    the chart's own, *platform_chart*.  ``publishable`` needs an image as well.
    """
    p = {**POPULAR, **(policy or {})}
    seen = lambda e: F.when(e["observed_at"].isNull(), e["family"].isin(*p["live"])).otherwise((e["observed_at"] <= as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(p["skew_min"]))) & (e["observed_at"] >= as_of - F.make_dt_interval(F.lit(0), F.lit(p["window_h"]))))
    fresh = F.filter("evidence", lambda e: e["family"].isin(*p["families"]) & seen(e))
    out = rows.withColumn("_fresh", F.coalesce(fresh, F.array().cast(rows.schema["evidence"].dataType)))
    out = out.withColumn("fresh_families", F.array_sort(F.array_distinct(F.transform("_fresh", lambda e: e["family"]))))
    place = lambda family: F.array_min(F.transform(F.filter("evidence", lambda e: e["family"] == family), lambda e: e["position"]))
    videos = F.filter("_fresh", lambda e: e["family"] == "youtube")
    distinct = lambda field: F.size(F.array_compact(F.array_distinct(F.transform(videos, lambda e: e[field]))))
    out = out.withColumns({"steam_position": place("steam_chart"), "twitch_position": place("twitch"), "videos": distinct("url"), "channels": distinct("channel"), "views": F.aggregate(videos, F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["views"], F.lit(0)))})
    trusted = lambda name: (_n("confidence") >= p[f"{name}_confidence"]) & (_n("score") >= p[f"{name}_score"])
    others = F.size("fresh_families") - F.when(F.array_contains("fresh_families", "twitch"), 1).otherwise(0)
    corroborated = lambda position, families, name: F.coalesce(((F.col(position) <= p[f"{name}_one"]) & (families >= 1)) | ((F.col(position) <= p[f"{name}_two"]) & (families >= 2)), F.lit(False))
    by_news, by_breadth = _n("news_publishers") >= p["publishers"], F.size("fresh_families") >= p["breadth"]
    community = (F.col("videos") >= p["videos"]) & (F.col("channels") >= p["channels"]) & (F.col("views") >= p["views"]) & trusted("community")
    platform = (corroborated("steam_position", F.size("fresh_families"), "steam") | corroborated("twitch_position", others, "twitch")) & trusted("platform")
    charted = F.col("steam_position").isNotNull() | F.col("twitch_position").isNotNull()
    tier = F.when((by_news | by_breadth) & trusted("confirmed"), "confirmed").when(community, "community_dominant").when(platform, "platform_corroborated").when(charted & F.lit(p["charts_allowed"]), "platform_chart")
    none = tier.isNull()
    reasons = _named(
        missing_cover_candidate=~_yes("has_image"), **{f"news_publishers_below_{p['publishers']}": none & ~by_news}, insufficient_independent_families=none & ~by_breadth,
        community_signal_below_threshold=none & ~community, not_in_current_platform_chart=none & ~charted,
        low_confidence=none & (_n("confidence") < p["platform_confidence"]), low_score=none & (_n("score") < p["platform_score"]), relevant_but_not_renderable=~none & ~_yes("has_image"),
    )
    return out.withColumn("tier", tier).withColumn("publishable", ~none & _yes("has_image")).withColumn("reasons", reasons).drop("_fresh")


def home_release_quality(rows: DataFrame, as_of: Column, policy: Mapping | None = None) -> DataFrame:
    """rows with quality_score, upcoming, signals, reasons and homepage_eligible (no reason against).

    Reads release_type, has_event, precision, release_date, needs_review, cover_verified, manual_feature, published_page,
    in_popular, steam_position, publications, source_families, evidence_families (arrays of families of sources without
    error, and of earlier evidence), popular_index and popular_confidence.
    """
    p = {**HOME, **(policy or {})}
    independent = F.filter(_list("source_families"), lambda f: ~F.lower(F.trim(f)).isin(*STORES))
    coverage = F.greatest(_n("publications"), F.size(independent))
    families = F.array_distinct(F.filter(F.concat(_list("evidence_families"), independent), lambda f: (f != "") & ~F.lower(F.trim(f)).isin(*STORES)))
    popular = _yes("in_popular") | ((_n("popular_index") >= 8) & (_n("popular_confidence") >= 0.4))
    steam = _n("steam_position")
    wish = (steam > 0) & (steam <= p["steam_position"])
    least = max(2, p["coverage"])
    cross = (coverage >= max(3, least)) | ((coverage >= least) & (F.size(families) >= 2))
    manual = _yes("manual_feature")
    anticipated = manual | (coverage >= 5) | (wish & (coverage >= 3)) | ((coverage >= 2) & popular) | (cross & popular)
    upcoming = F.coalesce(F.col("release_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(12)) >= as_of - F.make_dt_interval(F.lit(0), F.lit(12)), F.lit(True))
    points = lambda condition, value: F.when(condition, value).otherwise(0)
    score = (
        points(popular, 10) + points(wish, F.greatest(F.lit(3), 9 - F.floor((steam - 1) / 8))) + points(coverage >= 2, F.least(F.lit(18), coverage * 3))
        + points(F.size(families) >= 2, F.least(F.lit(6), F.size(families) * 2)) + points(manual, 12) + points(~upcoming & _yes("published_page"), 2) + points(F.coalesce(F.col("precision") == "exact", F.lit(False)), 1)
    )
    signals = _named(current_popular=popular, steam_popular_upcoming=wish, gaming_press=coverage >= 3, cross_site_coverage=cross, manual_feature=manual)
    out = rows.withColumns({"quality_score": score.cast("int"), "upcoming": upcoming, "signals": signals, "_anticipated": anticipated})
    reasons = _named(
        non_full_release=F.coalesce((F.col("release_type") != "") & (F.col("release_type") != "full"), F.lit(False)), missing_event=~_yes("has_event"), needs_review=_yes("needs_review"), unverified_cover=~_yes("cover_verified"),
        no_global_anticipation_signal=~F.col("_anticipated"), upcoming_without_measured_global_interest=F.col("upcoming") & ~F.col("_anticipated"), **{f"anticipation_below_{p['quality']}": F.col("quality_score") < p["quality"]},
    )
    return out.withColumn("reasons", reasons).withColumn("homepage_eligible", F.size("reasons") == 0).drop("_anticipated")


def global_notability(rows: DataFrame, policy: Mapping | None = None) -> DataFrame:
    """rows with notability (broad-global, niche-global or none), its reasons, and whether one holds.

    Reads publications (the most of the release's own, its news' and its popular entry's), historical_publications,
    global_score, trend_score, mentions, global_event, popular_score, popular_confidence, popular_families (a number) and
    cross_site.
    """
    p = {**NOTABILITY, **(policy or {})}
    press, families = _n("publications"), _n("popular_families")
    level = lambda name: (_n("popular_score") >= p[f"{name}_score"]) & (_n("popular_confidence") >= p[f"{name}_confidence"]) & (families >= p[f"{name}_families"])
    strong, intense = level("popular"), level("intense")
    momentum = _yes("global_event") & ((_n("global_score") >= p["global_score"]) | (_n("trend_score") >= p["trend_score"]) | (_n("mentions") >= p["mentions"]))
    current = press >= p["niche_press"]
    niche = (_n("historical_publications") >= p["historical"]) & (current | strong) & ((families >= p["niche_families"]) | _yes("cross_site") | current)
    broad = _named(**{
        "broad-independent-gaming-coverage": press >= p["broad"], "independent-coverage-plus-global-momentum": (press >= p["corroborated"]) & (strong | momentum),
        "strong-cross-site-attention-plus-independent-coverage": (press >= p["intense"]) & intense,
    })
    out = rows.withColumn("_broad", broad).withColumn("_niche", niche)
    kind = F.when(F.size("_broad") > 0, "broad-global").when(F.col("_niche"), "niche-global").otherwise("none")
    return out.withColumn("notability", kind).withColumn("notability_reasons", F.concat("_broad", _named(**{"established-franchise-niche-attention": F.col("_niche")}))).drop("_broad", "_niche")


def notability_gate(rows: DataFrame) -> DataFrame:
    """rows(status, rejected, manual_decision, confirmed_event, automatic_reasons, notability) with the status that their notability leaves.

    Rejected ones stay; without notability or a confirmed event a release goes to
    review, with a reason; a daily cap stays; a manual review keeps its status, all
    others are published.
    """
    needed, event = "global_or_niche_notability_required", "no_confirmed_platform_event"
    fixed = _yes("rejected") | F.coalesce(F.col("status") == "rejected", F.lit(False))
    none = F.col("notability") == "none"
    had = _list("automatic_reasons")
    cleared = F.filter(had, lambda r: ~r.isin(needed, "global_notability_required"))
    # A reason that is there already keeps its place.
    reasons = F.when(fixed, had).when(none, F.array_distinct(F.concat(had, F.array(F.lit(needed))))).when(~_yes("confirmed_event"), F.array_distinct(F.concat(cleared, F.array(F.lit(event))))).otherwise(cleared)
    keep = fixed | F.array_contains(cleared, "daily_cap") | (F.coalesce(F.col("manual_decision"), F.lit("")) == "review")
    status = F.when(fixed, F.col("status")).when(none | ~_yes("confirmed_event"), "review").when(keep, F.col("status")).otherwise("published")
    return rows.withColumns({"gated_status": status, "gated_reasons": reasons})


def significance(rows: DataFrame, weights: Mapping[str, float], known: tuple[str, ...] = ()) -> DataFrame:
    """rows with their signals (distinct, sorted) and the sum of the signals' weights.

    Reads quality_signals (array), homepage_eligible, has_page, published, independent_sources, source_families (array) and
    organizations (text of developer and publisher; ``known`` names count inside it).
    """
    org = F.lower(F.coalesce(F.col("organizations"), F.lit("")))
    named = F.lit(False)
    for name in known:
        named = named | org.contains(name.lower())
    own = _named(
        home_quality_gate=_yes("homepage_eligible"), own_page=_yes("has_page"), published_page=_yes("published"), independent_coverage=_n("independent_sources") > 0,
        official_announcement=F.array_contains(F.transform(_list("source_families"), F.lower), "official_announcement"), known_developer_or_publisher=named,
    )
    signals = F.array_sort(F.array_distinct(F.concat(_list("quality_signals"), own)))
    weight = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))) if weights else None
    score = F.aggregate("signals", F.lit(0.0), lambda a, s: a + F.coalesce(F.try_element_at(weight, s), F.lit(0.0))) if weight is not None else F.lit(0.0)
    return rows.withColumn("signals", signals).withColumn("significance", score)


def candidate_status(rows: DataFrame, least: float) -> DataFrame:
    """rows(signals, significance, excluded, edition_of_known, public_event) with status, rejection and automatic reasons of a calendar candidate."""
    rejection = F.coalesce(F.col("excluded"), F.when(_yes("edition_of_known"), "duplicate_edition"))
    enough = F.col("significance") >= least
    reasons = _named(no_significance_signal=F.size("signals") == 0, below_significance_threshold=~enough, no_confirmed_platform_event=enough & rejection.isNull() & ~_yes("public_event"))
    status = F.when(rejection.isNotNull(), "rejected").when(enough & _yes("public_event"), "published").otherwise("review")
    return rows.withColumns({"rejection": rejection, "automatic_reasons": reasons, "status": status})


def registry_requirements(allow_no_release: bool = False) -> dict[str, Column]:
    """What an entity must have to be published, by the name of the error; reads title, slug, workflow, embedded, standalone, conflicts (a number), has_release, description, has_cover."""
    workflow = F.coalesce(F.col("workflow"), F.lit(""))
    out = {
        "identity.canonicalTitle": F.coalesce(F.col("title") != "", F.lit(False)), "identity.slug": F.coalesce(F.col("slug") != "", F.lit(False)),
        "workflow.needs_review": workflow != "needs_review", "workflow.merged": workflow != "merged_into_another_game",
        "embedded_content_requires_base_game": ~_yes("embedded") | _yes("standalone"), "unresolved_conflicts": _n("conflicts") == 0,
        "release_confirmation": _yes("has_release"), "description": F.coalesce(F.col("description") != "", F.lit(False)), "cover_or_hero": _yes("has_cover"),
    }
    if allow_no_release:
        del out["release_confirmation"]
    return out


#: What a dossier holds at least.
DOSSIER_FIELDS = ("title", "release date", "developer", "publisher", "genres", "platforms", "short description", "integrated description", "cover", "hero")
DOSSIER = {"sources": 10, "screenshots": 6, "features": 4, "official": 1, "editorial": 3}


def dossier_requirements(fields: Mapping[str, Column]) -> dict[str, Column]:
    """What a dossier must have, by the name of the error: each of DOSSIER_FIELDS (true where it is filled) and enough sources,
    screenshots, features, official_sources and editorial_sources (numbers)."""
    out = {f"missing {name}": F.coalesce(fields[name], F.lit(False)) for name in DOSSIER_FIELDS}
    out[f"fewer than {DOSSIER['sources']} sources"] = _n("sources") >= DOSSIER["sources"]
    out[f"fewer than {DOSSIER['screenshots']} screenshots"] = _n("screenshots") >= DOSSIER["screenshots"]
    out[f"fewer than {DOSSIER['features']} features"] = _n("features") >= DOSSIER["features"]
    out["no official or store evidence"] = _n("official_sources") >= DOSSIER["official"]
    out[f"fewer than {DOSSIER['editorial']} editorial sources"] = _n("editorial_sources") >= DOSSIER["editorial"]
    return out


def kept_anticipation(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """current(key, fresh, publishers, franchise_publishers, families, popular_index, popular_confidence, steam_position) joined with what was measured before.

    Fresh research replaces publishers and families; otherwise they add to the
    earlier ones, and counts never fall below those measured before.  Popularity and
    chart positions of before stay where there are none now.
    """
    old = previous.select(key, *(F.col(c).alias(f"_{c}") for c in ("publishers", "franchise_publishers", "families", "publication_count", "franchise_count", "popular_index", "popular_confidence", "steam_position")))
    rows = current.join(old, key, "left")
    none = F.array().cast("array<string>")
    both = lambda c: F.array_sort(F.array_distinct(F.concat(_list(c), F.when(_yes("fresh"), none).otherwise(_list(f"_{c}")))))
    counted = lambda names, before: F.when(_yes("fresh"), F.size(names)).otherwise(F.greatest(F.size(names), _n(before)))
    rows = rows.withColumns({c: both(c) for c in ("publishers", "franchise_publishers", "families")})
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.nullif(F.col(f"_{c}"), F.lit(0))) for c in ("popular_index", "popular_confidence", "steam_position")})
    rows = rows.withColumns({"publication_count": counted("publishers", "_publication_count"), "franchise_count": counted("franchise_publishers", "_franchise_count")})
    outside = F.size(F.filter("families", lambda f: ~F.lower(f).isin(*STORES)))
    steam = F.when(F.col("steam_position").isNotNull(), F.greatest(F.lit(0.0), 30 - F.least(F.lit(29), F.col("steam_position") - 1) * 1.25)).otherwise(0.0)
    score = F.least(F.lit(40.0), _n("popular_index").cast("double")) + steam + F.least(F.lit(36), 6 * F.col("publication_count")) + F.least(F.lit(16), 5 * outside)
    rows = rows.withColumn("anticipation", F.floor(score * 10 + 0.5) / 10)
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def kept_community(rollup: DataFrame, existing: DataFrame, game: str) -> DataFrame:
    """(game, score, confidence): the larger of an existing score and that of the community (videos, channels, views), confidences alike."""
    v, c = F.col("videos"), F.col("channels")
    score = F.least(F.lit(35.0), 6 + 3 * F.log10(F.col("views") + 1) + 1.5 * F.log1p(v) + 1.5 * F.log1p(c))
    confidence = F.least(F.lit(0.92), 0.38 + 0.04 * v + 0.05 * c)
    rows = rollup.join(existing.select(game, F.col("score").alias("_s"), F.col("confidence").alias("_c")), game, "left")
    return rows.select(game, F.round(F.greatest(score, F.coalesce("_s", F.lit(0.0))), 1).alias("score"), F.round(F.greatest(confidence, F.coalesce("_c", F.lit(0.0))), 2).alias("confidence"))

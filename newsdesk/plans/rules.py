"""Queries of the editorial rules: their inputs are told from orders, lines and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import rules as R
from .registry import query, table

_FAMILIES = ("news", "youtube", "reddit", "twitch", "steam_chart")
#: Ship days span seven years: a window of 400 days about the middle.
_WINDOW_H = 9600


def _at(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


@query(
    f"""WITH e AS (SELECT l_orderkey AS k, list_extract(['news', 'youtube', 'reddit', 'twitch', 'steam_chart'], CAST(l_partkey % 5 + 1 AS INTEGER)) AS family, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS t, CAST(l_suppkey % 90 + 1 AS INTEGER) AS pos, 'u' || l_partkey AS url, 'c' || l_suppkey AS channel, CAST(floor(l_extendedprice) AS BIGINT) AS views FROM lineitem),
f AS (SELECT *, family <> 'steam_chart' AND CASE WHEN t IS NULL THEN family <> 'news' ELSE t <= TIMESTAMP '1998-06-01' + INTERVAL 5 MINUTE AND t >= TIMESTAMP '1998-06-01' - INTERVAL {_WINDOW_H} HOUR END AS fresh FROM e),
g AS (SELECT k, list_sort(list_distinct(coalesce(list(family) FILTER (fresh), []))) AS families, min(pos) FILTER (family = 'steam_chart') AS steam_position, min(pos) FILTER (family = 'twitch') AS twitch_position,
  count(DISTINCT url) FILTER (fresh AND family = 'youtube') AS videos, count(DISTINCT channel) FILTER (fresh AND family = 'youtube') AS channels, coalesce(sum(views) FILTER (fresh AND family = 'youtube'), 0) AS views FROM f GROUP BY k),
o AS (SELECT g.*, len(families) AS n, len(families) - CAST(list_contains(families, 'twitch') AS INTEGER) AS others, o_totalprice / 4000 AS score, (o_orderkey % 10) / 10 AS confidence, CAST(o_custkey % 5 AS INTEGER) AS publishers, o_orderkey % 7 <> 0 AS has_image FROM g JOIN orders ON k = o_orderkey),
x AS (SELECT *, publishers >= 4 AS by_news, n >= 3 AS by_breadth, videos >= 2 AND channels >= 2 AND views >= 40000 AND confidence >= 0.2 AS community,
  (coalesce((steam_position <= 20 AND n >= 1) OR (steam_position <= 50 AND n >= 2), false) OR coalesce((twitch_position <= 25 AND others >= 1) OR (twitch_position <= 60 AND others >= 2), false)) AND confidence >= 0.1 AND score >= 5 AS platform,
  steam_position IS NOT NULL OR twitch_position IS NOT NULL AS charted FROM o),
t AS (SELECT *, CASE WHEN (by_news OR by_breadth) AND confidence >= 0.3 AND score >= 10 THEN 'confirmed' WHEN community THEN 'community_dominant' WHEN platform THEN 'platform_corroborated' WHEN charted THEN 'platform_chart' END AS tier FROM x)
SELECT k AS o_orderkey, array_to_string(families, ',') AS fresh_families, steam_position, twitch_position, CAST(videos AS INTEGER) AS videos, CAST(channels AS INTEGER) AS channels, CAST(views AS BIGINT) AS views, tier, tier IS NOT NULL AND has_image AS publishable,
  array_to_string(list_filter([CASE WHEN NOT has_image THEN 'missing_cover_candidate' END, CASE WHEN tier IS NULL AND NOT by_news THEN 'news_publishers_below_4' END, CASE WHEN tier IS NULL AND NOT by_breadth THEN 'insufficient_independent_families' END,
    CASE WHEN tier IS NULL AND NOT community THEN 'community_signal_below_threshold' END, CASE WHEN tier IS NULL AND NOT charted THEN 'not_in_current_platform_chart' END, CASE WHEN tier IS NULL AND confidence < 0.1 THEN 'low_confidence' END,
    CASE WHEN tier IS NULL AND score < 5 THEN 'low_score' END, CASE WHEN tier IS NOT NULL AND NOT has_image THEN 'relevant_but_not_renderable' END], lambda r: r IS NOT NULL), ',') AS reasons FROM t"""
)
def popular_list_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of orders as games, their lines as evidence; stricter thresholds than the default ones, so that all tiers occur."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("o_orderkey")
    evidence = F.struct(
        _at(_FAMILIES, F.col("l_partkey") % 5).alias("family"), F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("timestamp")).alias("observed_at"), (F.col("l_suppkey") % 90 + 1).cast("int").alias("position"),
        F.concat(F.lit("u"), "l_partkey").alias("url"), F.concat(F.lit("c"), "l_suppkey").alias("channel"), F.floor("l_extendedprice").alias("views"),
    )
    games = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(evidence).alias("evidence")).join(table(spark, sf_dir, "orders"), "o_orderkey")
    rows = games.select(k, "evidence", (F.col("o_totalprice") / 4000).alias("score"), (k % 10 / 10).alias("confidence"), (F.col("o_custkey") % 5).cast("int").alias("news_publishers"), (k % 7 != 0).alias("has_image"))
    policy = {"window_h": _WINDOW_H, "publishers": 4, "breadth": 3, "confirmed_confidence": 0.3, "confirmed_score": 10, "videos": 2, "channels": 2, "views": 40_000, "community_confidence": 0.2, "platform_confidence": 0.1, "platform_score": 5}
    out = R.popular_tiers(rows, F.lit("1998-06-01").cast("timestamp"), policy)
    return out.select(k, F.array_join("fresh_families", ",").alias("fresh_families"), "steam_position", "twitch_position", "videos", "channels", "views", "tier", "publishable", F.array_join("reasons", ",").alias("reasons"))


@query(
    """WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'demo' WHEN 1 THEN NULL ELSE 'full' END AS release_type, o_orderkey % 19 <> 0 AS has_event, CASE WHEN o_orderkey % 2 = 0 THEN 'exact' ELSE 'month' END AS precision,
  CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS d, o_orderkey % 11 = 0 AS needs_review, o_orderkey % 5 <> 0 AS cover, o_orderkey % 23 = 0 AS manual, o_orderstatus = 'F' AS page, o_custkey % 9 = 0 AS in_popular, CAST(o_custkey % 70 AS INTEGER) AS steam, CAST(o_custkey % 6 AS INTEGER) AS pubs,
  list_filter(['news', 'Steam', CASE WHEN o_orderkey % 3 = 0 THEN 'youtube' END, CASE WHEN o_custkey % 2 = 0 THEN 'store' END, CASE WHEN o_orderkey % 7 = 0 THEN 'reddit' END], lambda f: f IS NOT NULL) AS fam, list_filter([CASE WHEN o_custkey % 4 = 0 THEN 'twitch' END, 'rawg'], lambda f: f IS NOT NULL) AS ev, o_totalprice / 20000 AS pi, (o_custkey % 10) / 10 AS pc FROM orders),
a AS (SELECT *, list_filter(fam, lambda f: lower(f) NOT IN ('official_store', 'store', 'steam', 'steam_chart', 'rawg')) AS ind, in_popular OR (pi >= 8 AND pc >= 0.4) AS popular, steam > 0 AND steam <= 50 AS wish, d IS NULL OR d + INTERVAL 12 HOUR >= TIMESTAMP '1998-06-01' - INTERVAL 12 HOUR AS upcoming FROM r),
b AS (SELECT *, greatest(pubs, len(ind)) AS cov, list_distinct(list_filter(list_concat(ev, ind), lambda f: lower(f) NOT IN ('official_store', 'store', 'steam', 'steam_chart', 'rawg'))) AS cf FROM a),
c AS (SELECT *, cov >= 3 OR (cov >= 2 AND len(cf) >= 2) AS crossing FROM b),
e AS (SELECT *, manual OR cov >= 5 OR (wish AND cov >= 3) OR (cov >= 2 AND popular) OR (crossing AND popular) AS antic,
  CASE WHEN popular THEN 10 ELSE 0 END + CASE WHEN wish THEN greatest(3, 9 - floor((steam - 1) / 8)) ELSE 0 END + CASE WHEN cov >= 2 THEN least(18, cov * 3) ELSE 0 END + CASE WHEN len(cf) >= 2 THEN least(6, len(cf) * 2) ELSE 0 END + CASE WHEN manual THEN 12 ELSE 0 END + CASE WHEN NOT upcoming AND page THEN 2 ELSE 0 END + CASE WHEN precision = 'exact' THEN 1 ELSE 0 END AS score FROM c),
s AS (SELECT *, list_filter([CASE WHEN release_type <> 'full' THEN 'non_full_release' END, CASE WHEN NOT has_event THEN 'missing_event' END, CASE WHEN needs_review THEN 'needs_review' END, CASE WHEN NOT cover THEN 'unverified_cover' END, CASE WHEN NOT antic THEN 'no_global_anticipation_signal' END,
  CASE WHEN upcoming AND NOT antic THEN 'upcoming_without_measured_global_interest' END, CASE WHEN score < 7 THEN 'anticipation_below_7' END], lambda x: x IS NOT NULL) AS reasons FROM e)
SELECT k AS o_orderkey, CAST(score AS INTEGER) AS quality_score, upcoming, array_to_string(list_filter([CASE WHEN popular THEN 'current_popular' END, CASE WHEN wish THEN 'steam_popular_upcoming' END, CASE WHEN cov >= 3 THEN 'gaming_press' END, CASE WHEN crossing THEN 'cross_site_coverage' END, CASE WHEN manual THEN 'manual_feature' END], lambda x: x IS NOT NULL), ',') AS signals,
  array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS homepage_eligible FROM s"""
)
def home_release_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda *cs: F.array_compact(F.array(*cs))
    rows = table(spark, sf_dir, "orders").select(
        k, F.when(k % 6 == 0, "demo").when(k % 6 != 1, "full").alias("release_type"), (k % 19 != 0).alias("has_event"), F.when(k % 2 == 0, "exact").otherwise("month").alias("precision"), F.when(k % 4 != 3, F.to_date("o_orderdate")).alias("release_date"),
        (k % 11 == 0).alias("needs_review"), (k % 5 != 0).alias("cover_verified"), (k % 23 == 0).alias("manual_feature"), (F.col("o_orderstatus") == "F").alias("published_page"), (c % 9 == 0).alias("in_popular"), (c % 70).cast("int").alias("steam_position"), (c % 6).cast("int").alias("publications"),
        some(F.lit("news"), F.lit("Steam"), F.when(k % 3 == 0, "youtube"), F.when(c % 2 == 0, "store"), F.when(k % 7 == 0, "reddit")).alias("source_families"), some(F.when(c % 4 == 0, "twitch"), F.lit("rawg")).alias("evidence_families"), (F.col("o_totalprice") / 20000).alias("popular_index"), (c % 10 / 10).alias("popular_confidence"),
    )
    out = R.home_release_quality(rows, F.lit("1998-06-01").cast("timestamp"))
    return out.select(k, "quality_score", "upcoming", F.array_join("signals", ",").alias("signals"), F.array_join("reasons", ",").alias("reasons"), "homepage_eligible")


@query(
    """WITH r AS (SELECT o_orderkey AS k, CAST(o_custkey % 6 AS INTEGER) AS press, CAST(o_orderkey % 7 AS INTEGER) AS hist, o_totalprice / 400 AS gs, o_totalprice / 500 AS ts, CAST(o_custkey % 5 AS INTEGER) AS m, o_orderstatus <> 'P' AS ge, CAST(o_orderkey % 21 AS DOUBLE) AS ps, (o_custkey % 10) / 10 AS pc, CAST(o_orderkey % 4 AS INTEGER) AS pf, o_orderkey % 13 = 0 AS cs,
  CASE o_orderkey % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'review' ELSE 'rejected' END AS status, o_orderkey % 17 = 0 AS rejected, CASE WHEN o_orderkey % 5 = 0 THEN 'review' END AS manual, o_orderkey % 4 <> 1 AS confirmed, CASE o_custkey % 4 WHEN 0 THEN ['daily_cap'] WHEN 1 THEN ['global_notability_required', 'x'] WHEN 2 THEN NULL ELSE ['x'] END AS had FROM orders),
a AS (SELECT *, ps >= 10 AND pc >= 0.5 AND pf >= 2 AS strong, ps >= 15 AND pc >= 0.6 AND pf >= 3 AS intense, ge AND (gs >= 450 OR ts >= 450 OR m >= 3) AS momentum FROM r),
b AS (SELECT *, list_filter([CASE WHEN press >= 4 THEN 'broad-independent-gaming-coverage' END, CASE WHEN press >= 3 AND (strong OR momentum) THEN 'independent-coverage-plus-global-momentum' END, CASE WHEN press >= 2 AND intense THEN 'strong-cross-site-attention-plus-independent-coverage' END], lambda x: x IS NOT NULL) AS br, hist >= 4 AND (press >= 1 OR strong) AND (pf >= 2 OR cs OR press >= 1) AS niche FROM a),
c AS (SELECT *, CASE WHEN len(br) > 0 THEN 'broad-global' WHEN niche THEN 'niche-global' ELSE 'none' END AS notability, coalesce(had, []) AS h, list_filter(coalesce(had, []), lambda x: x NOT IN ('global_or_niche_notability_required', 'global_notability_required')) AS cleared, rejected OR status = 'rejected' AS fixed FROM b)
SELECT k AS o_orderkey, notability, array_to_string(CASE WHEN niche THEN list_append(br, 'established-franchise-niche-attention') ELSE br END, ',') AS reasons,
  CASE WHEN fixed THEN status WHEN notability = 'none' OR NOT confirmed THEN 'review' WHEN list_contains(cleared, 'daily_cap') OR coalesce(manual, '') = 'review' THEN status ELSE 'published' END AS gated_status,
  array_to_string(CASE WHEN fixed THEN h WHEN notability = 'none' THEN list_append(h, 'global_or_niche_notability_required') WHEN NOT confirmed THEN list_append(cleared, 'no_confirmed_platform_event') ELSE cleared END, ',') AS gated_reasons FROM c"""
)
def notability_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(
        k, (c % 6).cast("int").alias("publications"), (k % 7).cast("int").alias("historical_publications"), (price / 400).alias("global_score"), (price / 500).alias("trend_score"), (c % 5).cast("int").alias("mentions"), (F.col("o_orderstatus") != "P").alias("global_event"),
        (k % 21).cast("double").alias("popular_score"), (c % 10 / 10).alias("popular_confidence"), (k % 4).cast("int").alias("popular_families"), (k % 13 == 0).alias("cross_site"), F.when(k % 3 == 0, "published").when(k % 3 == 1, "review").otherwise("rejected").alias("status"),
        (k % 17 == 0).alias("rejected"), F.when(k % 5 == 0, "review").alias("manual_decision"), (k % 4 != 1).alias("confirmed_event"), F.when(c % 4 == 0, F.array(F.lit("daily_cap"))).when(c % 4 == 1, F.array(F.lit("global_notability_required"), F.lit("x"))).when(c % 4 == 3, F.array(F.lit("x"))).alias("automatic_reasons"),
    )
    out = R.notability_gate(R.global_notability(rows))
    return out.select(k, "notability", F.array_join("notability_reasons", ",").alias("reasons"), "gated_status", F.array_join("gated_reasons", ",").alias("gated_reasons"))


_WEIGHTS = {"home_quality_gate": 40, "own_page": 15, "published_page": 10, "independent_coverage": 20, "official_announcement": 25, "known_developer_or_publisher": 30, "current_popular": 35}


@query(
    f"""WITH w(signal, points) AS (VALUES {", ".join(f"('{s}', {v}.0::DOUBLE)" for s, v in _WEIGHTS.items())}),
r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'demo' END AS excluded, p_partkey % 13 = 0 AS edition, p_partkey % 3 <> 1 AS public, list_filter([CASE WHEN p_partkey % 9 = 0 THEN 'current_popular' END, CASE WHEN p_partkey % 10 = 0 THEN 'own_page' END, CASE WHEN p_partkey % 8 = 0 THEN 'unweighted' END, CASE WHEN p_size > 40 THEN 'home_quality_gate' END, CASE WHEN p_size % 4 = 0 THEN 'own_page' END, CASE WHEN p_size % 5 = 0 THEN 'published_page' END, CASE WHEN p_size % 3 > 0 THEN 'independent_coverage' END, CASE WHEN p_partkey % 7 = 0 THEN 'official_announcement' END, CASE WHEN p_brand IN ('Brand#1', 'Brand#10', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15', 'Brand#16', 'Brand#17', 'Brand#18', 'Brand#19') THEN 'known_developer_or_publisher' END], lambda x: x IS NOT NULL) AS s FROM part),
d AS (SELECT * EXCLUDE (s), list_sort(list_distinct(s)) AS s FROM r), n AS (SELECT k, coalesce(sum(points), 0) AS score FROM (SELECT k, unnest(s) AS signal FROM d) LEFT JOIN w USING (signal) GROUP BY k),
x AS (SELECT d.*, coalesce(score, 0) AS score, coalesce(excluded, CASE WHEN edition THEN 'duplicate_edition' END) AS rejection FROM d LEFT JOIN n USING (k))
SELECT k AS p_partkey, array_to_string(s, ',') AS signals, score::DOUBLE AS significance, rejection, array_to_string(list_filter([CASE WHEN len(s) = 0 THEN 'no_significance_signal' END, CASE WHEN score < 30 THEN 'below_significance_threshold' END, CASE WHEN score >= 30 AND rejection IS NULL AND NOT public THEN 'no_confirmed_platform_event' END], lambda r: r IS NOT NULL), ',') AS automatic_reasons,
  CASE WHEN rejection IS NOT NULL THEN 'rejected' WHEN score >= 30 AND public THEN 'published' ELSE 'review' END AS status FROM x"""
)
def calendar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        k, F.when(k % 6 == 0, "demo").alias("excluded"), (k % 13 == 0).alias("edition_of_known"), (k % 3 != 1).alias("public_event"), F.array_compact(F.array(F.when(k % 9 == 0, "current_popular"), F.when(k % 10 == 0, "own_page"), F.when(k % 8 == 0, "unweighted"))).alias("quality_signals"),
        (size > 40).alias("homepage_eligible"), (size % 4 == 0).alias("has_page"), (size % 5 == 0).alias("published"), (size % 3).alias("independent_sources"), F.when(k % 7 == 0, F.array(F.lit("Official_Announcement"))).alias("source_families"), F.col("p_brand").alias("organizations"),
    )
    out = R.candidate_status(R.significance(rows, _WEIGHTS, ("Brand#1",)), 30)
    return out.select(k, F.array_join("signals", ",").alias("signals"), "significance", "rejection", F.array_join("automatic_reasons", ",").alias("automatic_reasons"), "status")


@query(
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 31 = 0 THEN 'identity.canonicalTitle' END, CASE WHEN p_partkey % 29 = 0 THEN 'identity.slug' END, CASE WHEN p_size = 1 THEN 'workflow.needs_review' END, CASE WHEN p_size = 2 THEN 'workflow.merged' END, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 10 <> 0 THEN 'embedded_content_requires_base_game' END, CASE WHEN p_size % 9 = 0 THEN 'unresolved_conflicts' END,
  CASE WHEN p_partkey % 6 = 0 THEN 'release_confirmation' END, CASE WHEN p_type = 'SMALL' THEN 'description' END, CASE WHEN p_partkey % 4 = 3 THEN 'cover_or_hero' END], lambda x: x IS NOT NULL), ',') AS missing, NOT (p_partkey % 31 = 0 OR p_partkey % 29 = 0 OR p_size IN (1, 2) OR (p_partkey % 5 = 0 AND p_partkey % 10 <> 0) OR p_size % 9 = 0 OR p_partkey % 6 = 0 OR p_type = 'SMALL' OR p_partkey % 4 = 3) AS passed FROM part"""
)
def registry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        k, F.when(k % 31 != 0, F.col("p_name")).alias("title"), F.when(k % 29 == 0, "").otherwise(F.col("p_name")).alias("slug"), F.when(size == 1, "needs_review").when(size == 2, "merged_into_another_game").alias("workflow"), (k % 5 == 0).alias("embedded"), (k % 10 == 0).alias("standalone"),
        F.when(size % 9 == 0, size).alias("conflicts"), (k % 6 != 0).alias("has_release"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("description"), (k % 4 != 3).alias("has_cover"),
    )
    return Q.publication_gate(rows, "p_partkey", R.registry_requirements())


@query(
    f"""WITH r AS (SELECT s_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS shots, count(DISTINCT l_linenumber) AS feats, count(*) FILTER (l_returnflag = 'A') AS off, count(*) FILTER (l_returnflag = 'N') AS ed FROM supplier JOIN lineitem ON s_suppkey = l_suppkey AND l_orderkey % 40 = s_suppkey % 40 GROUP BY 1)
SELECT s_suppkey, array_to_string(list_filter([{", ".join(f"CASE WHEN s_suppkey % {i + 7} = 0 THEN 'missing {f}' END" for i, f in enumerate(R.DOSSIER_FIELDS))}, CASE WHEN n < 10 THEN 'fewer than 10 sources' END, CASE WHEN shots < 6 THEN 'fewer than 6 screenshots' END, CASE WHEN feats < 4 THEN 'fewer than 4 features' END, CASE WHEN off < 1 THEN 'no official or store evidence' END, CASE WHEN ed < 3 THEN 'fewer than 3 editorial sources' END], lambda x: x IS NOT NULL), ',') AS missing,
  NOT ({" OR ".join(f"s_suppkey % {i + 7} = 0" for i in range(10))} OR n < 10 OR shots < 6 OR feats < 4 OR off < 1 OR ed < 3) AS passed FROM r"""
)
def dossier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as dossiers; the lines that belong to one (orders of its own remainder) are its sources."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    own = li.join(s, (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("l_orderkey") % 40 == F.col("s_suppkey") % 40))
    flag = F.col("l_returnflag")
    rows = own.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("l_partkey").alias("screenshots"), F.count_distinct("l_linenumber").alias("features"), F.count_if(flag == "A").alias("official_sources"), F.count_if(flag == "N").alias("editorial_sources"))
    return Q.publication_gate(rows, "s_suppkey", R.dossier_requirements({f: F.col("s_suppkey") % (i + 7) != 0 for i, f in enumerate(R.DOSSIER_FIELDS)}))


@query(
    """WITH c AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS fresh, list_distinct(['p' || o_custkey % 4, 'p' || o_custkey % 3]) AS pubs, ['f' || o_custkey % 5] AS fr, list_filter(['gaming_news', CASE WHEN o_orderkey % 2 = 0 THEN 'Steam_chart' END], lambda x: x IS NOT NULL) AS fam, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 9000 END AS pi, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 END AS pc, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 60 + 1 AS INTEGER) END AS sp FROM orders),
b AS (SELECT o_orderkey AS k, ['p' || o_custkey % 7, 'q'] AS pubs, ['f1', 'f2'] AS fr, ['youtube'] AS fam, CAST(o_custkey % 9 AS INTEGER) AS pcount, CAST(o_custkey % 8 AS INTEGER) AS fcount, CAST(o_custkey % 12 AS DOUBLE) AS pi, 0.3 AS pc, CAST(o_custkey % 50 AS INTEGER) AS sp FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT c.k, fresh, list_sort(list_distinct(list_concat(c.pubs, CASE WHEN fresh THEN [] ELSE coalesce(b.pubs, []) END))) AS pubs, list_sort(list_distinct(list_concat(c.fr, CASE WHEN fresh THEN [] ELSE coalesce(b.fr, []) END))) AS fr, list_sort(list_distinct(list_concat(c.fam, CASE WHEN fresh THEN [] ELSE coalesce(b.fam, []) END))) AS fam, coalesce(c.pi, nullif(b.pi, 0)) AS pi, coalesce(c.sp, nullif(b.sp, 0)) AS sp, coalesce(pcount, 0) AS pcount, coalesce(fcount, 0) AS fcount FROM c LEFT JOIN b USING (k)),
n AS (SELECT *, CASE WHEN fresh THEN len(pubs) ELSE greatest(len(pubs), pcount) END AS publication_count, CASE WHEN fresh THEN len(fr) ELSE greatest(len(fr), fcount) END AS franchise_count, len(list_filter(fam, lambda f: lower(f) NOT IN ('official_store', 'store', 'steam', 'steam_chart', 'rawg'))) AS o FROM j)
SELECT k AS o_orderkey, CAST(publication_count AS INTEGER) AS publication_count, CAST(franchise_count AS INTEGER) AS franchise_count, array_to_string(fam, ',') AS families, sp AS steam_position, floor((least(40.0::DOUBLE, coalesce(pi, 0)) + CASE WHEN sp IS NOT NULL THEN greatest(0.0, 30 - least(29, sp - 1) * 1.25::DOUBLE) ELSE 0 END + least(36, 6 * publication_count) + least(16, 5 * o)) * 10 + 0.5) / 10 AS anticipation FROM n"""
)
def anticipation_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    name = lambda prefix, n: F.concat(F.lit(prefix), (c % n).cast("string"))
    now = o.select(k, (k % 3 == 0).alias("fresh"), F.array_distinct(F.array(name("p", 4), name("p", 3))).alias("publishers"), F.array(name("f", 5)).alias("franchise_publishers"), F.array_compact(F.array(F.lit("gaming_news"), F.when(k % 2 == 0, "Steam_chart"))).alias("families"), F.when(k % 4 == 0, F.col("o_totalprice") / 9000).alias("popular_index"), F.when(k % 4 == 0, 0.5).alias("popular_confidence"), F.when(k % 5 == 0, c % 60 + 1).cast("int").alias("steam_position"))
    before = o.filter("o_orderstatus = 'F'").select(k, F.array(name("p", 7), F.lit("q")).alias("publishers"), F.array(F.lit("f1"), F.lit("f2")).alias("franchise_publishers"), F.array(F.lit("youtube")).alias("families"), (c % 9).cast("int").alias("publication_count"), (c % 8).cast("int").alias("franchise_count"), (c % 12).cast("double").alias("popular_index"), F.lit(0.3).alias("popular_confidence"), (c % 50).cast("int").alias("steam_position"))
    return R.kept_anticipation(now, before, "o_orderkey").select(k, "publication_count", "franchise_count", F.array_join("families", ",").alias("families"), "steam_position", "anticipation")


@query(
    """WITH v AS (SELECT l_partkey AS g, count(DISTINCT l_orderkey) AS videos, count(DISTINCT l_suppkey) AS channels, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS views FROM lineitem GROUP BY 1), e AS (SELECT p_partkey AS g, CAST(p_size AS DOUBLE) AS s, (p_size % 10) / 10 AS c FROM part WHERE p_size > 20)
SELECT g AS l_partkey, round(greatest(least(35.0, 6 + 3 * log10(views + 1) + 1.5 * ln(1 + videos) + 1.5 * ln(1 + channels)), coalesce(s, 0)), 1) AS score, round(greatest(least(0.92, 0.38 + 0.04 * videos + 0.05 * channels), coalesce(c, 0)), 2)::DOUBLE AS confidence FROM v LEFT JOIN e USING (g)"""
)
def community_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("videos"), F.count_distinct("l_suppkey").alias("channels"), F.sum(F.floor("l_extendedprice")).alias("views"))
    e = table(spark, sf_dir, "part").filter("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("score"), (F.col("p_size") % 10 / 10).alias("confidence"))
    return R.kept_community(v, e, "l_partkey")

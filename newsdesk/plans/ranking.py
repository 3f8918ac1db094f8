"""Rankings over events, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import age_hours, recency, released, within
from ..operators import popularity as P
from ..operators import retention as R
from ..operators import topk as K
from ..operators.dedup import duplicate_pointers, keep_first, keep_newest, keep_richest, latest
from .registry import query, table

FAMILIES = ["view", "click", "purchase", "signup", "error"]
AS_OF = "2024-01-29 12:00:00"
_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3.6e9"
_DECAY = f"(CASE WHEN {_AGE} <= 96 THEN pow(0.5, greatest(0.0, {_AGE}) / 24) ELSE 0 END)"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


_SIGNALS_SQL = f"""
SELECT user_id AS game, {', '.join(f"coalesce(sum(CASE WHEN event_type = '{f}' THEN value * {_DECAY} END), 0) AS {f}" if f not in ('signup', 'error') else f"coalesce(max(CASE WHEN event_type = '{f}' THEN value * {_DECAY} END), 0) AS {f}" for f in FAMILIES)},
       count(DISTINCT event_id % 7) AS publishers, count(DISTINCT CASE WHEN value * {_DECAY} > 0 THEN event_type END) AS n_families
FROM events WHERE {_AGE} <= 96 GROUP BY user_id
"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("game"), "event_type", "ts", "value", (F.col("event_id") % 7).alias("publisher"))
    return P.popularity_signals(e, "game", "event_type", "ts", "value", "publisher", _as_of(), FAMILIES, peaks=("signup", "error"))


@query(
    f"""WITH s AS ({_SIGNALS_SQL}), m AS (SELECT {', '.join(f'greatest(max({f}), 1.0) AS m_{f}' for f in FAMILIES)} FROM s),
r AS (SELECT s.*, round(100 * (0.30 * view / m_view + 0.15 * click / m_click + 0.15 * purchase / m_purchase + 0.20 * signup / m_signup + 0.15 * error / m_error + 0.05 * n_families / 5.0), 6) AS score,
      CAST(round(least(1.0, 0.35 + 0.09 * n_families + 0.04 * least(publishers, 6)), 6) AS DOUBLE) AS confidence FROM s, m)
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, game) AS INTEGER) AS rank FROM r ORDER BY score DESC, game LIMIT 20"""
)
def popularity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.popularity_score(_signals(spark, sf_dir), "game", FAMILIES, n=20)


@query(
    f"""WITH s AS ({_SIGNALS_SQL})
SELECT game, view, click, purchase, signup, error, publishers, n_families,
  CASE WHEN publishers >= 3 AND view > 0 AND (click > 0 OR purchase > 0) THEN 'confirmed' WHEN click > view AND click > purchase AND click > 0 THEN 'community_dominant' WHEN purchase > 0 AND (view > 0 OR click > 0) THEN 'platform_corroborated' WHEN purchase > 0 THEN 'platform_chart' ELSE 'none' END AS tier,
  array_to_string(list_filter([CASE WHEN publishers >= 3 THEN 'publishers' END, CASE WHEN view > 0 THEN 'media' END, CASE WHEN click > 0 THEN 'community' END, CASE WHEN purchase > 0 THEN 'platform' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s"""
)
def popularity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tiers(_signals(spark, sf_dir), "game", "view", "click", "purchase", "publishers")


@query(
    """WITH b AS (SELECT time_bucket(INTERVAL '24 hours', ts) AS s, user_id, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL),
w AS (SELECT s - INTERVAL (k * 24) HOUR AS window_start, user_id, event_type, n, v FROM b, range(4) t(k))
SELECT window_start, window_start + INTERVAL 96 HOUR AS window_end, user_id, event_type, CAST(sum(n) AS BIGINT) AS mentions, sum(v) AS engagement FROM w GROUP BY ALL"""
)
def mention_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mention_windows(table(spark, sf_dir, "events"), "ts", "user_id", "event_type", "value")


@query(
    f"""SELECT event_id, CASE WHEN {_AGE} <= 72 THEN pow(0.5, greatest(0.0, {_AGE}) / 18) ELSE 0 END AS recency, {_AGE} BETWEEN 0 AND 96 AS fresh FROM events"""
)
def event_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", recency(F.col("ts"), _as_of(), 72, 18).alias("recency"), within(F.col("ts"), _as_of(), 96).alias("fresh"))


@query(
    """SELECT user_id, count(DISTINCT event_id) AS videos, count(DISTINCT event_type) AS channels, sum(CAST(value AS BIGINT)) AS views, sum(event_id % 5) AS comments,
  round(least(35.0, 6 + 3 * log10(sum(CAST(value AS BIGINT)) + 1) + 1.5 * ln(1 + count(DISTINCT event_id)) + 1.5 * ln(1 + sum(event_id % 5))), 6) AS score FROM (SELECT event_id, user_id, event_type, floor(abs(value)) AS value FROM events) GROUP BY user_id"""
)
def community_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.abs("value")).alias("views"), (F.col("event_id") % 5).alias("comments"))
    return P.community_rollup(e, "user_id", "event_id", "event_type", "views", "comments")


@query("""SELECT * EXCLUDE (r) FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 4 ORDER BY n_chars DESC, doc_id LIMIT 36""")
def source_cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return K.cap_by_group(d, "source", [F.desc("n_chars"), F.col("doc_id")], 4, 36)


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority LIKE '1%' AS manual, o_totalprice FROM orders),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY manual DESC, o_totalprice DESC, o_orderkey) AS INTEGER) AS day_rank FROM o)
SELECT *, CASE WHEN day_rank > 6 AND NOT manual THEN 'review' ELSE 'public' END AS status FROM r"""
)
def daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").startswith("1").alias("manual"), "o_totalprice")
    return K.daily_cap(o, "day", F.col("manual"), [F.desc("o_totalprice"), F.col("o_orderkey")], 6)


@query(
    """WITH s AS (SELECT l_partkey AS p_partkey, sum(l_quantity) AS sold FROM lineitem GROUP BY 1),
r AS (SELECT p.p_partkey, p_name, p_retailprice, sold FROM part p JOIN s USING (p_partkey) WHERE p_size <= 40)
SELECT *, CAST(row_number() OVER (ORDER BY sold DESC, p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM r ORDER BY sold DESC, p_retailprice DESC, p_partkey LIMIT 250"""
)
def top250(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("sold"))
    p = table(spark, sf_dir, "part").filter("p_size <= 40").select("p_partkey", "p_name", "p_retailprice")
    return K.top(p.join(sold, "p_partkey"), [F.desc("sold"), F.desc("p_retailprice"), F.col("p_partkey")], 250)


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN false ELSE o_orderdate <= TIMESTAMP '1997-01-01' END AS released,
  CASE WHEN o_orderstatus = 'O' THEN 'status' WHEN CAST(o_orderdate AS DATE) > DATE '1997-01-01' THEN CASE WHEN year(o_orderdate) > 1997 THEN 'future_year' ELSE 'future_date' END ELSE 'released' END AS reason FROM orders"""
)
def released_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "upcoming").otherwise("out")
    return o.select("o_orderkey", released(status, F.to_date("o_orderdate"), F.lit("1997-01-01").cast("date")).alias("r")).select("o_orderkey", "r.released", "r.reason")


_CUR, _PREV = "o_orderkey % 2 = 0", "o_orderkey % 3 = 0"


@query(
    """WITH c AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15),
p AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30),
b AS (SELECT *, false AS carried FROM c UNION ALL SELECT *, true FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c))
SELECT * FROM b ORDER BY carried, o_totalprice DESC, o_orderkey LIMIT 20"""
)
def carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    now = o.filter(F.col("o_orderpriority").startswith("1")).drop("o_orderpriority").orderBy(*order).limit(15)
    old = o.filter("o_orderkey % 3 = 0").drop("o_orderpriority").orderBy(*order).limit(30)
    return K.carry_over(now, old, "o_orderkey", order, 20)


@query(
    """WITH o AS (SELECT o_orderkey, o_totalprice, o_totalprice > 400000 AS public FROM orders),
n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM o WHERE NOT public),
h AS (SELECT count(*) FILTER (public) AS k FROM o)
SELECT o.o_orderkey, o_totalprice, public OR coalesce(r <= 500 - k, false) AS public, coalesce(r <= 500 - k, false) AS promoted FROM o LEFT JOIN n USING (o_orderkey), h"""
)
def public_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") > 400000).alias("public"))
    return K.public_floor(o, "o_orderkey", "public", [F.desc("o_totalprice"), F.col("o_orderkey")], 500)


@query(
    """WITH r AS (SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 3 DAY), k AS (SELECT count(*) >= 200 AS ok FROM r)
SELECT r.* FROM r, k WHERE ok UNION ALL SELECT x.* FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 200) x, k WHERE NOT ok"""
)
def live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.live_window(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", _as_of(), 3, 200, 50, [F.desc("ts"), F.col("event_id")])


@query(
    """WITH c AS (SELECT c_custkey, c_acctbal, r_name = 'ASIA' AS regional FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM c QUALIFY place <= 12),
e AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM c WHERE regional AND c_custkey NOT IN (SELECT c_custkey FROM f) QUALIFY place <= 3)
SELECT c_custkey, c_acctbal, regional, CAST(place AS INTEGER) AS place, false AS mixed FROM f WHERE place <= 12 - (SELECT count(*) FROM e) UNION ALL SELECT c_custkey, c_acctbal, regional, CAST(place AS INTEGER), true FROM e"""
)
def regional_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", (F.col("r_name") == "ASIA").alias("regional"))
    return K.regional_mix(c, "c_custkey", F.col("regional"), [F.desc("c_acctbal"), F.col("c_custkey")], 12, 3)


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders),
p AS (SELECT *, 'recent' AS class, row_number() OVER (ORDER BY day DESC, o_totalprice DESC, o_orderkey) AS place FROM o WHERE day <= DATE '1997-01-01' AND day >= DATE '1997-01-01' - 14 QUALIFY place <= 4),
u AS (SELECT *, 'upcoming' AS class, row_number() OVER (ORDER BY day, o_totalprice DESC, o_orderkey) AS place FROM o WHERE day > DATE '1997-01-01' QUALIFY place <= 12)
SELECT o_orderkey, day, o_totalprice, CAST(place AS INTEGER) AS place, class FROM (SELECT * FROM p UNION ALL SELECT * FROM u) ORDER BY class, place LIMIT 12"""
)
def recent_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return K.recent_and_upcoming(o, "day", F.lit("1997-01-01").cast("date"), "o_totalprice", "o_orderkey")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, max(o_orderdate) AS newest, sum(o_totalprice) AS total FROM orders GROUP BY 1""")
def month_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("newest"), F.sum("o_totalprice").alias("total"))


@query("""SELECT source AS day, count(*) AS n, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY 1""")
def group_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = K.group_members(table(spark, sf_dir, "documents"), F.col("source"), "day", ["doc_id"], ["doc_id"])
    return g.select("day", "n", F.transform("members", lambda m: m["doc_id"]).alias("ids"))


@query("""SELECT source AS day, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents""")
def group_listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("day"), "doc_id")
    return K.places(d, ["day"], [F.col("doc_id")], "place")


@query("""WITH r AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_orderkey) AS p FROM lineitem QUALIFY p <= 100) SELECT l_partkey, CAST(min(p) AS INTEGER) AS best_rank, count(*) AS rankings FROM r GROUP BY 1""")
def best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_orderkey")]
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_partkey", "l_orderkey", "l_extendedprice")
    from pyspark.sql import Window

    ranked = rows.withColumn("p", F.row_number().over(Window.partitionBy("l_linenumber").orderBy(*order))).filter("p <= 100")
    return K.best_rank(ranked, "l_partkey", "p")


_VERSIONS = """SELECT strftime(o_orderdate, '%Y%m') AS version, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS objects, bool_or(o_orderpriority LIKE '1%' AND o_orderkey % 16 < 4) AS complete, max(o_orderdate) AS ts FROM orders GROUP BY 1"""


@query(
    f"""WITH g AS ({_VERSIONS}), r AS (SELECT version FROM g WHERE complete ORDER BY ts DESC, version DESC LIMIT 12),
m AS (SELECT g.*, r.version IS NOT NULL AS recent, CAST(g.ts AS DATE) AS day FROM g LEFT JOIN r USING (version)),
d AS (SELECT version FROM (SELECT version, ts, row_number() OVER (PARTITION BY day ORDER BY ts DESC, version DESC) AS k FROM m WHERE complete AND NOT recent AND version <> '199601' AND day NOT IN (SELECT day FROM m WHERE recent OR version = '199601')) WHERE k = 1 ORDER BY ts DESC, version DESC LIMIT 7),
x AS (SELECT m.version, bytes, objects, complete, ts, CASE WHEN m.version = '199601' THEN 'current' WHEN NOT complete THEN 'incomplete' WHEN recent THEN 'recent' WHEN d.version IS NOT NULL THEN 'daily' ELSE 'expired' END AS reason FROM m LEFT JOIN d ON m.version = d.version)
SELECT *, reason IN ('current', 'recent', 'daily') AS keep FROM x"""
)
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_orderkey") % 16 < 4), "manifest.json").otherwise("data.json")
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("version"), key.alias("key"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").alias("modified"))
    return R.retention_plan(R.snapshot_groups(o, "version", "key", "size", "modified", "manifest.json").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "version", "ts", 12, 7, "199601")


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def unreferenced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return R.unreferenced(table(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey")


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def conversation_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1""")
def newest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_newest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r = 1""")
def richest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_richest(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", F.col("n_chars"), "doc_id")


@query("""SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY doc_id)""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("identity"))
    return duplicate_pointers(d, "identity", [F.col("doc_id")], "doc_id").drop("identity")


@query("""SELECT p_type, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_type""")
def best_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice"), ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")])


@query(
    """WITH RECURSIVE d AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(CAST(l_shipdate AS DATE) - DATE '1970-01-01'))) AS days FROM lineitem GROUP BY 1),
o AS MATERIALIZED (SELECT o_orderkey AS k, -o_totalprice AS r, days, row_number() OVER (ORDER BY -o_totalprice, o_orderkey) AS i FROM orders JOIN d ON o_orderkey = k),
f AS (SELECT min(x) AS low, max(x) AS high FROM (SELECT unnest(days) AS x FROM o)),
w(one, i, used, taken) USING KEY (one) AS (
  SELECT 1, 0::BIGINT, list_transform(range(low, high + 1), lambda x: 0), []::BIGINT[] FROM f
  UNION SELECT 1, o.i, CASE WHEN ok THEN list_transform(used, lambda n, x: CASE WHEN list_contains(places, x) THEN n + 1 ELSE n END) ELSE used END, CASE WHEN ok THEN list_append(taken, o.k) ELSE taken END
  FROM (SELECT w.*, o.k, o.i AS oi, list_transform(o.days, lambda x: x - low + 1) AS places, list_max(list_transform(o.days, lambda x: used[x - low + 1])) < 6 AS ok FROM w JOIN o ON o.i = w.i + 1, f) AS s JOIN o ON o.i = s.oi
)
SELECT o.k AS l_orderkey, o.r FROM (SELECT unnest(taken) AS k FROM w) JOIN o USING (k)"""
)
def greedy_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the ship days of their lines, by price: a day takes six orders."""
    days = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.to_date("l_shipdate"))).alias("days"))
    ranked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (-F.col("o_totalprice")).alias("r"))
    return K.greedy_dates(ranked.join(days, "l_orderkey"), "l_orderkey", "days", "r", 6)


@query(
    """WITH RECURSIVE m AS (SELECT l_orderkey AS g, l_returnflag AS s, l_partkey AS id, l_extendedprice AS score FROM lineitem),
r AS (SELECT g, s, id, most, row_number() OVER (PARTITION BY g ORDER BY most, s, score DESC, id) AS i FROM m, (VALUES (1), (2)) AS t(most)),
w AS (SELECT g, 0::BIGINT AS i, '' AS s, 0::BIGINT AS id, false AS ok, []::BIGINT[] AS used, []::VARCHAR[] AS filled FROM (SELECT DISTINCT g FROM r)
  UNION ALL SELECT g, i, s, id, ok, CASE WHEN ok THEN list_append(used, id) ELSE used END, CASE WHEN ok THEN list_append(filled, s) ELSE filled END
  FROM (SELECT r.g, r.i, r.s, r.id, used, filled, NOT list_contains(used, r.id) AND len(list_filter(filled, lambda x: x = r.s)) < r.most AS ok FROM w JOIN r ON r.g = w.g AND r.i = w.i + 1))
SELECT g AS l_orderkey, s AS section, id AS media_id FROM w WHERE ok"""
)
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media for sections: the lines of an order as media, their flags as sections."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("section"), F.col("l_partkey").alias("media_id"), F.col("l_extendedprice").alias("score"))
    return K.section_fill(rows, "l_orderkey", 1, 2)


@query("""WITH p AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS media, count(*) AS sources, max(n) / sum(n) AS largest_share FROM p GROUP BY 1""")
def source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.source_share(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query(f"""SELECT event_id FROM events WHERE {_AGE} <= 336""")
def age_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(age_hours(F.col("ts"), _as_of()) <= 336).select("event_id")


@query(
    """WITH m AS (SELECT l_orderkey, count(*) AS media, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey, count(*) AS sources, max(n) / sum(n) AS largest_share FROM s GROUP BY 1),
c AS (SELECT l_orderkey, min(n) AS smallest_section FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1)
SELECT l_orderkey, media, u AS "unique", sources, largest_share, smallest_section, media >= 4 AND u = media AND sources >= 4 AND largest_share <= 0.35 AND smallest_section >= 1 AS passed FROM m JOIN t USING (l_orderkey) JOIN c USING (l_orderkey)"""
)
def media_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its media, parts as addresses, flags as sections; four of them and four suppliers are asked for."""
    return K.media_gate(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", 4, 4, 4)

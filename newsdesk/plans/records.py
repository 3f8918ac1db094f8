"""Ledger, registry and quality queries over orders, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..operators import ledger as L
from ..operators import linking as K
from ..operators import quality as Q
from ..operators import registry as G
from ..operators import releases as Z
from ..sources.scratch import scratch_dir
from .registry import query, table


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an earlier snapshot: without every fifth key."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0")
    return o.select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.floor("o_totalprice").alias("price"))


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a later snapshot: without every seventh key, with some values changed or emptied."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    status = F.when(k % 11 == 0, "").when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus"))
    day = F.when(k % 4 == 0, F.date_add(F.to_date("o_orderdate"), 10)).when(k % 9 == 0, F.date_sub(F.to_date("o_orderdate"), 5)).otherwise(F.to_date("o_orderdate"))
    return o.select("o_orderkey", status.alias("o_orderstatus"), day.alias("day"), F.floor("o_totalprice").alias("price"))


_OLD = "o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders WHERE o_orderkey % 5 <> 0)"
_NEW = """n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 10 WHEN o_orderkey % 9 = 0 THEN CAST(o_orderdate AS DATE) - 5 ELSE CAST(o_orderdate AS DATE) END AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders WHERE o_orderkey % 7 <> 0)"""
_HASH = ["o_orderstatus", "day", "price"]


_DRIFT = f"WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra' ELSE 'mismatched' END AS status FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR (o.o_orderstatus, o.day, o.price) <> (n.o_orderstatus, n.day, n.price)"


@query(_DRIFT)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = [f(spark, sf_dir).withColumn("digest", L.content_hash(_HASH)) for f in (_old, _new)]
    return L.drift(*marked, "o_orderkey", "digest")


@query(_DRIFT)
def drift_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two snapshots written as digest trees."""
    paths = [scratch_dir(spark) for _ in range(2)]
    for f, path in zip((_old, _new), paths, strict=True):
        L.write_digest_tree(f(spark, sf_dir).withColumn("digest", L.content_hash(_HASH)), "o_orderkey", "digest", path, 1)
    return L.drift_by_tree(spark, *paths, "o_orderkey")


@query(
    f"""WITH {_OLD}, {_NEW}, j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, 'exact:' || o.day AS old_value, 'exact:' || n.day AS new_value, o.day AS od, n.day AS nd FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderkey, CASE WHEN old_value IS NULL THEN 'new_release' WHEN new_value IS NULL THEN 'missing_from_source' WHEN nd > od THEN 'delayed' ELSE 'date_changed' END AS type, old_value, new_value FROM j WHERE old_value IS NULL OR new_value IS NULL OR od <> nd"""
)
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = (f(spark, sf_dir).withColumn("precision", F.lit("exact")) for f in (_old, _new))
    return L.detect_changes(o, n, "o_orderkey", "day", "precision")


@query(
    f"""WITH {_OLD}, {_NEW}, j AS (SELECT o.day AS od, n.day AS nd, o.o_orderkey AS a, n.o_orderkey AS b FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT CASE WHEN a IS NULL THEN 'new_release' WHEN b IS NULL THEN 'missing_from_source' WHEN nd > od THEN 'delayed' ELSE 'date_changed' END AS type, count(*) AS n FROM j WHERE a IS NULL OR b IS NULL OR od <> nd GROUP BY 1"""
)
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.change_counts(change_detect(spark, sf_dir), "type")


@query(
    f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL OR n.o_orderstatus = '' THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus,
  coalesce(n.day, o.day) AS day, coalesce(n.price, o.price) AS price, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'keep' ELSE 'update' END AS op FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"""
)
def upsert_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.upsert_keeping(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderkey", ["o_orderstatus"])


@query(f"WITH {_OLD}, {_NEW} SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 1 ELSE 2 END AS revision_no FROM n LEFT JOIN o USING (o_orderkey) WHERE o.o_orderkey IS NULL OR (o.o_orderstatus, o.day, o.price) <> (n.o_orderstatus, n.day, n.price)")
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _old(spark, sf_dir).select("o_orderkey", F.lit(1).alias("revision_no"), L.content_hash(_HASH).alias("digest"))
    incoming = _new(spark, sf_dir).select("o_orderkey", L.content_hash(_HASH).alias("digest"))
    return L.append_revisions(ledger, incoming, "o_orderkey", "digest").drop("digest")


@query(f"WITH {_OLD}, {_NEW} SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS op FROM n LEFT JOIN o USING (o_orderkey) WHERE o.o_orderkey IS NULL OR (o.o_orderstatus, o.day, o.price) <> (n.o_orderstatus, n.day, n.price)")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = (f(spark, sf_dir).withColumn("digest", L.content_hash(_HASH)) for f in (_old, _new))
    return L.upsert_plan(o, n, "o_orderkey", "digest")


@query(f"WITH {_OLD}, {_NEW} SELECT n.o_orderkey, CASE WHEN o.o_orderkey % 2 = 0 THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, n.day, coalesce(o.price, n.price) AS price FROM n LEFT JOIN o USING (o_orderkey)")
def editorial_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("o_orderstatus"))).otherwise(F.array().cast("array<string>"))
    return L.apply_locks(_old(spark, sf_dir).withColumn("locks", locks), _new(spark, sf_dir), "o_orderkey", "locks", ["o_orderstatus"], "price")


@query(f"WITH {_OLD}, {_NEW} SELECT o_orderkey, o_orderstatus, day, price FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.replace_children(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderkey")


@query(f"WITH {_OLD}, {_NEW} SELECT o_orderkey, o_orderstatus, day, price FROM n ANTI JOIN o USING (o_orderkey) UNION ALL SELECT n.o_orderkey, n.o_orderstatus, n.day, o.price FROM n JOIN o USING (o_orderkey) UNION ALL SELECT * FROM o ANTI JOIN n USING (o_orderkey)")
def merged_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_incoming(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderkey", "day", ["price"])


@query(f"WITH {_OLD}, {_NEW} SELECT o.o_orderkey, o.o_orderstatus, o.day, o.price, n.day AS other_date, coalesce(o.day <> n.day, false) AS needs_review FROM o LEFT JOIN n USING (o_orderkey)")
def date_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.date_conflicts(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderkey", "day")


@query(f"WITH {_OLD} SELECT arg_max(o_orderkey, (day, o_orderkey)) AS o_orderkey, o_orderstatus, max(day) AS day FROM o WHERE day <= DATE '1996-06-30' GROUP BY o_orderstatus")
def as_of_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _old(spark, sf_dir).withColumn("revision_no", F.struct("day", "o_orderkey"))
    return L.as_of_revision(rows, "o_orderstatus", F.col("day") <= F.lit("1996-06-30").cast("date")).select("o_orderkey", "o_orderstatus", "day")


@query(
    """WITH s AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_sources, string_agg('supplier' || l_suppkey, '|' ORDER BY l_suppkey % 3 <> 0, 'supplier' || l_suppkey) AS sources FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderdate, sources, coalesce(n_sources, 0) AS n_sources FROM orders LEFT JOIN s USING (o_orderkey) ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 100"""
)
def news_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 3 == 0).alias("official"))
    return L.select_news(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), sources, links, "o_orderkey", "l_suppkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 1, 100)


@query(
    """WITH l AS (SELECT ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 256 AS b, c_custkey || ':' || sha256(c_name) AS line FROM customer),
p AS (SELECT b, sha256(string_agg(line, chr(10) ORDER BY line)) AS d, count(*) AS n FROM l GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM p"""
)
def set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.set_digest(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_name"))


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query('SELECT \'customer\' AS "table", count(*) AS "rows" FROM customer UNION ALL SELECT \'orders\', count(*) FROM orders UNION ALL SELECT \'documents\', count(*) FROM documents')
def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.inventory({n: table(spark, sf_dir, n) for n in ("customer", "orders", "documents")})


@query("SELECT doc_id, CAST(round(least(1.0, 0.55 + 0.1 * least(len(string_split(source, 'r')), 4)), 3) AS DOUBLE) AS confidence FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 6 <> 0")
def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "ftp://x").otherwise("https://x").alias("url"), F.when(F.col("doc_id") % 6 == 0, " ").otherwise("t").alias("title"), F.split("source", "r").alias("s"))
    return L.normalise_records(d, "doc_id", "url", "title", F.col("s"), ["published"])[0].select("doc_id", "confidence")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'url' END, CASE WHEN doc_id % 6 = 0 THEN 'title' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 0")
def quarantined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "ftp://x").otherwise("https://x").alias("url"), F.when(F.col("doc_id") % 6 == 0, " ").otherwise("t").alias("title"), F.split("source", "r").alias("s"))
    return L.normalise_records(d, "doc_id", "url", "title", F.col("s"), ["published"])[1].select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    """WITH s AS (SELECT user_id, max((ts, event_id)) FILTER (event_type <> 'error') AS last, max(ts) FILTER (event_type <> 'error') AS last_success, max(ts) FILTER (event_type = 'error') AS last_failure FROM events GROUP BY 1),
f AS (SELECT e.user_id, count(*) AS k FROM events e JOIN s USING (user_id) WHERE event_type = 'error' AND (last IS NULL OR (ts, event_id) > last) GROUP BY 1)
SELECT user_id, coalesce(k, 0) AS failures, coalesce(k, 0) >= 3 AS persistent, last_success, last_failure FROM s LEFT JOIN f USING (user_id)"""
)
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.failure_streaks(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") != "error")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS source, p_partkey - p_partkey % 7 - 1 AS target FROM part WHERE p_partkey % 7 BETWEEN 1 AND 3 AND p_partkey > 7),
w AS (SELECT source, target FROM e UNION ALL SELECT w.source, e.target FROM w JOIN e ON w.target = e.source)
SELECT source, target, false AS cyclic FROM w WHERE target NOT IN (SELECT source FROM e)"""
)
def redirect_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    e = table(spark, sf_dir, "part").filter((k % 7).between(1, 3) & (k > 7)).select(k.alias("source"), (k - k % 7 - 1).alias("target"))
    return L.redirect_roots(e)


@query(
    """SELECT 'name' AS rule, p_name AS "key", count(DISTINCT p_partkey) AS owners FROM part GROUP BY 2 HAVING owners > 1 UNION ALL SELECT 'price', CAST(p_size AS VARCHAR), count(DISTINCT p_partkey) FROM part GROUP BY 2 HAVING count(DISTINCT p_partkey) > 1"""
)
def identity_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.identity_violations(table(spark, sf_dir, "part"), "p_partkey", {"name": F.array("p_name"), "price": F.array(F.col("p_size").cast("string"))})


@query(
    """SELECT d.source, count(*) AS rows, round(avg(((CASE WHEN toxic IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN quality = 1 THEN 1 ELSE 0 END) + (CASE WHEN n_chars > 500 THEN 1 ELSE 0 END)) / 3.0::DOUBLE), 6) AS completeness,
  count(*) FILTER (((CASE WHEN toxic IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN quality = 1 THEN 1 ELSE 0 END) + (CASE WHEN n_chars > 500 THEN 1 ELSE 0 END)) / 3.0 < 0.5) AS needs_enrichment FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY 1"""
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return Q.completeness(d, "source", {"label": F.col("toxic").isNotNull(), "quality": F.col("quality") == 1, "length": F.col("n_chars") > 500})


@query(
    """SELECT 'positive_price' AS rule, CAST(o_orderkey AS VARCHAR) AS "key", CAST(NULL AS VARCHAR) AS detail FROM orders WHERE NOT o_totalprice > 20000 UNION ALL
SELECT 'known_status', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'one_order_a_customer', CAST(o_custkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM orders GROUP BY 2 HAVING count(*) > 1"""
)
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = Q.violations(o, "o_orderkey", {"positive_price": F.col("o_totalprice") > 20000, "known_status": F.col("o_orderstatus").isin("F", "O")})
    return Q.all_violations([rows, Q.duplicate_keys(o, "o_custkey", "one_order_a_customer")])


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM r)
SELECT 'rank_sequence' AS rule, l_orderkey || ':' || l_linenumber AS "key", CAST(NULL AS VARCHAR) AS detail FROM w WHERE n <> l_linenumber UNION ALL SELECT 'score_order', l_orderkey || ':' || l_linenumber, NULL FROM w WHERE s < l_extendedprice"""
)
def rank_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank_violations(table(spark, sf_dir, "lineitem"))


def _rank_violations(lines: DataFrame) -> DataFrame:
    from ..operators.dedup import keep_first

    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return Q.rank_violations(keep_first(rows, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_extendedprice")]), "l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"WITH {_OLD}, {_NEW} SELECT (SELECT count(*) FROM n) AS current, (SELECT count(*) FROM o) AS baseline, (SELECT count(*) FROM n) / (SELECT count(*) FROM o) AS ratio, true AS ok")
def retained_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.retained_fraction(_new(spark, sf_dir), _old(spark, sf_dir), 0.9)


@query(
    """WITH t(event_type, minimum, max_age_minutes) AS (VALUES ('view', 10, 3000), ('click', 100000, 3000), ('error', 10, 3000), ('purchase', 10, 1), ('none', 1, 1)),
s AS (SELECT event_type, count(*) AS volume, max(ts) AS newest, count(*) FILTER (value < 20) AS failures FROM events GROUP BY 1), j AS (SELECT t.*, coalesce(volume, 0) AS volume, newest, floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(newest))) / 60) AS age_minutes, CASE WHEN volume > 0 THEN round(1 - failures / volume, 6) END AS success_ratio FROM t LEFT JOIN s USING (event_type))
SELECT event_type, volume, CAST(age_minutes AS BIGINT) AS age_minutes, success_ratio, CASE WHEN volume < minimum OR newest IS NULL OR age_minutes > max_age_minutes THEN 'error' WHEN volume <= 1.25 * minimum OR success_ratio < 0.8 THEN 'degraded' ELSE 'healthy' END AS status FROM j"""
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("view", 10, 3000), ("click", 100000, 3000), ("error", 10, 3000), ("purchase", 10, 1), ("none", 1, 1)], "event_type string, minimum long, max_age_minutes long")
    return Q.health(table(spark, sf_dir, "events"), "event_type", "ts", F.col("value") < 20, t, F.lit("2024-01-31").cast("timestamp_ntz"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT p_size >= 5 THEN 'size' END, CASE WHEN NOT p_retailprice >= 1000 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS missing, p_size >= 5 AND p_retailprice >= 1000 AS passed FROM part")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.publication_gate(table(spark, sf_dir, "part"), "p_partkey", {"size": F.col("p_size") >= 5, "price": F.col("p_retailprice") >= 1000})


@query("SELECT 'small' AS reason, count(*) AS n FROM part WHERE p_size < 5 UNION ALL SELECT 'cheap', count(*) FROM part WHERE p_retailprice < 1200")
def publication_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.reason_audit(table(spark, sf_dir, "part"), "p_partkey", {"small": F.col("p_size") < 5, "cheap": F.col("p_retailprice") < 1200})


@query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'build' WHEN p_size % 3 = 1 THEN 'enrich' END AS kind, least(100.0, CASE WHEN p_size > 30 THEN 60.0 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 55.0 ELSE 0 END)::DOUBLE AS priority, array_to_string(list_filter([CASE WHEN p_size > 30 THEN 'big' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part)
SELECT kind, p_partkey, priority, reasons, CAST(row_number() OVER (PARTITION BY kind ORDER BY priority DESC, p_partkey) AS INTEGER) AS rank FROM p WHERE kind IS NOT NULL QUALIFY rank <= 25"""
)
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "build").when(F.col("p_size") % 3 == 1, "enrich")
    return Q.work_queue(table(spark, sf_dir, "part"), "p_partkey", {"big": (F.col("p_size") > 30, 60.0), "dear": (F.col("p_retailprice") > 1000, 55.0)}, 100.0, kind, 25)


@query(
    """WITH t AS (SELECT p_partkey, p_retailprice, unnest(['price', 'size']) AS topic, unnest([p_retailprice > 1000, p_size > 20]) AS green FROM part)
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place, p_partkey FROM t WHERE NOT green QUALIFY place <= 40"""
)
def enrichment_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.task_states(table(spark, sf_dir, "part"), "p_partkey", {"price": F.col("p_retailprice") > 1000, "size": F.col("p_size") > 20}, [F.desc("p_retailprice"), F.col("p_partkey")], 40)[0]


_KINDS = "CASE p_size % 3 WHEN 0 THEN 'game' WHEN 1 THEN 'edition' ELSE 'dlc' END"


@query(
    f"""WITH p AS (SELECT p_partkey, p_name, p_name || ' ' || p_type AS alias, p_partkey // 2 AS id, {_KINDS} AS kind, 1990 + p_size % 2 AS year FROM part), c AS (SELECT *, p_partkey % 6 = 0 AS known FROM p WHERE p_partkey % 2 = 0), e AS (SELECT *, p_partkey % 9 = 1 AS known FROM p WHERE p_partkey % 2 = 1),
j AS (SELECT c.p_partkey AS candidate, e.p_partkey AS entity, c.kind AS ck, e.kind AS ek, c.year <> e.year AS years, c.known AND e.known AND c.id = e.id AS same, c.alias = e.alias AS exact, c.p_name = e.p_name AS stripped FROM c JOIN e ON c.p_name = e.p_name OR (c.known AND e.known AND c.id = e.id)),
k AS (SELECT candidate, entity, CASE WHEN same THEN 1.0 WHEN years THEN 0.0 WHEN exact AND ck = ek THEN 0.98 WHEN exact AND ck <> 'dlc' AND ek <> 'dlc' THEN 0.9 WHEN stripped AND ck <> 'dlc' AND ek <> 'dlc' THEN 0.84 WHEN ck <> ek THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM j)
SELECT candidate, entity, CASE WHEN confidence >= 0.84 THEN 'match' WHEN confidence = 0.7 THEN 'ambiguous' ELSE 'none' END AS decision, confidence FROM k"""
)
def identity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, as candidates and entities by turns, some with ids; names without their type are stripped aliases."""
    kind = F.when(F.col("p_size") % 3 == 0, "game").when(F.col("p_size") % 3 == 1, "edition").otherwise("dlc")
    p = table(spark, sf_dir, "part").withColumn("kind", kind).withColumn("year", 1990 + F.col("p_size") % 2).withColumn("alias", F.concat_ws(" ", "p_name", "p_type"))
    ids = lambda known: F.when(known, F.array(F.concat(F.lit("sku:"), F.floor(F.col("p_partkey") / 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    c = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("candidate"), ids(F.col("p_partkey") % 6 == 0).alias("ids"), "alias", F.col("p_name").alias("stripped"), "kind", "year")
    e = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("entity"), ids(F.col("p_partkey") % 9 == 1).alias("ids"), F.array("alias").alias("aliases"), F.array("p_name").alias("stripped_aliases"), "kind", "year")
    return G.identity_matches(c, e)


@query("SELECT p_brand AS series, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_size, p_partkey) AS members FROM part GROUP BY 1")
def series_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("series"), "p_size", "p_partkey")
    return G.series_members(p.filter("p_partkey % 3 <> 0"), p, ["p_size"], "p_partkey")


@query("SELECT p_brand AS series, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part")
def series_member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("series"), "p_size", "p_partkey")
    return G.series_places(p.filter("p_partkey % 3 <> 0"), p, ["p_size"], "p_partkey")


@query(
    """WITH k AS (SELECT p_name || ':' || p_size AS g, p_name, p_size, p_partkey FROM part)
SELECT p_name AS title, count(*) AS records, 'game_' || substr(sha256(p_name || ':' || (2000 + p_size) || ':game'), 1, 20) AS entity FROM k GROUP BY g, p_name, p_size"""
)
def registered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate"), F.array().cast("array<string>").alias("ids"), F.col("p_name").alias("alias"), F.lit("game").alias("kind"), (2000 + F.col("p_size")).alias("year"))
    return G.register(c, F.lit(1)).select("title", "records", "entity")


@query(
    """WITH r AS (SELECT p_partkey, p_name, CASE WHEN k = 1 THEN e END AS entity FROM part LEFT JOIN (SELECT p_name AS n, count(*) AS k, min(p_partkey) AS e FROM part WHERE p_size < 8 GROUP BY 1) ON p_name = n),
m AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY p_partkey) AS n FROM r) SELECT p_partkey, entity, CASE WHEN entity IS NULL THEN 'unresolved' ELSE 'duplicate' END AS issue FROM m WHERE entity IS NULL OR n > 1"""
)
def catalogue_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.filter("p_size < 8").select(F.col("p_name").alias("k"), F.col("p_partkey").alias("entity"))
    return G.project_catalogue(G.resolve_cascade(p, [("name", "p_name", names)], "p_partkey"), "p_partkey", "entity", [F.col("p_partkey")])[1]


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_orderstatus || o_custkey AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE o_orderstatus || o_custkey END AS v FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'mismatched' END AS status FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v"""
)
def feed_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.array("o_orderstatus", F.lit("z")).alias("t"))
    b = o.filter("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 10 == 0, -1).otherwise(F.col("o_custkey")).alias("c"), F.array(F.lit("z"), "o_orderstatus").alias("t"))
    marked = [x.select("k", L.feed_signature(["c"], ["t"]).alias("s")) for x in (a, b)]
    return L.drift(*marked, "k", "s")


@query(
    """WITH r AS (SELECT event_id, user_id, event_type, floor(value) AS score, event_id % 3 = 0 AS known, event_type || ' i' || user_id % 40 || ' of s' || user_id % 40 AS title FROM events),
c AS (SELECT DISTINCT user_id AS candidate, CASE WHEN user_id % 2 = 0 THEN 'i' || user_id % 40 || ' of s' ELSE 's' || user_id % 40 || ' i' || user_id % 40 || ' more' END AS title FROM events),
k AS (SELECT r.*, candidate, CASE WHEN known THEN CASE WHEN user_id = candidate THEN 1.0 ELSE 0 END WHEN contains(r.title, c.title) THEN 1.0
  WHEN len(list_intersect(string_split(r.title, ' '), string_split(c.title, ' '))) >= 2 THEN len(list_intersect(string_split(r.title, ' '), string_split(c.title, ' '))) / len(string_split(c.title, ' ')) ELSE 0 END AS m
  FROM r JOIN c ON CASE WHEN known THEN user_id = candidate ELSE contains(r.title, c.title) OR user_id % 40 = candidate % 40 END),
m AS (SELECT *, CAST(floor(score * m + 0.5) AS BIGINT) AS w FROM k WHERE m >= 0.55)
SELECT candidate, event_type AS region, max(w) AS weight, count(DISTINCT event_id) AS events, count(DISTINCT event_id % 4) AS sources, (max(w) >= 220 AND count(DISTINCT event_id) >= 2) OR (max(w) >= 170 AND count(DISTINCT event_id % 4) >= 2) AS notable FROM m GROUP BY 1, 2"""
)
def regional_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a user as an entity, or with a title alone, for users as candidates: by id, by titles that hold another, by common tokens."""
    e = table(spark, sf_dir, "events")
    return _regional_affinity(e, e)


def _regional_affinity(events: DataFrame, users: DataFrame) -> DataFrame:
    nth = lambda c: (F.col(c) % 40).cast("string")
    title = F.concat("event_type", F.lit(" i"), nth("user_id"), F.lit(" of s"), nth("user_id"))
    rows = events.select(F.col("event_id").alias("event"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("entity"), title.alias("title"), F.split(title, " ").alias("tokens"), F.array("event_type").alias("regions"), (F.col("event_id") % 4).alias("source"), F.floor("value").alias("score"))
    name = F.when(F.col("candidate") % 2 == 0, F.concat(F.lit("i"), nth("candidate"), F.lit(" of s"))).otherwise(F.concat(F.lit("s"), nth("candidate"), F.lit(" i"), nth("candidate"), F.lit(" more")))
    c = users.select(F.col("user_id").alias("candidate")).distinct().select("candidate", F.col("candidate").alias("entity"), name.alias("title"), F.split(name, " ").alias("tokens"))
    return K.audience_totals(rows, c)


@query(r"SELECT page_id, CASE WHEN regexp_matches(t, '(?i)\bdemo\b') THEN 'demo' WHEN regexp_matches(t, '(?i)\b(soundtrack|ost)\b') THEN 'soundtrack' END AS excluded, CASE WHEN regexp_matches(t, '(?i)\b(dlc|expansion|season pass|story pack|add[- ]?on)\b') THEN CASE WHEN regexp_matches(t, '(?i)expansion') THEN 'expansion' ELSE 'dlc' END WHEN regexp_matches(t, '(?i)\b(remake|reimagined)\b') THEN 'remake' WHEN regexp_matches(t, '(?i)\b(remaster(?:ed)?|definitive edition|hd collection|anniversary edition)\b') THEN 'remaster' WHEN regexp_matches(t, '(?i)\b(deluxe|ultimate|gold|complete|collector''?s)\b') THEN 'edition' ELSE 'game' END AS kind FROM (SELECT page_id, 'Title ' || (CASE page_id % 6 WHEN 0 THEN 'demo' WHEN 1 THEN 'OST' WHEN 2 THEN 'Expansion pass' WHEN 3 THEN 'Remake' WHEN 4 THEN 'Gold' ELSE url END) AS t FROM pages)")
def title_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 6
    t = F.concat(F.lit("Title "), F.when(k == 0, "demo").when(k == 1, "OST").when(k == 2, "Expansion pass").when(k == 3, "Remake").when(k == 4, "Gold").otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", Z.excluded_kind(t).alias("excluded"), T.infer_kind(t).alias("kind"))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderstatus = 'P' AS excluded, o_orderkey % 13 = 0 AS dup, o_orderkey % 2 = 0 AS pub, CASE o_orderkey % 17 WHEN 0 THEN 'reject' WHEN 1 THEN 'approve' END AS manual, o_totalprice / 5000 AS sig FROM orders),
x AS (SELECT o_orderkey, CASE WHEN manual = 'reject' THEN 'manual_reject' WHEN manual = 'approve' THEN 'manual_approve' WHEN excluded THEN 'excluded_type' WHEN dup THEN 'duplicate_edition' WHEN NOT pub THEN 'unconfirmed' WHEN sig < 20 THEN 'insignificant' ELSE 'ok' END AS reason FROM r)
SELECT *, CASE WHEN reason IN ('ok', 'manual_approve') THEN 'public' WHEN reason IN ('unconfirmed', 'insignificant') THEN 'review' ELSE 'rejected' END AS status FROM x"""
)
def calendar_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("excluded"), (k % 13 == 0).alias("duplicate_edition"), (k % 2 == 0).alias("public_event"), F.when(k % 17 == 0, "reject").when(k % 17 == 1, "approve").alias("manual"), (F.col("o_totalprice") / 5000).alias("significance"))
    return Z.calendar_status(r).select("o_orderkey", "reason", "status")


@query(
    """SELECT user_id, CASE WHEN s >= 4 THEN 'broad' WHEN s >= 3 AND m > 0 THEN 'corroborated' WHEN s >= 2 AND t >= 2 AND m >= 100 THEN 'intense' WHEN user_id % 2 = 0 AND s >= 1 THEN 'niche_franchise' ELSE 'none' END AS notability FROM (SELECT user_id, count(DISTINCT event_type) AS s, count(DISTINCT event_id % 3) AS t, sum(value) AS m FROM events GROUP BY 1)"""
)
def notability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notability(table(spark, sf_dir, "events"))


def _notability(events: DataFrame) -> DataFrame:
    e = events.groupBy("user_id").agg(F.count_distinct("event_type").alias("sources"), F.count_distinct(F.col("event_id") % 3).alias("sites"), F.sum("value").alias("momentum"))
    return Z.notability(e.withColumn("mentions", F.col("sources")).withColumn("niche", F.col("user_id") % 2 == 0)).select("user_id", "notability")


@query(
    """WITH a AS (SELECT l_orderkey AS game, l_partkey AS name, l_suppkey AS url FROM lineitem WHERE l_returnflag <> 'N') SELECT game, count(DISTINCT (name, url)) AS n FROM a GROUP BY 1"""
)
def sourced_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ratings import awards

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_partkey").alias("name"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("url"))
    return awards(li, "game", ["name", "url"], ["name", "url"], ["name", "url"])[0].select("game", "n")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS BIGINT) WHEN k = 1 THEN e END AS base, CASE WHEN p_size % 4 = 0 THEN 'attached' WHEN k = 1 THEN 'attached' WHEN k > 1 THEN 'error' ELSE 'review' END AS outcome
FROM part LEFT JOIN (SELECT p_name AS n, count(*) AS k, min(p_partkey) AS e FROM part GROUP BY 1) ON p_name = n"""
)
def attached_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return _attached_variants(p, p)


def _attached_variants(p: DataFrame, bases: DataFrame) -> DataFrame:
    variants = p.select("p_partkey", F.col("p_name").alias("alias"), F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("long")).alias("base_hint"))
    return G.attach_variants(variants, bases.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("alias")), "p_partkey")


@query(
    """WITH a AS (SELECT p_name AS k, count(*) AS n FROM part WHERE p_partkey % 5 = 0 GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous-name' ELSE 'unresolved' END AS status, count(*) AS n FROM (SELECT a.n FROM part LEFT JOIN a ON p_name = k) GROUP BY 1"""
)
def attached_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.filter("p_partkey % 5 = 0").select(F.col("p_name").alias("k"), F.col("p_partkey").alias("entity"))
    return G.attach_articles(p, [("name", "p_name", names)], "p_partkey")


@query(
    """WITH e AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS date, 's' || l_suppkey AS source FROM lineitem), c AS (SELECT o_orderkey AS l_orderkey, CAST(o_orderdate AS DATE) + 30 AS date, 'claim' AS source FROM orders)
SELECT l_orderkey, date, list_sort(list_distinct(list(source))) AS source_ids FROM (SELECT * FROM e UNION ALL SELECT * FROM c) GROUP BY 1, 2"""
)
def claimed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claimed_events(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def _claimed_events(lines: DataFrame, orders: DataFrame) -> DataFrame:
    day, src = F.to_date("l_shipdate"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    e = lines.select("l_orderkey", day.alias("date"), day.alias("date_start"), day.alias("date_end"), F.lit("exact").alias("precision"), F.lit("worldwide").alias("region"), F.array(F.lit("PC")).alias("platforms"), F.array(src).alias("source_ids"), F.lit(0.5).alias("confidence"), F.create_map(F.lit("PC"), F.array(src)).alias("confirmations"))
    c = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.date_add(F.to_date("o_orderdate"), 30).alias("date"), F.array(F.lit("PC")).alias("platforms"), F.lit("claim").alias("source_id"))
    return Z.join_claims(e, c, "l_orderkey").select("l_orderkey", "date", "source_ids")


@query(
    """SELECT o_orderkey, (CASE WHEN o_totalprice > 100000 THEN 3.0 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 2.0 ELSE 0 END)::DOUBLE AS quality, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_totalprice < 5000 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS blocked_by, NOT (o_orderstatus = 'P' OR o_totalprice < 5000) AS shown FROM orders"""
)
def home_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    out = Z.home_quality(o, {"dear": (F.col("o_totalprice") > 100000, 3.0), "urgent": (F.col("o_orderpriority").startswith("1"), 2.0)}, {"status": F.col("o_orderstatus") == "P", "price": F.col("o_totalprice") < 5000})
    return out.select("o_orderkey", "quality", "blocked_by", "shown")


@query(
    """WITH s AS (SELECT o_orderstatus AS channel, o_orderkey, o_orderdate AS finished_at, o_orderkey % 2 = 0 AS same FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
p AS (SELECT o_orderstatus AS channel, count(*) AS publications FROM orders WHERE o_orderkey % 100 = 0 GROUP BY 1)
SELECT channel, coalesce(publications, 0) AS publications, publications IS NOT NULL AND coalesce(same AND finished_at BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-03-01', false) AS ready FROM p FULL JOIN s USING (channel)"""
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("channel", F.col("o_orderstatus"))
    pub = o.filter("o_orderkey % 100 = 0").select("channel", F.lit("published").alias("status"))
    last = o.groupBy("channel").agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    syncs = last.select("channel", F.col("r.o_orderdate").alias("finished_at"), F.lit("exact").alias("status"), F.lit("d").alias("source_digest"), F.when(F.col("r.o_orderkey") % 2 == 0, "d").otherwise("e").alias("ledger_digest"), F.lit(1).alias("source_items"), F.lit(1).alias("ledger_items"))
    return L.readiness(pub, syncs, "channel", F.lit("2001-03-01").cast("timestamp_ntz"), 59 * 24 * 60)


@query(
    """WITH e AS (SELECT l_orderkey AS cluster, count(DISTINCT l_suppkey) AS m, max(l_linenumber) AS d, max(l_quantity) * 10 AS t, l_orderkey % 3 = 0 AS official, CASE WHEN l_orderkey % 10 = 0 THEN false END AS declared FROM lineitem GROUP BY 1)
SELECT cluster, coalesce(declared, CASE WHEN official THEN m >= 1 OR d >= 2 OR t >= 300 ELSE m >= 2 OR d >= 3 OR t >= 450 END) AS global_visible, cluster % 2 = 0 AS region_visible FROM e"""
)
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.events import visibility as op

    k = F.col("cluster")
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cluster")).agg(F.count_distinct("l_suppkey").alias("media_sources"), F.max("l_linenumber").alias("mentions"), (F.max("l_quantity") * 10).alias("trend"))
    e = e.withColumns({"global_score": F.lit(0.0), "official": k % 3 == 0, "declared": F.when(k % 10 == 0, False), "regional_eligible": k % 2 == 0, "regions": F.array(F.lit("eu"))})
    return op(e, "eu").select("cluster", "global_visible", "region_visible")


@query(
    """WITH m AS (SELECT p_brand AS cluster, p_partkey, list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type]) AS t FROM part), s AS (SELECT p_partkey AS signal, list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type]) AS t, p_size AS score, p_size % 7 AS comments FROM part),
n AS (SELECT cluster, signal, max(len(list_intersect(m.t, s.t)) / least(len(m.t), len(s.t))) AS sim, any_value(score) AS score, any_value(comments) AS comments FROM m, s GROUP BY 1, 2)
SELECT cluster, count(*) AS mentions, CAST(floor(sum(8 * log10(score + 1)) + sum(10 * log10(comments + 1)) + 0.5) AS BIGINT) AS momentum FROM n WHERE sim >= 0.55 GROUP BY 1"""
)
def discussion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return _discussion(p, p)


def _discussion(members: DataFrame, signals: DataFrame) -> DataFrame:
    from ..operators.events import discussion as op

    part = lambda i: F.split_part(F.col("p_name"), F.lit(" "), F.lit(i))
    tokens = F.array_distinct(F.array(part(1), part(2), "p_type")).alias("tokens")
    signals = signals.select(F.col("p_partkey").alias("signal"), tokens, F.col("p_size").alias("score"), (F.col("p_size") % 7).alias("comments"))
    return op(members.select(F.col("p_brand").alias("cluster"), tokens), signals, "cluster", "tokens")


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 4 <> 0 THEN l_partkey END AS x FROM lineitem), b AS (SELECT l_orderkey, p_partkey AS entity FROM i JOIN part ON x = p_partkey AND p_partkey % 3 <> 0)
SELECT l_orderkey, entity, 'id' AS how FROM b
UNION ALL SELECT o_orderkey, p_partkey, 'title' FROM orders JOIN part ON contains('news of part ' || o_custkey || ' today', 'part ' || CASE WHEN p_partkey < 30 THEN p_partkey % 10 ELSE p_partkey END)
  WHERE p_partkey NOT IN (SELECT entity FROM b) AND o_orderkey % 4 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
)
def id_or_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, a quarter of them without ids; parts as entities, a third of them without, whose titles may be any digit."""
    return _id_or_title(*(table(spark, sf_dir, t) for t in ("lineitem", "orders", "part")))


def _id_or_title(lines: DataFrame, orders: DataFrame, parts: DataFrame) -> DataFrame:
    named = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    li = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_orderkey") % 4 != 0, named("l_partkey"))).alias("ids"))
    title = F.concat(F.lit("news of part "), F.col("o_custkey").cast("string"), F.lit(" today"))
    items = li.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), title.alias("title")), "l_orderkey")
    none = F.array().cast("array<string>")
    e = parts.select(F.col("p_partkey").alias("entity"), F.when(F.col("p_partkey") % 3 != 0, F.array(named("p_partkey"))).otherwise(none).alias("ids"), F.concat(F.lit("part "), F.when(F.col("p_partkey") < 30, F.col("p_partkey") % 10).otherwise(F.col("p_partkey")).cast("string")).alias("title"))
    return K.id_or_title(items, e, "l_orderkey", "ids", "title", "entity")

"""Text, address, similarity and linking queries over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import ids as I
from ..functions import text as T
from ..functions import urls as U
from ..functions.scores import normalize_score
from ..operators import catalog as C
from ..operators import events as E
from ..operators import linking as L
from ..operators import registry as G
from ..operators import releases as Z
from ..operators import similarity as S
from ..operators import topk as K
from ..operators.dedup import keep_first
from ..sources.io import page_meta
from .registry import query, spread, table

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
#: Decomposed letters: a mark behind its letter becomes a space, as it is neither letter nor digit.
_MARKED = (("àáâãäå", "a"), ("ç", "c"), ("èéêë", "e"), ("ìíîï", "i"), ("ñ", "n"), ("òóôõö", "o"), ("ùúûü", "u"), ("ýÿ", "y"))


def _decomposed(text: str) -> str:
    for letters, base in _MARKED:
        text = f"regexp_replace({text}, '[{letters}]', '{base} ', 'g')"
    return text


_KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _canonical_sql(url: str) -> str:
    base = f"regexp_extract({url}, '^(https?://[^?#]+)', 1)"
    host = f"regexp_extract({base}, '^(https?://[^/]+)', 1)"
    kept = f"list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_full_match(lower(split_part(p, '=', 1)), '(utm_.*|fbclid|gclid|yclid|ref|source)'))"
    return f"CASE WHEN {base} = '' THEN {url} ELSE lower({host}) || regexp_replace(substr({base}, length({host}) + 1), '/+$', '') || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


@query(f"SELECT page_id, {_canonical_sql('trim(url)')} AS canonical FROM pages")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, canonical FROM (SELECT page_id, {_canonical_sql('trim(url)')} AS canonical FROM pages) QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY page_id DESC) = 1")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(canonical_urls(spark, sf_dir), ["canonical"], [F.desc("page_id")])


@query(r"SELECT page_id, lower(regexp_extract(trim(url), '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, CASE WHEN regexp_matches(host, '(^|\.)news-a\.example\.com$') THEN 'editorial' WHEN regexp_matches(host, '(^|\.)example\.com$') THEN 'site' ELSE 'unknown' END AS type, CASE WHEN regexp_matches(host, '(^|\.)news-a\.example\.com$') THEN 0.8 WHEN regexp_matches(host, '(^|\.)example\.com$') THEN 0.5 ELSE 0.4 END::DOUBLE AS trust FROM pages")
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    c = U.source_class(F.col("url"), {"example.com": ("site", 0.5), "news-a.example.com": ("editorial", 0.8)})
    return p.select("page_id", U.url_host(F.col("url")).alias("host"), c.alias("c")).select("page_id", "host", "c.type", "c.trust")


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _e, _c in (("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
    _TITLE = f"regexp_replace({_TITLE}, '{_e}', '{_c}', 'g')"


@query(rf"SELECT page_id, nullif(trim(regexp_replace(regexp_replace({_TITLE}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", page_meta(F.col("html"))["title"].alias("title"))


_ENTITIES = "html"
for _e, _c in (("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
    _ENTITIES = f"regexp_replace({_ENTITIES}, '{_e}', '{_c}', 'g')"


_NUMERIC = rf"""array_to_string(list_transform(string_split({_ENTITIES}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^\d+;') THEN chr(CAST(regexp_extract(p, '^0*(\d{{1,7}});', 1) AS INTEGER)) || regexp_replace(p, '^\d+;', '') ELSE '&#' || p END), '')"""


@query(rf"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace({_NUMERIC}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of all pages, numeric entities decoded; null pages have none."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_markup(F.col("html"))).alias("text_md5"))


@query(rf"SELECT p_partkey, {_KEY.format('p_name')} AS key, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, 'game_' || substr(sha256(p_name || ':' || p_brand), 1, 20) AS id FROM part")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.norm_text(F.col("p_name")).alias("key"), I.slugify(F.col("p_name")).alias("slug"), I.stable_id("game_", F.concat_ws(":", "p_name", "p_brand")).alias("id"))


#: The key of a text whose letters are ASCII or Latin-1; SQL has no general decomposition.
_KEY_OF_TEXT = rf"trim(regexp_replace({_decomposed('lower(text)')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(rf"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(string_split({_KEY_OF_TEXT}, ' '), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t)))), ' ')) AS tokens_md5 FROM documents")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sets of all documents. A null text has no token."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.array_join(F.array_sort(T.title_tokens(T.norm_text(F.col("text")))), " ")).alias("tokens_md5"))


def _summaries_sql(most: int = 520) -> str:
    """The rules of summaries on rows of sentences; the two sentences behind the lead are the first that fit, one after the other."""
    lit = lambda pattern: "'" + pattern.replace("(?iu)", "(?i)").replace("(?isu)", "(?is)").replace("'", "''") + "'"
    has = lambda text, pattern: f"regexp_matches({text}, {lit(pattern)})"
    clean = r"regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')"
    for entity, char in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        clean = f"regexp_replace({clean}, {lit(entity)}, {lit(char)}, 'g')"
    clean = rf"trim(regexp_replace(regexp_replace({clean}, '\[\s*(?:…|\.\.\.)\s*\]', ' ', 'g'), '\s+', ' ', 'g'))"
    for pattern in T.BOILERPLATE:
        clean = f"trim(regexp_replace({clean}, {lit(pattern)}, '', 'g'))"
    words = lambda c: rf"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 4))"
    plain = "s"
    for pattern in T.OPENINGS:
        plain = f"regexp_replace({plain}, {lit(pattern)}, '', 'g')"
    signals = " + ".join(f"CASE WHEN {has('s', pattern)} THEN {n} ELSE 0 END" for pattern, n in ((T.KEY_ACTION, 5.0), (T.TIME_SIGNAL, 2.2), (T.PLATFORM_SIGNAL, 1.4), (r"\d", 1.1), (T.PROMOTIONAL_LEAD, -5.0), (T.CALL_TO_ACTION, -6.0), (T.WEAK_LEAD, -1.5)))
    return rf"""WITH d AS (SELECT doc_id, {clean} AS t, {words("coalesce(split_part(text, '.', 1), '')")} AS named FROM documents),
c AS (SELECT doc_id, named, list_filter(list_transform(regexp_extract_all(t, '([^.!?…]+(?:[.!?…]+|$))', 1), lambda s: trim(s)), lambda s: length(s) >= 24) AS cut FROM d),
x AS (SELECT doc_id, named, generate_subscripts(cut, 1) - 1 AS i, unnest(cut) AS s FROM c),
p AS (SELECT doc_id, i, {plain} AS o, greatest(0, 4 - i * CAST(0.45 AS DOUBLE)) + {signals} + CASE WHEN length(s) BETWEEN 70 AND 260 THEN 1.4 ELSE 0 END
  + least(3, coalesce(5 * CAST(len(list_intersect(named, {words("s")})) AS DOUBLE) / nullif(len(named), 0), 0)) AS points FROM x),
g AS (SELECT doc_id, i, round(points, 6) AS points, trim(upper(o[1]) || o[2:]) AS s FROM p),
good AS (SELECT * FROM g WHERE length(s) >= 24 AND NOT {has("s", T.CALL_TO_ACTION)}),
lead AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, i) = 1),
rest AS (SELECT g.*, l.s AS head FROM good g JOIN lead l USING (doc_id) WHERE g.i <> l.i AND g.points > -1),
one AS (SELECT *, head || ' ' || s AS so FROM rest WHERE length(head) + 1 + length(s) <= {most} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1),
two AS (SELECT r.*, so || ' ' || r.s AS all_of FROM rest r JOIN one o ON o.doc_id = r.doc_id AND r.i > o.i WHERE length(so) + 1 + length(r.s) <= {most} QUALIFY row_number() OVER (PARTITION BY r.doc_id ORDER BY r.i) = 1),
got AS (SELECT l.doc_id, coalesce(two.all_of, one.so, l.s) AS s, [l.i, one.i, two.i] AS took FROM lead l LEFT JOIN one USING (doc_id) LEFT JOIN two USING (doc_id)),
spare AS (SELECT g.doc_id, g.s FROM good g JOIN got USING (doc_id) WHERE NOT coalesce(list_contains(took, g.i), false) QUALIFY row_number() OVER (PARTITION BY g.doc_id ORDER BY g.i) = 1),
f AS (SELECT d.doc_id, CASE WHEN t = '' THEN '' WHEN got.s IS NULL THEN t WHEN length(got.s) < 80 AND spare.s IS NOT NULL AND length(got.s) + 1 + length(spare.s) <= {most} THEN got.s || ' ' || spare.s ELSE got.s END AS s FROM d LEFT JOIN got USING (doc_id) LEFT JOIN spare USING (doc_id)),
h AS (SELECT *, left(s, {most - 1}) AS part FROM f),
k AS (SELECT *, regexp_extract(part, '(?s)^(.*[.!?]) ', 1) AS whole, regexp_extract(part, '(?s)^(.*) ', 1) AS word FROM h)
SELECT doc_id, CASE WHEN length(s) <= {most} THEN s WHEN length(whole) - 1 >= {min(120, most * 0.45)} THEN trim(whole) ELSE trim(CASE WHEN length(word) > 80 THEN word ELSE part END) || '…' END AS summary FROM k"""


@query(_summaries_sql())
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive summaries of all documents, their first words as titles."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", T.editorial_summary(F.col("text"), F.substring_index("text", ".", 1)).alias("summary"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS INTEGER) AS words, CAST(len(regexp_extract_all(text, '[.!?](?:\s|$)')) AS INTEGER) AS sentences, CAST(len(regexp_extract_all(text, '(?i)<img\b')) AS INTEGER) AS images FROM documents")
def article_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all documents; those of a null text are null."""
    return table(spark, sf_dir, "documents").select("doc_id", T.article_metrics(F.col("text")).alias("m")).select("doc_id", "m.words", "m.sentences", "m.images")


def _alt(patterns: tuple[str, ...]) -> str:
    return "(?i)(" + ")|(".join(patterns).replace("'", "''") + ")"


@query(f"SELECT page_id, NOT regexp_matches(html, '{_alt(T.REJECT)}') AND regexp_matches(html, '{_alt(T.SIGNALS)}') AS relevant FROM pages")
def relevant_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.relevant(F.col("html")).alias("relevant"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)\\bstandard\\b') THEN 'base' END AS a, array_to_string(list_filter([CASE WHEN regexp_matches(p_type, '(?i)brass|steel') THEN 'metal' END, CASE WHEN regexp_matches(p_type, '(?i)small|medium') THEN 'size' END], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def rule_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.when(F.col("p_type").rlike(r"(?i)\bstandard\b"), "base").alias("a"), F.array_join(T.tag_by_rules(F.col("p_type"), {"metal": "brass|steel", "size": "small|medium"}), ",").alias("tags"))


@query(
    """WITH c AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) WHEN 2 THEN strftime(o_orderdate, '%B %Y') WHEN 3 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'when ready' END AS raw, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'quarter' WHEN 2 THEN 'month' WHEN 3 THEN 'year' ELSE 'tbd' END AS precision,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN d WHEN 1 THEN date_trunc('quarter', d) WHEN 2 THEN date_trunc('month', d) WHEN 3 THEN date_trunc('year', d) END AS DATE) AS date_start,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN d WHEN 1 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY WHEN 2 THEN last_day(d) WHEN 3 THEN date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY END AS DATE) AS date_end FROM c"""
)
def date_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.year(d))).when(F.col("o_orderkey") % 5 == 2, F.date_format(d, "MMMM yyyy")).when(F.col("o_orderkey") % 5 == 3, F.year(d).cast("string")).otherwise("when ready")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.parse_date_claim(raw).alias("c")).select("o_orderkey", "c.precision", "c.date_start", "c.date_end")


@query(
    """SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 3 HOUR, '%H:%M') AS minute FROM events"""
)
def publication_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, sf_dir, "events").select("event_id", D.publication_fields(text, "Europe/Moscow").alias("p")).select("event_id", "p.day", "p.minute")


_DOC_TOKENS = rf"list_distinct(list_filter(string_split({_KEY_OF_TEXT}, ' '), lambda t: length(t) >= 5))"


@query(
    rf"""WITH d AS (SELECT doc_id, {_DOC_TOKENS} AS t FROM documents),
u AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d WHERE len(t) >= 5),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n) AS nx, any_value(y.n) AS ny FROM u x JOIN u y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, CAST(shared AS INTEGER) AS shared, shared / least(nx, ny) AS similarity FROM p WHERE shared / least(nx, ny) >= 0.8"""
)
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all documents, letters of all scripts decomposed."""
    tokens = T.title_tokens(T.norm_text(F.col("text")), 5, ())
    return S.similar_pairs(table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")), "doc_id", "t", 0.8, 5)


def _part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("t"), F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 7200).alias("ts"))


@query(
    """WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part), u AS (SELECT p_partkey, len(t) AS n, unnest(t) AS w FROM p),
j AS (SELECT x.p_partkey AS a, y.p_partkey AS b, count(*) AS s, any_value(x.n) AS nx, any_value(y.n) AS ny FROM u x JOIN u y ON x.w = y.w AND x.p_partkey < y.p_partkey AND (y.p_partkey - x.p_partkey) * 2 <= 96 GROUP BY 1, 2)
SELECT a, b, s / least(nx, ny) AS similarity FROM j WHERE s / least(nx, ny) >= 0.58"""
)
def timed_similar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.timed_pairs(_part_items(spark, sf_dir), "p_partkey", "t", "ts", 96, 0.58)


@query(
    """WITH RECURSIVE p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part), u AS (SELECT p_partkey, len(t) AS n, unnest(t) AS w FROM p),
j AS (SELECT x.p_partkey AS a, y.p_partkey AS b, count(*) AS s, any_value(x.n) AS nx, any_value(y.n) AS ny FROM u x JOIN u y ON x.w = y.w AND x.p_partkey < y.p_partkey AND (y.p_partkey - x.p_partkey) * 2 <= 96 GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b, s / least(nx, ny) AS similarity FROM j WHERE s / least(nx, ny) >= 0.75),
o AS MATERIALIZED (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey DESC) AS i, coalesce(near, []) AS near FROM part LEFT JOIN (SELECT a, list(b) AS near FROM e GROUP BY a) ON a = p_partkey),
w(one, i, leaders) USING KEY (one) AS (
  SELECT 1, 0::BIGINT, []::BIGINT[]
  UNION SELECT 1, o.i, CASE WHEN list_has_any(o.near, leaders) THEN leaders ELSE list_append(leaders, o.k) END FROM w JOIN o ON o.i = w.i + 1
),
l AS (SELECT unnest(leaders) AS leader FROM w),
m AS (SELECT p_partkey, coalesce(l.leader, (SELECT arg_max(b, (similarity, b)) FROM e WHERE a = p_partkey AND b IN (SELECT leader FROM l))) AS leader FROM part LEFT JOIN l ON l.leader = p_partkey),
g AS (SELECT m.leader, count(DISTINCT p_brand) AS sources, count(*) AS items, sum(p_size % 3 + 1) AS w, max(1704067200 + p_partkey * 7200) AS newest FROM m JOIN part USING (p_partkey) GROUP BY 1)
SELECT leader, sources, items, CAST(floor((sources - 1) * 120 + w * 18 + 2 * greatest(0.0, 36 - greatest(0.0, (epoch(TIMESTAMP '2024-07-01') - newest) / 3600)) + 0.5) AS BIGINT) AS trend FROM g"""
)
def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of parts as stories: leaders newest first, scored with their suppliers as sources."""
    items = _part_items(spark, sf_dir)
    pairs = S.timed_pairs(items, "p_partkey", "t", "ts", 96, 0.75)
    led = S.leader_clusters(items.withColumn("o", -F.col("p_partkey")), pairs, "p_partkey", "o")
    members = led.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("source"), (F.col("p_size") % 3 + 1).alias("weight")), "p_partkey").join(items.select("p_partkey", "ts"), "p_partkey")
    return E.cluster_scores(members, "leader", "source", "weight", "ts", F.lit("2024-07-01").cast("timestamp")).select("leader", "sources", "items", "trend")


@query(
    """WITH e AS (SELECT l_orderkey AS cluster, l_suppkey AS source, l_linenumber = 1 AND l_orderkey % 3 = 0 AS official, l_quantity * 10 AS trend, l_quantity * 8 AS global_score, l_tax * 1000 AS regional, l_linenumber AS mentions, l_shipdate AS ts FROM lineitem),
g AS (SELECT cluster, max(trend) AS trend, max(global_score) AS global_score, max(regional) AS regional, max(mentions) AS mentions, count(DISTINCT source) FILTER (NOT official) AS media_sources, bool_or(official) AS official, max(ts) AS published FROM e GROUP BY 1),
k AS (SELECT *, media_sources >= 2 OR mentions >= 3 OR trend >= 450 OR global_score >= 450 OR (official AND (media_sources >= 1 OR mentions >= 2 OR trend >= 300 OR global_score >= 300)) AS global_eligible, regional > 0 AS regional_eligible, trend >= 700 OR media_sources >= 6 OR mentions >= 7 OR global_score >= 700 AS critical FROM g)
SELECT cluster, media_sources, global_eligible, regional_eligible, CASE WHEN critical THEN 'critical' WHEN global_eligible OR regional >= 250 THEN 'major' ELSE 'normal' END AS importance,
  global_score + trend + media_sources * 120 + mentions * 80 + regional + CASE WHEN official THEN 80 ELSE 0 END AS editorial_score,
  CASE WHEN official AND media_sources > 0 THEN 'confirmed' WHEN official THEN 'official' ELSE 'ranked' END AS type,
  CASE WHEN global_eligible OR regional_eligible THEN CASE WHEN critical THEN 168 WHEN global_eligible THEN 72 ELSE 48 END END AS home_hours FROM k"""
)
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_orderkey").alias("cluster"), F.concat_ws("-", F.lit("http://x"), "l_orderkey", "l_linenumber").alias("url"), F.col("l_suppkey").alias("source"), ((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 3 == 0)).alias("official"), (F.col("l_quantity") * 10).alias("trend"), (F.col("l_quantity") * 8).alias("global_score"), (F.col("l_tax") * 1000).alias("regional"), F.col("l_linenumber").alias("mentions"), F.array("l_returnflag").alias("regions"), F.col("l_shipdate").alias("ts"), F.col("l_linestatus").alias("title"))
    return E.eligibility(E.roll_up(items, "cluster")).select("cluster", "media_sources", "global_eligible", "regional_eligible", "importance", "editorial_score", "type", "home_hours")


@query(
    """WITH x AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS sources, max(l_linenumber) AS mentions, sum(l_quantity) AS trend FROM lineitem GROUP BY 1)
SELECT id, sources >= 3 OR mentions >= 3 OR trend >= 450 AS global_eligible, CASE WHEN sources >= 3 OR mentions >= 3 OR trend >= 450 THEN trend + 90 * sources + 35 * mentions ELSE 0 END AS global_score, 170 + 0.45::DOUBLE * trend + 35 * sources AS regional_score, sources >= 6 OR mentions >= 7 OR trend >= 700 AS super FROM x"""
)
def industry_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count_distinct("l_orderkey").alias("sources"), F.max("l_linenumber").alias("mentions"), F.sum("l_quantity").alias("trend"))
    return E.industry_eligibility(t).select("id", "global_eligible", "global_score", "regional_score", "super")


@query(
    r"""WITH b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
a AS (SELECT array_to_string(w[1:5], ' ') AS phrase, count(DISTINCT item_id) AS n, min(item_id) AS e FROM b WHERE len(w) >= 5 GROUP BY 1),
r AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d))
SELECT doc_id, phrase, CASE WHEN n = 1 THEN e END AS entity, CASE WHEN n = 1 THEN 'linked' ELSE 'ambiguous-phrase' END AS status FROM r JOIN a USING (phrase)"""
)
def phrase_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    b = table(spark, sf_dir, "benchmark").select(words("text").alias("w"), F.col("item_id").alias("entity")).filter(F.size("w") >= 5)
    aliases = b.select(F.array_join(F.slice("w", 1, 5), " ").alias("alias"), "entity")
    return L.link_by_phrase(table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w")), aliases, "doc_id", F.col("w"), 5).select("doc_id", "phrase", "entity", "status")


@query(
    """WITH n AS (SELECT DISTINCT p_partkey, unnest([p_name, p_brand]) AS name FROM part),
a AS (SELECT p_name AS name, count(DISTINCT p_type) AS k, min(p_type) AS e FROM part WHERE p_partkey % 10 = 0 GROUP BY 1)
SELECT p_partkey, name, CASE WHEN k = 1 THEN e END AS entity, CASE WHEN k = 1 THEN 'linked' WHEN k > 1 THEN 'ambiguous-explicit-name' ELSE 'unknown-explicit-game' END AS status FROM n LEFT JOIN a USING (name)"""
)
def alias_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    aliases = p.filter("p_partkey % 10 = 0").select(F.col("p_name").alias("alias"), F.col("p_type").alias("entity"))
    return L.link_by_name(p.select("p_partkey", F.array("p_name", "p_brand").alias("names")), aliases, "p_partkey", "names")


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey, 'part:' || l_partkey AS x FROM lineitem), e AS (SELECT DISTINCT l_suppkey AS entity, 'part:' || l_partkey AS x FROM lineitem)
SELECT DISTINCT l_orderkey, entity FROM i JOIN e USING (x)"""
)
def external_id_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return _external_id_link(li, li)


def _external_id_link(items: DataFrame, entities: DataFrame) -> DataFrame:
    ids = F.collect_set(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("ids")
    return L.link_by_id(items.groupBy("l_orderkey").agg(ids), entities.groupBy(F.col("l_suppkey").alias("entity")).agg(ids), "l_orderkey", "ids", "entity")


@query(
    """WITH r AS (SELECT p_partkey, p_name, p_brand, p_type FROM part), a AS (SELECT p_name AS k, count(DISTINCT p_partkey) AS n, min(p_partkey) AS e FROM part WHERE p_size < 5 GROUP BY 1), b AS (SELECT p_brand || p_type AS k, count(DISTINCT p_partkey) AS n, min(p_partkey) AS e FROM part WHERE p_size < 3 GROUP BY 1)
SELECT r.p_partkey, CASE WHEN a.n = 1 THEN a.e WHEN a.n > 1 THEN NULL WHEN b.n = 1 THEN b.e END AS entity, CASE WHEN a.n = 1 THEN 'name' WHEN a.n > 1 THEN 'ambiguous-name' WHEN b.n = 1 THEN 'kind' WHEN b.n > 1 THEN 'ambiguous-kind' ELSE 'unresolved' END AS how FROM r LEFT JOIN a ON r.p_name = a.k LEFT JOIN b ON r.p_brand || r.p_type = b.k"""
)
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("kind", F.concat("p_brand", "p_type"))
    names = p.filter("p_size < 5").select(F.col("p_name").alias("k"), F.col("p_partkey").alias("entity"))
    kinds = p.filter("p_size < 3").select(F.col("kind").alias("k"), F.col("p_partkey").alias("entity"))
    return G.resolve_cascade(p, [("name", "p_name", names), ("kind", "kind", kinds)], "p_partkey")


@query(
    """WITH f AS (SELECT DISTINCT p_partkey AS e, unnest(['name', 'name', 'brand', 'type', 'type', 'type']) AS field, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand, split_part(p_type, ' ', 1), split_part(p_type, ' ', 2), split_part(p_type, ' ', 3)]) AS token FROM part),
z AS (SELECT * FROM f WHERE token <> ''),
n AS (SELECT e, field, count(*) AS n FROM z GROUP BY 1, 2), s AS (SELECT x.e AS a, y.e AS b, x.field, count(*) AS k FROM z x JOIN z y ON x.field = y.field AND x.token = y.token AND x.e <> y.e GROUP BY 1, 2, 3),
o AS (SELECT s.a, s.b, s.field, k / CASE WHEN s.field = 'type' THEN greatest(p.n, q.n) ELSE least(p.n, q.n) END AS overlap, CASE s.field WHEN 'name' THEN 0.4 WHEN 'brand' THEN 0.25 ELSE 0.35 END::DOUBLE AS w FROM s JOIN n p ON s.a = p.e AND s.field = p.field JOIN n q ON s.b = q.e AND s.field = q.field),
g AS (SELECT a, b, round(sum(round(w * overlap, 9)), 6) AS score, coalesce(string_agg(field, ',' ORDER BY round(w * overlap, 9) DESC, field) FILTER (overlap >= 0.35), '') AS reasons FROM o GROUP BY 1, 2)
SELECT a, b, score, reasons, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS rank FROM g WHERE score >= 0.34 QUALIFY rank <= 6"""
)
def similar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar_parts(table(spark, sf_dir, "part"))


def _similar_parts(p: DataFrame) -> DataFrame:
    long = None
    for field, column in (("name", "p_name"), ("brand", "p_brand"), ("type", "p_type")):
        tokens = F.array(*(F.split_part(F.col(column), F.lit(" "), F.lit(i)) for i in range(1, 3 if field == "name" else 4))) if field != "brand" else F.array(column)
        one = p.select(F.col("p_partkey").alias("entity"), F.lit(field).alias("field"), F.explode(tokens).alias("token"))
        long = one if long is None else long.unionByName(one)
    return S.profile_neighbours(long, {"name": (0.4, "min"), "brand": (0.25, "min"), "type": (0.35, "max")}, 0.34, 6)


@query(
    """SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE contains(lower(p_name || ' ' || p_type), 'bolt') AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#3') AND p_size >= 10 AND p_size <= 40 ORDER BY p_retailprice DESC, p_partkey LIMIT 50"""
)
def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(table(spark, sf_dir, "part"), ["p_name", "p_type"], "bolt", {"p_brand": ["Brand#11", "Brand#22", "Brand#3"]}, {"p_size": (10, 40)}, [F.desc("p_retailprice"), F.col("p_partkey")], 50)


@query("""SELECT label, count(p_partkey) AS n FROM (SELECT unnest(['Brand#11', 'Brand#12', 'Brand#99']) AS label) LEFT JOIN part ON p_brand = label GROUP BY 1""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facet_counts(table(spark, sf_dir, "part"), "p_brand", ["Brand#11", "Brand#12", "Brand#99"])


@query(
    """WITH a AS (SELECT p_partkey, p_retailprice, list_distinct([p_brand, split_part(p_type, ' ', 1), split_part(p_type, ' ', 3)]) AS t FROM part),
pr(profile, attribute, points, otherwise) AS (VALUES ('a', 'Brand#11', 22.0, -10.0), ('a', 'STEEL', 24.0, 0.0), ('b', 'PROMO', 18.0, -16.0), ('b', 'BRASS', -34.0, 0.0), ('b', 'COPPER', 12.0, 0.0)),
q AS (SELECT profile, sum(otherwise) AS o FROM pr GROUP BY 1), m AS (SELECT profile, p_partkey, sum(points - otherwise) AS p, string_agg(attribute, ',' ORDER BY attribute) FILTER (points > 0) AS reasons FROM (SELECT p_partkey, unnest(t) AS attribute FROM a) JOIN pr USING (attribute) GROUP BY 1, 2)
SELECT profile, p_partkey, round(CAST(p + o + p_retailprice / 100 AS DOUBLE), 6) AS score, coalesce(reasons, '') AS reasons, CAST(row_number() OVER (PARTITION BY profile ORDER BY round(CAST(p + o + p_retailprice / 100 AS DOUBLE), 6) DESC, p_partkey) AS INTEGER) AS rank FROM m JOIN q USING (profile) JOIN a USING (p_partkey) WHERE p + o + p_retailprice / 100 > 0 QUALIFY rank <= 6"""
)
def preference_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.array("p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)), F.split_part("p_type", F.lit(" "), F.lit(3))).alias("attributes"))
    rows = [("a", "Brand#11", 22.0, -10.0), ("a", "STEEL", 24.0, 0.0), ("b", "PROMO", 18.0, -16.0), ("b", "BRASS", -34.0, 0.0), ("b", "COPPER", 12.0, 0.0)]
    return C.recommend(p, spark.createDataFrame(rows, "profile string, attribute string, points double, otherwise double"), "p_partkey", F.col("p_retailprice") / 100)


@query(
    """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, [c_mktsegment] AS tags FROM customer), y AS (SELECT c_custkey, n_name AS name, [n_name, c_mktsegment] AS tags FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0)
SELECT x.c_custkey, coalesce(nullif(x.name, ''), nullif(y.name, '')) AS name, list_sort(list_distinct(list_concat(x.tags, coalesce(y.tags, [])))) AS tags FROM x LEFT JOIN y USING (c_custkey)"""
)
def layered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    first = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.array("c_mktsegment").alias("tags"))
    second = c.filter("c_custkey % 2 = 0").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"), F.array("n_name", "c_mktsegment").alias("tags"))
    return C.merge_layers([first, second], "c_custkey", ["name"], ["tags"])


@query(
    """SELECT l_partkey, count(*) AS n, floor(sum(greatest(0.0, least(100.0, l_quantity / 50 * 100)) * greatest(0.1, l_discount * 10)) / sum(greatest(0.1, l_discount * 10)) * 10 + 0.5) / 10 AS score FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1"""
)
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ratings import weighted_score as op

    return op(table(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_quantity"), F.lit(50.0), F.col("l_discount") * 10, F.col("l_returnflag") != "R", [F.col("_metadata.file_path"), F.col("_metadata.row_index")])


@query("""WITH o AS (SELECT source, doc_id % 7 AS s, max(CAST(quality * 50 + n_chars % 50 AS DOUBLE)) AS v FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), g AS (SELECT source, count(*) AS sources, median(v) AS m FROM o GROUP BY 1) SELECT source, sources, CASE WHEN sources >= 3 THEN m END AS median, CASE WHEN sources >= 3 THEN m / 10 END AS score FROM g""")
def critic_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ratings import critic_median as op

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return op(d.select("source", (F.col("doc_id") % 7).alias("s"), (F.col("quality") * 50 + F.col("n_chars") % 50).cast("double").alias("v")), "source", "s", "v")


@query("""SELECT l_partkey, count(*) AS votes, floor(avg(l_linenumber) * 100 + 0.5) / 100 AS mean FROM lineitem WHERE l_linenumber BETWEEN 1 AND 10 GROUP BY 1""")
def vote_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ratings import vote_totals as op

    return op(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity) = 1), r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, v) <= 4)
SELECT l_orderkey, count(*) AS sources, avg(v) AS mean, CASE WHEN count(*) >= 3 THEN 'green' ELSE 'red' END AS status FROM r GROUP BY 1""")
def publication_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ratings import publication_mean as op

    return op(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey", "l_suppkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")], "l_quantity", 3, 4)


@query(
    """WITH RECURSIVE r AS (SELECT l_orderkey AS g, l_linenumber AS o, CAST(l_partkey AS VARCHAR) AS url, l_suppkey % 5 AS p, l_returnflag = 'R' AS blocked, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), l_suppkey % 5, l_returnflag = 'R') AS i FROM lineitem),
w AS (SELECT g, 0::BIGINT AS i, 0 AS o, '' AS url, '' AS reason, []::VARCHAR[] AS us, []::BIGINT[] AS ps FROM (SELECT DISTINCT g FROM r)
  UNION ALL SELECT g, i, o, url, reason, CASE WHEN reason = '' THEN list_append(us, url) ELSE us END, CASE WHEN reason = '' THEN list_append(ps, p) ELSE ps END
  FROM (SELECT r.*, us, ps, CASE WHEN blocked THEN 'blocked' WHEN list_contains(us, r.url) THEN 'duplicate_url' WHEN list_contains(ps, r.p) THEN 'duplicate_publication' WHEN len(us) >= 3 THEN 'maximum' ELSE '' END AS reason FROM w JOIN r ON r.g = w.g AND r.i = w.i + 1))
SELECT g AS l_orderkey, o AS l_linenumber, url, reason = '' AS accepted, reason FROM w WHERE i > 0"""
)
def accepted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as sources: parts as addresses, suppliers as publications, three at most."""
    from ..operators.ratings import accept_sources as op

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("url"), (F.col("l_suppkey") % 5).alias("publication"), (F.col("l_returnflag") == "R").alias("blocked"))
    return op(rows, "l_orderkey", "l_linenumber", 3)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 40 THEN l_quantity / 40 * 10 END AS ten, CASE l_returnflag WHEN 'A' THEN 9.5 ELSE CASE WHEN l_quantity <= 40 THEN NULL END END::DOUBLE AS graded FROM lineitem""")
def normalized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", normalize_score(F.col("l_quantity"), F.lit(40.0)).alias("ten"), normalize_score(F.lit(None).cast("double"), F.lit(10.0), F.col("l_returnflag")).alias("graded"))


@query("""SELECT o_orderdate::DATE AS day, count(*) AS releases, count(*) FILTER (o_orderstatus = 'F') AS n_public FROM orders GROUP BY 1 ORDER BY releases DESC, day LIMIT 10""")
def dense_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", "public").otherwise("x").alias("s"))
    return Z.dense_days(o, "day", "s")


@query(
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 10000 END AS p, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 + 1 END AS s, o_orderkey % 7 AS n, o_orderkey % 4 AS f FROM orders)
SELECT o_orderkey, round(least(40.0, coalesce(p, 0)) + CASE WHEN s IS NOT NULL THEN greatest(0.0, 30 - 1.25 * (s - 1)) ELSE 0 END + least(36.0, 6.0 * n) + least(16.0, 5.0 * f), 6)::DOUBLE AS anticipation,
  coalesce(p, 0) >= 30 OR coalesce(s <= 12, false) OR n >= 4 OR (n >= 2 AND f >= 2) OR coalesce(s <= 30, false) AND n >= 1 AS eligible FROM x"""
)
def anticipation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, F.col("o_totalprice") / 10000).alias("popularity"), F.when(k % 3 == 0, k % 40 + 1).alias("steam_position"), (k % 7).alias("publications"), (k % 4).alias("families"))
    return Z.anticipation(rows).select("o_orderkey", "anticipation", "eligible")


@query(
    """WITH e AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS date, l_returnflag AS platform, 's' || l_suppkey AS source, l_discount AS confidence FROM lineitem)
SELECT l_orderkey, date, list_sort(list_distinct(list(platform))) AS platforms, list_sort(list_distinct(list(source))) AS source_ids, max(confidence) AS confidence, true AS public FROM e GROUP BY 1, 2"""
)
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    day = F.to_date("l_shipdate")
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("date"), day.alias("date_start"), day.alias("date_end"), F.lit("exact").alias("precision"), F.lit("worldwide").alias("region"), F.array("l_returnflag").alias("platforms"), F.array(src).alias("source_ids"), F.col("l_discount").alias("confidence"), F.create_map(F.col("l_returnflag"), F.array(src)).alias("confirmations"))
    return Z.merge_events(e, "l_orderkey").select("l_orderkey", "date", "platforms", "source_ids", "confidence", Z.is_public(F.col("platforms"), F.col("confirmations")).alias("public"))


@query(
    """WITH p AS (SELECT user_id, avg(value) AS popularity, row_number() OVER (ORDER BY avg(value) DESC, user_id) AS position FROM events GROUP BY 1)
SELECT c_custkey, round(greatest(0.0, least(100.0, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 100 END, c_acctbal / 50 / 1.22))), 4)::DOUBLE AS overall, round(greatest(0.0, least(100.0, CASE WHEN popularity IS NULL THEN NULL ELSE 0.7::DOUBLE * (2.5 * popularity) + 0.3::DOUBLE * (101 - position) END)), 4) AS players FROM customer LEFT JOIN p ON c_custkey = user_id"""
)
def expectation_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.avg("value").alias("popularity"))
    p = K.places(g, [], [F.desc("popularity"), F.col("c_custkey")], "position")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") / 100).alias("expected"), (F.col("c_acctbal") / 50).alias("anticipation"))
    return Z.expectation_ratings(c, p, "c_custkey").withColumn("players", F.when(F.col("players").isNotNull(), F.col("players")))


_TERMS, _DOMAINS = ["walkthrough", "guide"], ["shop.example", "wiki.example"]


@query(
    """WITH RECURSIVE l AS (SELECT l_orderkey AS g, l_linenumber AS o, l_partkey, l_suppkey, l_returnflag, l_quantity, l_tax FROM lineitem),
s AS (SELECT g, o, 'https://' || CASE WHEN l_suppkey % 7 = 0 THEN 'www.shop.example' WHEN l_suppkey % 11 = 0 THEN 'a.wiki.example' ELSE 'p' || l_suppkey % 5 || '.example' END || CASE WHEN l_partkey % 9 = 0 THEN '/front' ELSE '/reviews/' || l_partkey % 8 END AS url, 'p' || l_suppkey % 5 AS publication,
  CASE WHEN l_partkey % 13 = 0 THEN 'A Walkthrough' ELSE 'A review' END AS title, CASE WHEN l_quantity > 5 THEN l_quantity END AS score, CASE WHEN l_quantity > 45 THEN 0 ELSE 50 END AS scale, CASE WHEN l_quantity > 48 THEN 'B+' ELSE '' END AS grade FROM l),
t AS (SELECT *, list_filter([CASE WHEN contains(lower(title || ' ' || url), 'walkthrough') OR contains(lower(title || ' ' || url), 'guide') THEN 'forbidden_term' WHEN url LIKE 'https://www.shop.example/%' OR url LIKE 'https://a.wiki.example/%' THEN 'forbidden_domain' END, CASE WHEN url LIKE '%/front' THEN 'shallow_path' END, CASE WHEN NOT (score IS NOT NULL AND scale > 0) AND grade = '' THEN 'no_score' END], lambda x: x IS NOT NULL) AS own FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, url, publication, own) AS i FROM t),
w AS (SELECT g, 0::BIGINT AS i, 0 AS o, '' AS url, '' AS reason, []::VARCHAR[] AS us, []::VARCHAR[] AS ps FROM (SELECT DISTINCT g FROM r)
  UNION ALL SELECT g, i, o, url, reason, CASE WHEN reason = '' THEN list_append(us, url) ELSE us END, CASE WHEN reason = '' THEN list_append(ps, publication) ELSE ps END
  FROM (SELECT z.*, CASE WHEN all_of <> '' THEN all_of WHEN len(us) >= 3 THEN 'maximum' ELSE '' END AS reason FROM (SELECT r.*, us, ps, array_to_string(list_concat(list_filter([CASE WHEN list_contains(us, r.url) THEN 'duplicate_url' END, CASE WHEN list_contains(ps, r.publication) THEN 'duplicate_publication' END], lambda x: x IS NOT NULL), own), ',') AS all_of FROM w JOIN r ON r.g = w.g AND r.i = w.i + 1) AS z)),
d AS (SELECT g, count(*) FILTER (reason = '') AS accepted, count(*) FILTER (reason = '' AND url NOT LIKE '%/0') AS contemporary, string_agg(reason, ';' ORDER BY o, url, reason) AS reasons FROM w WHERE i > 0 GROUP BY g)
SELECT g AS l_orderkey, accepted, contemporary, accepted >= 2 AND contemporary >= least(2, accepted) AS green, greatest(0, 2 - accepted) AS needs_more, reasons FROM d"""
)
def source_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its sources, each with the reasons against it; orders are green by their counts."""
    from ..operators import ratings as R

    host = F.when(F.col("l_suppkey") % 7 == 0, "www.shop.example").when(F.col("l_suppkey") % 11 == 0, "a.wiki.example").otherwise(F.concat(F.lit("p"), F.col("l_suppkey") % 5, F.lit(".example")))
    path = F.when(F.col("l_partkey") % 9 == 0, "/front").otherwise(F.concat(F.lit("/reviews/"), F.col("l_partkey") % 8))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("https://"), host, path).alias("url"), F.concat(F.lit("p"), F.col("l_suppkey") % 5).alias("publication"), F.when(F.col("l_partkey") % 13 == 0, "A Walkthrough").otherwise("A review").alias("title"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("score"), F.when(F.col("l_quantity") > 45, 0).otherwise(50).alias("scale"), F.when(F.col("l_quantity") > 48, "B+").otherwise("").alias("grade"),
    )
    rows = rows.withColumn("reasons", R.source_reasons(_TERMS, _DOMAINS))
    decided = R.accept_sources(rows, "l_orderkey", "l_linenumber", 3)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "url", "reason"))), lambda x: x["reason"]), ";")
    return R.source_gate(decided, "l_orderkey", ~F.col("url").endswith("/0"), 2, 2).join(decided.groupBy("l_orderkey").agg(listed.alias("reasons")), "l_orderkey")


@query(
    """WITH t AS (SELECT c_custkey AS profile, lower(c_mktsegment || ' wants ' || CASE c_custkey % 4 WHEN 0 THEN 'steel and large ones' WHEN 1 THEN 'a hot ring, small or promo' WHEN 2 THEN 'economy bolts of brand#7, no hot ones' ELSE 'nothing' END) AS text FROM customer),
n(field, place, needle, value) AS (VALUES ('size', 1, 'large', 'LARGE'), ('size', 2, 'small', 'SMALL'), ('size', 3, 'economy', 'ECONOMY'), ('size', 4, 'promo', 'PROMO'), ('brand', 1, 'brand#7', 'Brand#7'), ('avoid', 1, 'no hot', 'hot'), ('avoid', 2, 'nothing', 'bolt')),
m AS (SELECT profile, field, arg_max(value, place) AS value FROM t JOIN n ON contains(text, needle) GROUP BY 1, 2),
a AS (SELECT p_partkey, p_retailprice, list_distinct([p_brand, p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS attributes, list_distinct([lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2)), lower(p_type)]) AS tokens FROM part),
pr AS (SELECT profile, value AS attribute, CASE field WHEN 'size' THEN 24.0 WHEN 'brand' THEN 22.0 ELSE -34.0 END AS points, CASE field WHEN 'brand' THEN -100.0 ELSE 0.0 END AS otherwise FROM m),
o AS (SELECT profile, sum(otherwise) AS o FROM pr GROUP BY 1),
g AS (SELECT profile, p_partkey, sum(points - otherwise) AS p, string_agg(attribute, ',' ORDER BY attribute) FILTER (points > 0) AS reasons FROM (SELECT p_partkey, unnest(attributes) AS attribute FROM a) JOIN pr USING (attribute) GROUP BY 1, 2),
w AS (SELECT profile, p_partkey, 5.0 * count(*) AS bonus FROM t JOIN (SELECT p_partkey, unnest(tokens) AS token FROM a) ON contains(text, token) GROUP BY 1, 2),
z AS (SELECT profile, p_partkey, round(CAST(coalesce(p, 0) + coalesce(bonus, 0) + o + p_retailprice / 1000 AS DOUBLE), 6) AS score, coalesce(reasons, '') AS reasons FROM g FULL JOIN w USING (profile, p_partkey) JOIN o USING (profile) JOIN a USING (p_partkey))
SELECT profile, p_partkey, score, reasons, CAST(row_number() OVER (PARTITION BY profile ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM z WHERE score > 0 QUALIFY rank <= 6"""
)
def preference_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers ask for in their own words, against all parts: needles make profiles, words that a part is named by give points."""
    c = table(spark, sf_dir, "customer")
    i = F.col("c_custkey") % 4
    words = F.when(i == 0, "steel and large ones").when(i == 1, "a hot ring, small or promo").when(i == 2, "economy bolts of brand#7, no hot ones").otherwise("nothing")
    texts = c.select(F.col("c_custkey").alias("profile"), F.concat("c_mktsegment", F.lit(" wants "), words).alias("text"))
    needles = spark.createDataFrame([("size", 1, "large", "LARGE"), ("size", 2, "small", "SMALL"), ("size", 3, "economy", "ECONOMY"), ("size", 4, "promo", "PROMO"), ("brand", 1, "brand#7", "Brand#7"), ("avoid", 1, "no hot", "hot"), ("avoid", 2, "nothing", "bolt")], "field string, place int, needle string, value string")
    field = F.col("field")
    name = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    catalog = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.array("p_brand", "p_type", name(1), name(2)).alias("attributes"), F.array(name(1), name(2), F.col("p_type")).alias("tokens"))

    def best(texts: DataFrame) -> DataFrame:
        profiles = C.infer_profiles(texts, needles).select("profile", F.col("value").alias("attribute"), F.when(field == "size", 24.0).when(field == "brand", 22.0).otherwise(-34.0).alias("points"), F.when(field == "brand", -100.0).otherwise(0.0).alias("otherwise"))
        return C.recommend(catalog, profiles, "p_partkey", F.col("p_retailprice") / 1000, 6, C.token_bonus(catalog, texts, "p_partkey", "tokens"))

    return C.each_text(texts, best)

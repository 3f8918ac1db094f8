"""Queries of names of titles, over documents and pages, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names as N
from .registry import query, spread, table


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(_lit, names)) + ")"


def _key(text: str) -> str:
    """Letters that decompose get a blank for their mark."""
    return f"trim(regexp_replace(lower(strip_accents(regexp_replace({text}, '([À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ])', '\\1 ', 'g'))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _found(patterns: tuple, cut: bool) -> str:
    """m: matches of items(k, title, summary, url) with order, number, place, name and key."""
    marked = " UNION ALL ".join(f"SELECT k, {o} AS o, '{kind}' AS kind, {points} AS points, string_split(regexp_replace({text}, {_lit(p)}, chr(1) || '\\0' || chr(2) || '\\1' || chr(3), 'g'), chr(1)) AS p FROM items" for o, (kind, text, p, points) in enumerate(patterns) if not text.startswith("other"))
    name = "regexp_replace(raw, '[“”«»\"()\\[\\]{}]', ' ', 'g')"
    name = f"regexp_replace({name}, '[.!?]\\s+[A-ZА-ЯЁ][\\s\\S]*$', '')" if cut else name
    return f"""n AS (SELECT k, title, lower(title) AS low, ' ' || {_key("title")} || ' ' AS nt, ' ' || {_key("summary")} || ' ' AS ns, ' ' || {_key(r"coalesce(url_decode(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)(\?[^#]*)?.*$', '\1 \2')), '')")} || ' ' AS nu FROM items),
parts AS (SELECT k, o, kind, points, generate_subscripts(p, 1) AS j, unnest(p) AS part FROM ({marked})),
raws AS (SELECT *, split_part(split_part(part, chr(3), 1), chr(2), 2) AS raw FROM parts),
placed AS (SELECT *, sum(CASE WHEN j = 1 THEN length(part) ELSE length(part) - 2 - length(raw) END) OVER (PARTITION BY k, o ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place FROM raws),
named AS (SELECT k, o, kind, points, j, place, trim(regexp_replace(regexp_replace({name}, '^[\\s:;,.!?–—-]+|[\\s:;,.!?–—-]+$', '', 'g'), '\\s+', ' ', 'g')) AS name FROM placed WHERE j > 1),
m AS (SELECT *, {_key("name")} AS norm FROM named)"""


def _count(text: str) -> str:
    return f"((length({text}) - length(replace({text}, ' ' || norm || ' ', ''))) // (length(norm) + 2))"


_NAME = "(array_agg(name ORDER BY length(name) DESC, o, j))[1] AS name, min(place) AS place"
_EVIDENCE = f"""e AS (SELECT f.*, {_count("nt")} AS ct, {_count("ns")} AS cs, {_count("nu")} AS cu, title, position(lower(name) IN low) AS pos FROM f JOIN n USING (k)),
b AS (SELECT *, CASE WHEN pos > 0 THEN right(left(title, CAST(pos - 1 AS BIGINT)), %d) END AS before FROM e)"""
_ORDER = "ORDER BY score DESC, place, length(name) DESC, norm"


def _context_sql(items: str) -> str:
    fit = f"CASE WHEN norm IN {_in(N.CONTEXT_GENERIC)} THEN false WHEN anchor THEN cs > 0 AND score >= 180 WHEN NOT contains(norm, ' ') THEN ct > 0 AND cs > 0 AND cu > 0 AND score >= 250 ELSE ct > 0 AND (cs > 0 OR cu > 0) AND score >= 210 END"
    return f"""WITH items AS ({items}), {_found(N.CONTEXT_PATTERNS, False)},
f AS (SELECT k, norm, {_NAME}, bool_or(kind = 'colon' OR (kind IN ('anchor', 'leading') AND contains(name, ':'))) AS colon, bool_or(kind = 'anchor') AS anchor, bool_or(kind = 'leading' OR (o < 2 AND place = 0)) AS begins, bool_or(kind = 'leading') AS heads
  FROM m WHERE length(norm) >= 4 AND NOT regexp_matches(norm, '^\\d+$') AND norm NOT IN {_in(N.CONTEXT_NO_TITLE)} AND NOT regexp_matches(name, {_lit(N.CONTEXT_SUFFIX)}) GROUP BY k, norm),
{_EVIDENCE % 45},
s AS (SELECT *, 110 * CAST(ct > 0 AS INT) + 65 * CAST(cs > 0 AS INT) + 85 * CAST(cu > 0 AS INT) + least(60, 12 * (ct + cs + cu)) + 55 * CAST(colon AS INT) + 75 * CAST(anchor AS INT) + 30 * CAST(begins AS INT) + 35 * CAST(heads AS INT)
  - 150 * CAST(coalesce(regexp_matches(before, {_lit(N.CONTEXT_COMPARISON)}), false) AS INT) - 100 * CAST(regexp_matches(title, {_lit(N.CONTEXT_UPDATE)}) AND coalesce(regexp_matches(right(before, 3), '[-–—]\\s*$'), false) AS INT) AS score FROM b),
g AS (SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s l WHERE l.k = a.k AND length(l.norm) > length(a.norm) AND contains(' ' || l.norm || ' ', ' ' || a.norm || ' ') AND (l.colon OR l.anchor OR l.score >= a.score - 10))),
r AS (SELECT *, row_number() OVER (PARTITION BY k {_ORDER}) AS rank, {fit} AS eligible FROM g),
t AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS after FROM r WINDOW w AS (PARTITION BY k, eligible ORDER BY rank))
SELECT k, name AS candidate, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank, eligible, eligible AND nth = 1 AND (after IS NULL OR score - after >= 22) AS accepted, least(0.94, 0.78 + CAST(score AS DOUBLE) / 1600) AS confidence FROM t"""


def _primary_sql(items: str) -> str:
    tail = f"SELECT k, title, trim(regexp_replace(regexp_replace(summary, {_lit(N.FEED_TAIL)}, ''), '\\s+', ' ', 'g')) AS summary, url FROM ({items})"
    return f"""WITH items AS ({tail}), {_found(N.PRIMARY_PATTERNS, True)},
f AS (SELECT k, norm, {_NAME}, sum(points) AS points, bool_or(kind IN ('title-cue', 'summary-cue', 'summary-in', 'summary-leading')) AS strong, bool_or(kind = 'title-colon') AS colon
  FROM m JOIN (SELECT k, nt FROM n) USING (k) WHERE (kind <> 'summary-in' OR contains(nt, ' ' || norm || ' ') OR regexp_matches(name, {_lit(N.PRIMARY_CRAFT)})) AND length(norm) >= 3 AND NOT regexp_matches(norm, '^\\d+$') AND norm NOT IN {_in(N.PRIMARY_NO_TITLE)}
  AND NOT regexp_matches(name, {_lit(N.PRIMARY_COLLECTION)}) AND NOT regexp_matches(name, {_lit(N.PRIMARY_SUFFIX)}) GROUP BY k, norm),
{_EVIDENCE % 55},
v AS (SELECT *, coalesce(regexp_matches(before, {_lit(N.PRIMARY_COMPARISON)}), false) AS compared, coalesce(regexp_matches(right(before, 45), {_lit(N.PRIMARY_UPDATE)}), false) AS updated FROM b),
s AS (SELECT *, points + 90 * CAST(ct > 0 AS INT) + 100 * CAST(cs > 0 AS INT) + 60 * CAST(cu > 0 AS INT) - 500 * CAST(compared AS INT) - 400 * CAST(updated AS INT) - CASE WHEN NOT regexp_matches(name, {_lit(N.PRIMARY_ACTION)}) THEN 0 WHEN strong THEN 130 ELSE 300 END - 300 * CAST(norm IN {_in(N.PRIMARY_GENERIC)} AS INT) AS score FROM v),
g AS (SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s l WHERE l.k = a.k AND length(l.norm) > length(a.norm) AND contains(' ' || l.norm || ' ', ' ' || a.norm || ' ') AND (l.strong OR l.colon OR l.score >= a.score - 25))),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS after FROM g WINDOW w AS (PARTITION BY k {_ORDER}))
SELECT k, name AS candidate, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank, strong, rank = 1 AND score >= 230 AND NOT compared AND NOT updated AND (contains(norm, ' ') OR cu > 0 OR strong) AND (cs > 0 OR strong) AND (after IS NULL OR score - after >= 30) AS accepted FROM r"""


_DOCUMENTS = r"SELECT doc_id AS k, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS summary, '' AS url FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"
_WORDS = r"regexp_extract_all(html, '[A-Za-z]{4,}', 0)"
#: Pages as news about a name made of two of their words: released, updated, compared, in a series, in the summary alone, with an action.
_NEWS = rf"""SELECT k, CASE k % 8 WHEN 0 THEN 'Release of ' || name || ' moves' WHEN 1 THEN 'The update - ' || name || ' grows' WHEN 2 THEN 'Old Harbour feels like ' || name WHEN 3 THEN name || ': Second Dawn at last' WHEN 4 THEN 'Studio talks money' WHEN 5 THEN 'How ' || name || ' was made' WHEN 6 THEN name || ' Collection and Rust' ELSE 'New simulator ' || name || ' in Prey' END AS title,
  CASE k % 5 WHEN 0 THEN 'The game called ' || name || ', by a small team. ' WHEN 1 THEN name || ' is a game. ' WHEN 2 THEN 'Keep an eye on ' || name || ' and in ' || name || ' Souls. ' WHEN 3 THEN 'Sales fell. ' ELSE 'An early look in ' || name || '. ' END || body || ' The post appeared first here.' AS summary, url || '/' || lower(replace(name, ' ', '-')) AS url
  FROM (SELECT page_id AS k, upper(w[20][1]) || lower(w[20][2:]) || ' ' || upper(w[-9][1]) || lower(w[-9][2:]) AS name, regexp_replace(html, '<[^>]+>', ' ', 'g') AS body, url FROM (SELECT page_id, html, url, {_WORDS} AS w FROM pages WHERE page_id IS NOT NULL) WHERE len(w) >= 20)"""


def _news(pages: DataFrame) -> DataFrame:
    k = F.col("page_id")
    words = pages.withColumn("w", F.regexp_extract_all("html", F.lit("[A-Za-z]{4,}"), F.lit(0))).filter(k.isNotNull() & (F.size("w") >= 20))
    shaped = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))
    d = words.select(k, "url", F.regexp_replace("html", "<[^>]+>", " ").alias("body"), F.concat_ws(" ", shaped(F.element_at("w", 20)), shaped(F.element_at("w", -9))).alias("n"))
    n, say = F.col("n"), lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    titles = (say("Release of ", n, " moves"), say("The update - ", n, " grows"), say("Old Harbour feels like ", n), say(n, ": Second Dawn at last"), F.lit("Studio talks money"), say("How ", n, " was made"), say(n, " Collection and Rust"), say("New simulator ", n, " in Prey"))
    leads = (say("The game called ", n, ", by a small team. "), say(n, " is a game. "), say("Keep an eye on ", n, " and in ", n, " Souls. "), F.lit("Sales fell. "), say("An early look in ", n, ". "))
    title, lead = titles[-1], leads[-1]
    for i in range(7):
        title = F.when(k % 8 == i, titles[i]).otherwise(title)
    for i in range(4):
        lead = F.when(k % 5 == i, leads[i]).otherwise(lead)
    return d.select(k.alias("k"), title.alias("title"), say(lead, F.col("body"), " The post appeared first here.").alias("summary"), say(F.col("url"), "/", F.lower(F.replace(n, F.lit(" "), F.lit("-")))).alias("url"))


@query(f"SELECT k AS doc_id, * EXCLUDE (k) FROM ({_context_sql(_DOCUMENTS)})")
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that documents hold in their first line and in the rest, by the rules of context."""
    title = F.substring_index("text", "\n", 1)
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", title.alias("title"), F.substring("text", F.char_length(title) + 2, F.char_length("text")).alias("summary"))
    return N.title_candidates(d, "doc_id", "title", "summary")


@query(f"SELECT k AS page_id, * EXCLUDE (k) FROM ({_context_sql(_NEWS)})")
def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as news with an address, by the rules of context."""
    return N.title_candidates(_news(spread(table(spark, sf_dir, "pages"))), "k", "title", "summary", "url").withColumnRenamed("k", "page_id")


@query(f"SELECT k AS page_id, * EXCLUDE (k) FROM ({_primary_sql(_NEWS)})")
def primary_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as news with an address, by the rules of the one title that an item is about."""
    return N.primary_titles(_news(spread(table(spark, sf_dir, "pages"))), "k", "title", "summary", "url").withColumnRenamed("k", "page_id")

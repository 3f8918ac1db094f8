"""Queries over whole tables: no row of the given tables is left out."""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata

import pytest

from newsdesk import plans
from newsdesk.functions import text as T
from newsdesk.plans.registry import table

SF = "/root/testdata/sf0.001"


def keys(spark, name, column):
    return {r[0] for r in plans.QUERIES[name](spark, SF).select(column).distinct().collect()}


@pytest.mark.parametrize(
    ("name", "column", "source", "key"),
    [
        ("similar_parts", "a", "part", "p_partkey"),
        ("external_id_link", "l_orderkey", "lineitem", "l_orderkey"),
        ("notability", "user_id", "events", "user_id"),
        ("regional_affinity", "candidate", "events", "user_id"),
        ("attached_variants", "p_partkey", "part", "p_partkey"),
        ("discussion", "cluster", "part", "p_brand"),
    ],
)
def test_every_key_has_rows(spark, name, column, source, key):
    assert keys(spark, name, column) == {r[0] for r in table(spark, SF, source).select(key).distinct().collect()}


def test_all_orders_match_by_id_or_title(spark):
    """All but those whose ids match nothing: they never match by title."""
    lines = table(spark, SF, "lineitem").select("l_orderkey", "l_partkey").distinct().collect()
    assert keys(spark, "id_or_title", "l_orderkey") == {r[0] for r in lines if r[0] % 4 == 0 or r[1] % 3 != 0}


def test_all_lines_of_an_order_count(spark):
    lines = {int(r[0].split(":")[1]) for r in plans.QUERIES["rank_violations"](spark, SF).select("key").collect()}
    assert max(lines) > 3
    days = {(r.l_orderkey, r.date) for r in plans.QUERIES["claimed_events"](spark, SF).select("l_orderkey", "date").collect()}
    assert days >= {(r.l_orderkey, r.d) for r in table(spark, SF, "lineitem").selectExpr("l_orderkey", "to_date(l_shipdate) AS d").collect()}


def test_no_registered_sql_reads_a_slice():
    for name in ("similar_parts", "external_id_link", "notability", "regional_affinity", "id_or_title", "attached_variants", "discussion", "rank_violations", "claimed_events", "token_sets", "article_metrics", "page_text", "near_duplicate_pairs"):
        assert not re.search(r"WHERE \w+ %|x7F|WHERE \w*(linenumber|partkey) <", plans.ORACLES[name]), name


LONG = "Çelik überquert Flüsse während Straßenbahnen wieder dauernd später fahren müssen"
DOCS = [
    (1, LONG),
    (2, LONG.replace("dauernd", "selten") + " gestern"),
    (3, "plain words without marks between other plain letters"),
    (4, "plain words without marks between other plain letters éé"),
    (5, None),
    (6, ""),
    (7, "日本語の文章 ﬁnale １２３４５ naïve\u00a0d’été. Ende! “ja”? <IMG src=a>"),
    (8, "новые игры вышли сегодня утром вечером осенью"),
]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('texts')}"
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def tokens(text, least, stop):
    key = re.sub("[’'“”\"`]", "", unicodedata.normalize("NFKD", (text or "").lower()))
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in key).split()
    return {w for w in words if len(w) >= least and w not in stop}


def test_token_sets_of_all_scripts(spark, texts):
    got = {r.doc_id: r.tokens_md5 for r in plans.QUERIES["token_sets"](spark, texts).collect()}
    assert got == {i: hashlib.md5(" ".join(sorted(tokens(t, 3, T.STOP_WORDS))).encode()).hexdigest() for i, t in DOCS}


def test_near_duplicates_of_all_scripts(spark, texts):
    sets = {i: s for i, t in DOCS if len(s := tokens(t, 5, ())) >= 5}
    want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * min(len(sets[a]), len(sets[b]))}
    assert {(r.a, r.b, r.shared) for r in plans.QUERIES["near_duplicate_pairs"](spark, texts).collect()} == want
    assert {(a, b) for a, b, _ in want} == {(1, 2), (3, 4)}


def test_article_metrics_of_all_texts(spark, texts):
    got = {r.doc_id: (r.words, r.sentences, r.images) for r in plans.QUERIES["article_metrics"](spark, texts).collect()}
    space = "[ \t\n\x0b\f\r]"
    count = lambda t: (len([w for w in re.split(f"{space}+", t) if w]), len(re.findall(rf"[.!?](?:{space}|$)", t)), len(re.findall(r"(?i)<img\b", t)))
    assert got == {i: (None, None, None) if t is None else count(t) for i, t in DOCS}


def test_page_text_decodes_numeric_entities(spark, tmp_path):
    pages = {
        1: ("<p>caf&#233; &#8220;x&#8221;</p> &amp; ü", "café “x” & ü"),
        2: ("&#128512;&#1048576;&#1114111; a", "\U0001f600\U00100000\U0010ffff a"),
        3: ("&#65; &#065; &#8364;&#x", "A A €&#x"),
        4: ("a&#55296;b&#57343;c&#1114112;d&#9999999;e", "a\ufffdb\ufffdcde"),
        7: ("&#38;#65; &#65;", "&#65; A"),
        5: (None, None),
        6: ("", ""),
    }
    spark.createDataFrame([(i, h) for i, (h, _) in pages.items()], "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r.page_id: r.text_md5 for r in plans.QUERIES["page_text"](spark, f"file://{tmp_path}").collect()}
    assert got == {i: None if t is None else hashlib.md5(t.encode()).hexdigest() for i, (_, t) in pages.items()}


def test_no_document_or_page_is_left_out(spark):
    for name, source, key in (("token_sets", "documents", "doc_id"), ("article_metrics", "documents", "doc_id"), ("page_text", "pages", "page_id")):
        assert plans.QUERIES[name](spark, SF).select(key).count() == table(spark, SF, source).count()

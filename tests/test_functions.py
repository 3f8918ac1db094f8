from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsdesk.functions import dates as D
from newsdesk.functions import ids as I
from newsdesk.functions import text as T
from newsdesk.functions import urls as U
from newsdesk.functions.scores import normalize_score


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "variant", "marks", "want"),
    [
        ("Pokémon GO!", "news", "space", "poke mon go"),
        ("Pokémon GO!", "news", "remove", "pokemon go"),
        ("Don't “Stop”", "news", "space", "dont stop"),
        ("Ёлка игрой", "news", "remove", "елка игрои"),
        ("Half-Life™ 2", "registry", "space", "half life 2"),
        ("Игра: Zелда", "calendar", "space", "z"),
        ("", "news", "space", ""),
        (None, "news", "space", None),
    ],
)
def test_norm_text(spark, text, variant, marks, want):
    assert one(spark, text, T.norm_text(F.col("x"), variant, marks)) == want


def test_tokens_and_overlaps(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d", "e"], [])], "a array<string>, b array<string>, c array<string>").select(
        T.overlap_min(F.col("a"), F.col("b")).alias("mn"), T.overlap_max(F.col("a"), F.col("b")).alias("mx"), T.coverage(F.col("b"), F.col("a")).alias("cv"), T.overlap_min(F.col("a"), F.col("c")).alias("z")
    ).first()
    assert (round(row.mn, 6), row.mx, row.cv, row.z) == (round(2 / 3, 6), 0.5, 0.5, 0.0)
    assert one(spark, "the new doom is out now", T.title_tokens(F.col("x"))) == ["doom", "out", "now"]


@pytest.mark.parametrize(
    ("url", "policy", "want"),
    [
        ("https://Example.com/a/?utm_source=x&b=2&a=1#top", "linker", "https://example.com/a?b=2&a=1"),
        ("https://example.com/a/?b=2&a=1&ref_src=q", "validator", "https://example.com/a?a=1&b=2"),
        ("https://example.com/a?ref_src=q", "linker", "https://example.com/a?ref_src=q"),
        ("https://example.com/a?b=2", "home", "https://example.com/a"),
        ("https://example.com/", "linker", "https://example.com"),
        (" not a url ", "linker", "not a url"),
        (None, "linker", None),
    ],
)
def test_canonical_url(spark, url, policy, want):
    assert one(spark, url, U.canonical_url(F.col("x"), policy)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2026-08-09", ("exact", "2026-08-09", "2026-08-09")),
        ("Aug 9, 2026", ("exact", "2026-08-09", "2026-08-09")),
        ("Q3 2026", ("quarter", "2026-07-01", "2026-09-30")),
        ("2026 Q3", ("quarter", "2026-07-01", "2026-09-30")),
        ("February 2028", ("month", "2028-02-01", "2028-02-29")),
        ("2027", ("year", "2027-01-01", "2027-12-31")),
        ("coming soon", ("tbd", None, None)),
        ("", ("tbd", None, None)),
        (None, ("tbd", None, None)),
    ],
)
def test_date_claims(spark, text, want):
    r = one(spark, text, D.parse_date_claim(F.col("x"), loose=True))
    assert (r.precision, *(str(d) if d else None for d in (r.date_start, r.date_end))) == want


def test_publication_fields(spark):
    r = one(spark, "2026-08-09T22:30:00Z", D.publication_fields(F.col("x")))
    assert (r.day, r.minute) == ("2026-08-10", "01:30")
    r = one(spark, "2026-08-09T22:30:00+05:00", D.publication_fields(F.col("x")))
    assert (r.day, r.minute) == ("2026-08-09", "22:30")


def test_recency(spark):
    as_of = F.lit("2026-01-05 00:00:00").cast("timestamp")
    at = lambda t: one(spark, t, D.recency(F.col("x").cast("timestamp"), as_of))
    assert at("2026-01-04 00:00:00") == pytest.approx(0.5)
    assert at("2025-12-31 23:00:00") == 0 and at(None) == 0 and at("2026-01-06 00:00:00") == 1


def test_markup(spark):
    text = "<style>p{}</style><p>A &amp; B &#169;</p><script>x()</script><![CDATA[c]]>"
    assert one(spark, text, T.strip_markup(F.col("x"))) == "A & B © c"


@pytest.mark.parametrize(("title", "kind"), [("Doom Expansion Pack DLC", "expansion"), ("Doom Season Pass", "dlc"), ("Doom Remake", "remake"), ("Doom Remastered", "remaster"), ("Doom Gold", "edition"), ("Doom", "game")])
def test_kinds(spark, title, kind):
    assert one(spark, title, T.infer_kind(F.col("x"))) == kind


def test_relevance_and_terms(spark):
    assert one(spark, "New game announced for PC", T.relevant(F.col("x"))) is True
    assert one(spark, "Game of the week quiz", T.relevant(F.col("x"))) is False
    assert one(spark, "STALKER-2: the zone", T.franchise_term(F.col("x"))) == "STALKER-2"
    assert one(spark, "Mass Effect: The Long Journey Home", T.franchise_term(F.col("x"))) == "Long Journey Home"


def test_summary_keeps_order_and_limit(spark):
    text = "The studio announced a big release for PC today. Subscribe to our newsletter for a discount now. The launch date was confirmed for March 2026. Short."
    got = one(spark, text, T.editorial_summary(F.col("x"), F.lit("Studio announced release"), most=120, sentences=2))
    # "Subscribe" begins boilerplate, which goes to the end of the text.
    assert got == "The studio announced a big release for PC today."
    got = one(spark, text.replace("Subscribe to our", "Wishlist our"), T.editorial_summary(F.col("x"), F.lit("Studio announced release"), most=120, sentences=2))
    assert got == "The studio announced a big release for PC today. The launch date was confirmed for March 2026."
    assert one(spark, "", T.editorial_summary(F.col("x"), F.lit("t"))) == ""


def test_ids_and_scores(spark):
    assert one(spark, "Pokémon™: Let's Go", I.slugify(F.col("x"))) == "pokemon-let-s-go"
    assert one(spark, "", I.repaired_slug(F.col("x"), F.lit(7), F.lit("t"))) == "steam-7"
    assert one(spark, 8.0, normalize_score(F.col("x"), F.lit(10.0), to=100.0), "double") == 80
    assert one(spark, 11.0, normalize_score(F.col("x"), F.lit(10.0)), "double") is None
    assert one(spark, "b+", normalize_score(F.lit(None).cast("double"), F.lit(10.0), F.col("x"))) == 8.5


def test_envelopes(spark):
    make = lambda v, s, c, k: I.envelope(F.lit(v), F.lit(s), F.lit(c), F.lit(k))
    pick = lambda a, b: one(spark, "", I.winning_field(make(*a), make(*b)))["value"]
    assert pick(("a", "official", 1.0, False), ("b", "platform_store", 1.0, False)) == "a"
    assert pick(("a", "platform_store", 1.0, False), ("b", "official", 1.0, False)) == "b"
    assert pick(("a", "platform_store", 1.0, True), ("b", "official", 1.0, False)) == "a"
    assert pick(("a", "official", 0.5, False), ("b", "official", 0.5, False)) == "a"


def test_set_digest_has_no_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = I.set_digest(df, "id", F.col("v").cast("string")).first(), I.set_digest(df.orderBy(F.desc("id")).repartition(7), "id", F.col("v").cast("string")).first()
    assert a == b and a.n == 100
    assert I.set_digest(df.withColumn("v", F.lit(1)), "id", F.col("v").cast("string")).first().digest != a.digest

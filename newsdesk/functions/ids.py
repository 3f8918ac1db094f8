"""Ids and digests: slugs, hash ids, digests of sets, field envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import nfkd


def slugify(text: Column, normalise: bool = True) -> Column:
    """Lower-case ASCII words joined by hyphens, marks removed."""
    t = F.regexp_replace(text, "[™®©]", "")
    t = F.regexp_replace(nfkd(t), r"[̀-ͯ]", "") if normalise else t
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def repaired_slug(slug: Column, steam_id: Column, title: Column) -> Column:
    """The slug, else steam-<id>, else game-<12 digits of the title's sha1>."""
    return F.coalesce(F.nullif(slug, F.lit("")), F.when(steam_id.isNotNull(), F.concat(F.lit("steam-"), steam_id.cast("string"))), F.concat(F.lit("game-"), F.substring(F.sha1(F.coalesce(title, F.lit(""))), 1, 12)))


def stable_id(prefix: str, basis: Column, n: int = 20) -> Column:
    """``prefix`` and n digits of the sha256 of a basis."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(basis, 256), 1, n))


def game_basis(alias: Column, year: Column, kind: Column, **external: Column) -> Column:
    """The strongest external id as provider:id (in the order given), else alias:year:kind."""
    ids = [F.when(F.nullif(c.cast("string"), F.lit("")).isNotNull(), F.concat(F.lit(f"{name}:"), c.cast("string"))) for name, c in external.items()]
    return F.coalesce(*ids, F.concat_ws(":", F.coalesce(alias, F.lit("")), F.coalesce(year.cast("string"), F.lit("")), kind))


#: Lines of a bucket at most, on average.
BUCKET_LINES = 50_000


def set_digest(df: DataFrame, key: str, content: Column, buckets: int = 256) -> DataFrame:
    """One row (digest, n): sha256 over a table, order-free.

    Lines key:hash are sorted and digested in buckets by key, and the digests of
    the buckets in their order; a bucket is the only list that is gathered.  There
    are four times as many for each fourfold of BUCKET_LINES * ``buckets`` rows.
    """
    n = df.count()
    while n > buckets * BUCKET_LINES:
        buckets *= 4
    lines = df.select(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long").alias("h"), F.concat_ws(":", F.col(key).cast("string"), F.sha2(content, 256)).alias("line"))
    parts = lines.groupBy((F.col("h") % buckets).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"), F.sum("n").alias("n"))


#: Trust in a kind of source.
TRUST = {"manual": 110, "official": 100, "platform_store": 60, "automated_inference": 20}


def envelope(value: Column, source: Column, confidence: Column, locked: Column) -> Column:
    """struct(value, source, confidence, locked, trust) of a field."""
    trust = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TRUST.items() for x in pair)), source), F.lit(0)) * confidence
    return F.struct(value.alias("value"), source.alias("source"), confidence.alias("confidence"), locked.alias("locked"), trust.alias("trust"))


def winning_field(current: Column, new: Column) -> Column:
    """Of two envelopes the locked, else the more trusted; a tie keeps the current one."""
    return F.when(current.isNull() | current["value"].isNull(), new).when(new.isNull() | current["locked"], current).when(new["locked"] | (new["trust"] > current["trust"]), new).otherwise(current)

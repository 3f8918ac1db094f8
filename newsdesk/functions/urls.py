"""Addresses: canonical forms and source classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING = r"^(utm_.*|fbclid|gclid|yclid|ref|source)$"
TRACKING_WIDE = r"^(utm_.*|fbclid|gclid|yclid|ref|ref_.*|source)$"


def canonical_url(url: Column, policy: str = "linker") -> Column:
    """An address in canonical form; text that is no http address comes back trimmed.

    Policies: *linker* drops the fragment, tracking keys and the last slash;
    *history* also drops ``ref_*``; *validator* sorts what is left of the query as
    well; *home* drops the whole query.
    """
    t = F.trim(url)
    base = F.regexp_extract(t, r"^(https?://[^?#]+)", 1)
    query = F.regexp_extract(t, r"^[^?#]*\?([^#]*)", 1)
    host = F.lower(F.regexp_extract(base, r"^(https?://[^/]+)", 1))
    path = F.regexp_replace(F.substring(base, F.char_length(F.regexp_extract(base, r"^(https?://[^/]+)", 1)) + 1, 1 << 20), "/+$", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(TRACKING if policy == "linker" else TRACKING_WIDE))
    kept = F.array_sort(kept) if policy == "validator" else kept
    tail = F.lit("") if policy == "home" else F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(base == "", t).otherwise(F.concat(host, path, tail))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))


def source_class(url: Column, classes: dict[str, tuple[str, float]], unknown: float = 0.4) -> Column:
    """struct(type, trust) of the longest domain in ``classes`` that is the host or an end of it."""
    host = url_host(url)
    out = F.struct(F.lit("unknown").alias("type"), F.lit(unknown).alias("trust"))
    for domain in sorted(classes, key=len):
        kind, trust = classes[domain]
        out = F.when((host == domain) | host.endswith(f".{domain}"), F.struct(F.lit(kind).alias("type"), F.lit(trust).alias("trust"))).otherwise(out)
    return out


def publisher_key(title: Column, source: Column, aliases: dict[str, str] | None = None) -> Column:
    """The publisher of an item: what follows the last " - " of an aggregated title, else its source; lower case, by alias."""
    said = F.lower(F.trim(F.when(title.contains(" - "), F.substring_index(title, " - ", -1)).otherwise(source)))
    if not aliases:
        return said
    named = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(named, said), said)


#: Other names of publishers, and names of platforms and makers, which are not independent.
PUBLISHERS = {"gamesradar+": "gamesradar", "v g c": "vgc", "pcgamesn.com": "pcgamesn", "polygon.com": "polygon", "eurogamer.net": "eurogamer"}
OFFICIAL = r"(?i)\b(steam|electronic arts|ea games|playstation|xbox|nintendo|bandai namco|ubisoft|rockstar games|bethesda|focus entertainment|lucasfilm|starwars\.com|epic games|developer|publisher)\b"


def publisher_name(title: Column, source: Column, aggregated: Column) -> Column:
    """The publisher of an item: of an aggregated feed what follows the title's last " - ", if that can be a name, else its source."""
    said = F.regexp_extract(title, r"\s+-\s+([^–—|]{2,100})$", 1)
    return F.when(aggregated & (F.trim(said) != ""), F.trim(said)).otherwise(source)


def publisher_family(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """One key for a publisher's names: lower case, aliases replaced, national editions united."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    key, table = plain(name), {**PUBLISHERS, **(aliases or {})}
    simple = {" ".join("".join(ch if ch.isalnum() else " " for ch in k.lower()).split()): v for k, v in table.items()}
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in simple.items() for x in pair)), key)
    return F.when(known.isNotNull(), known).when(key.rlike(r"(^|\s)ign(\s|$)"), "ign").when(key.contains("gamereactor"), "gamereactor").otherwise(key)


def trusted_publisher(name: Column, trusted: tuple[str, ...]) -> Column:
    """Whether a publisher is no platform or maker, and its key is a trusted one, holds one or is held by one."""
    key = publisher_family(name)
    near = F.lit(False)
    for t in trusted:
        near = near | key.contains(t) | F.lit(t).contains(key)
    return (key != "") & ~key.rlike(OFFICIAL) & near

"""Names of titles in items: candidates from patterns and cues, weighed by evidence in title, summary and address.

Two rule sets share the steps.  Patterns mark their matches in whole texts; matches
become rows with their places, and fold by normalised name.  The names of an item meet
its texts once, in one row, where occurrences are counted; texts are never copied to
names.  A name inside a longer one is found through the longer one's runs of words, of
the lengths that the item's names have, instead of by pairs of names.

Names are ASCII at word boundaries and white space; rows without a key take no part,
keys are unique, null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfkd

# Names that are no titles, one-word titles that are ordinary words, cues and patterns of names.
CONTEXT_NO_TITLE = (
    "xbox", "xbox one", "xbox series x", "xbox series s", "xbox game pass", "game pass", "playstation", "playstation 4", "playstation 5", "ps4", "ps5",
    "nintendo", "nintendo switch", "nintendo switch 2", "steam", "steam deck", "microsoft", "microsoft gaming", "sony", "sony interactive entertainment",
    "epic games", "epic games store", "valve", "ubisoft", "electronic arts", "ea", "activision", "blizzard", "bethesda", "bethesda softworks", "id software",
    "bioware", "larian", "capcom", "sega", "konami", "bandai namco", "take two", "take-two", "thq nordic", "halo studios", "tarsier studios", "rockstar games",
    "warner bros games", "ign", "pc gamer", "gamespot", "eurogamer", "vgc", "polygon", "gamesradar", "rock paper shotgun", "playground", "unreal engine",
    "unreal engine 5", "unity", "summer game fest", "the game awards", "fanfest", "magic",
)
CONTEXT_GENERIC = ("control", "inside", "prey", "rust", "journey", "stray", "anthem")
CONTEXT_SUFFIX = r"(?i)\b(?:studio|studios|software|interactive|entertainment|publishing|publisher|games|nordic)$"
CONTEXT_COMPARISON = r"(?i)(?:\blike\b|\bvibes?\b|inspired by|inspiration from|authors? of|creators? of|behind\b|compared (?:with|to)|brings?\s+(?:the\s+)?$)"
CONTEXT_UPDATE = r"(?i)\b(?:dlc|update|expansion|addition|add-on|season|mode|patch)\b"
PRIMARY_NO_TITLE = (
    "xbox", "xbox insiders", "xbox game pass", "game pass", "playstation", "playstation plus", "ps5", "ps4", "steam", "microsoft", "sony", "nintendo", "nintendo switch", "nintendo switch 2",
    "thq nordic", "halo studios", "id software", "bioware", "capcom", "bethesda", "take two", "take-two", "ign", "pc gamer", "gamespot", "eurogamer", "polygon", "fanfest", "fan fest",
    "indie selects", "indie select hub", "magic",
)
PRIMARY_GENERIC = ("control", "inside", "prey", "rust", "journey", "stray", "anthem", "magic")
PRIMARY_ACTION = r"(?i)^(?:how|keep|available|coming|celebrating|indie selects?|magic designer)\b"
PRIMARY_COLLECTION = r"(?i)\b(?:triptych|collection|franchise|series|insiders?|anniversary|fanfest)\b"
PRIMARY_SUFFIX = r"(?i)\b(?:studio|studios|software|publisher|publishing|entertainment)$"
PRIMARY_COMPARISON = r"(?i)(?:\blike\b|\bvibes?\b|inspired by|inspiration from|authors? of|creators? of|behind\b|compared (?:with|to)|brings?\s+(?:the\s+)?)\s*$"
PRIMARY_UPDATE = r"(?i)\b(?:update|dlc|expansion|addition|add-on|season|mode|patch)\b[^–—-]{0,12}[–—-]?\s*$"
PRIMARY_CRAFT = r"(?i)\b(?:simulator|souls|craft)\b"
FEED_TAIL = r"(?i)\s+(?:The post|Сообщение|Публикация)\b[\s\S]*$"
_WORD = r"[A-Z0-9][A-Za-zÀ-ÖØ-öø-ÿ0-9'’.-]*"
_TAIL = rf"(?:\s+(?:{_WORD}|x|of|the|and|to|for|vs\.?|Part)){{0,5}}"
_ANCHORED = r"([A-Z0-9][A-Za-z0-9'’.-]*(?:\s+(?:[A-Z0-9][A-Za-z0-9'’.-]*|x|of|the|and|to|for)){0,6})"
_MORE = rf"(?:\s+(?:{_WORD}|(?:of|the|and|to|for|vs\.?|x|Part)))"
_TITLE = rf"{_WORD}{_MORE}{{0,6}}(?:\s*:\s*{_WORD}{_MORE}{{0,5}})?"
#: (kind, text, pattern, points) in the order in which names are met; the first group of a pattern is the name and ends it.
CONTEXT_PATTERNS = (
    ("colon", "title", rf"\b({_WORD}{_TAIL}\s*:\s*{_WORD}{_TAIL})", 0),
    ("name", "title", rf"\b({_WORD}{_TAIL})", 0),
    ("colon", "other_title", rf"\b({_WORD}{_TAIL}\s*:\s*{_WORD}{_TAIL})", 0),
    ("name", "other_title", rf"\b({_WORD}{_TAIL})", 0),
    *((kind, text, pattern, 0) for text in ("summary", "other_summary") for kind, pattern in (
        ("anchor", rf"(?i)(?:game|shooter|roguelite|fighter|adventure game|action rpg|horror shooter)\s*(?:called|named|titled)?\s*[,–—:-]?\s*{_ANCHORED}"),
        ("anchor", rf"(?i)(?:keep an eye on|working on our first game\s*[–—:-]?|our first game\s*[–—:-]?|called|named|titled)\s+{_ANCHORED}"),
        ("leading", rf"^({_WORD}{_TAIL}(?:\s*:\s*{_WORD}{_TAIL})?)"),
    )),
)
PRIMARY_PATTERNS = (
    ("title-cue", "title", rf"(?:release of|launch of|for|about|in|shooter|simulator|soulslike|fighter|game)\s+({_TITLE})", 140),
    ("title-colon", "title", rf"\b({_WORD}{_MORE}{{0,4}}\s*:\s*{_WORD}{_MORE}{{0,5}})", 120),
    ("title-seq", "title", rf"\b({_TITLE})", 45),
    ("summary-cue", "summary", rf"(?:game|shooter|simulator|soulslike|fighter|roguelite|action[- ]?rpg|horror shooter)(?:\s+(?:called|named|titled))?\s*[,–—:-]?\s+({_TITLE})", 180),
    ("summary-cue", "summary", rf"(?:called|named|titled|keep an eye on|journey in|play as [^,.]{{0,30}} in|first game\s*[–—:-][^,.]{{0,60}}[,–—:-])\s*({_TITLE})", 180),
    ("summary-cue", "summary", rf"(?:game|shooter|simulator|fighter|roguelite)\s*,\s*({_TITLE})", 180),
    ("summary-in", "summary", rf"\bin\s+({_TITLE})", 130),
    ("summary-leading", "summary", rf"^({_TITLE})", 110),
)
# End of the fixed values.

#: Word boundaries between ASCII characters in every version of Java.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_MARKS = "\u0001\u0002\u0003"


def _ascii(pattern: str) -> str:
    """A pattern with explicit boundaries; names begin with a letter or digit, so theirs look back only."""
    return pattern.replace(r"\b([A-Z0-9]", "(?<![A-Za-z0-9_])([A-Z0-9]").replace(r"\b", _EDGE)


def name_key(text: Column) -> Column:
    """Letters and digits of a decomposed text in lower case, words joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkd(text)), r"[^\p{L}\p{N}]+", " "))


def _clean(name: Column, cut: bool) -> Column:
    """A name without brackets and quotation marks and without marks at its ends; ``cut`` at a sentence's end."""
    c = F.regexp_replace(name, r'[“”«»"()\[\]{}]', " ")
    c = F.regexp_replace(c, r"[.!?]\s+[A-ZА-ЯЁ][\s\S]*$", "") if cut else c
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\s:;,.!?–—-]+|[\s:;,.!?–—-]+$", ""), r"\s+", " "))


def _address(url: Column) -> Column:
    """The decoded path and query of an address; what is none stays."""
    whole = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)(\?[^#]*)?.*$"
    return F.when(url.rlike(whole), F.coalesce(F.try_url_decode(F.regexp_replace(url, whole, "$1 $2")), url)).otherwise(url)


def _texts(items: DataFrame, key: str, fields: dict[str, str | None], tail: bool) -> DataFrame:
    """(key, title, other_title, summary, other_summary, url) of items, the marks of matches being blank."""
    col = lambda f: F.translate(F.coalesce(F.col(fields[f]), F.lit("")), _MARKS, "   ") if fields.get(f) else F.lit("")
    cut = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, _ascii(FEED_TAIL), ""), r"\s+", " ")) if tail else c
    return items.filter(F.col(key).isNotNull()).select(F.col(key), col("title").alias("title"), col("other_title").alias("other_title"), cut(col("summary")).alias("summary"), cut(col("other_summary")).alias("other_summary"), col("url").alias("url"))


def _matches(texts: DataFrame, key: str, patterns: tuple, cut: bool) -> DataFrame:
    """(key, kind, points, order, nth, at, name, norm): each match of each pattern with its place."""
    held = texts.select(key, F.explode(F.array(*(F.struct(F.lit(o).alias("order"), F.lit(kind).alias("kind"), F.lit(points).alias("points"), F.split(F.regexp_replace(F.col(text), _ascii(p), "\u0001$0\u0002$1\u0003"), "\u0001").alias("parts")) for o, (kind, text, p, points) in enumerate(patterns)))).alias("_m"))
    rows = held.filter(F.size("_m.parts") > 1).select(key, "_m.order", "_m.kind", "_m.points", F.posexplode("_m.parts").alias("nth", "part")).repartition(key)
    raw = F.substring_index(F.substring_index("part", "\u0003", 1), "\u0002", -1)
    size = F.char_length("part") - F.when(F.col("nth") > 0, F.char_length(raw) + 2).otherwise(0)
    before = Window.partitionBy(key, "order").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.sum(size).over(before)).filter("nth > 0").select(key, "kind", "points", "order", "nth", "at", _clean(raw, cut).alias("name"))
    return placed.withColumn("norm", name_key(F.col("name")))


def _with_evidence(folded: DataFrame, texts: DataFrame, key: str, update: str, last: int) -> DataFrame:
    """folded(key, norm, name, …) with in_own (in the title of the first language), n_title, n_summary, n_url (places as whole words), before (the ``last`` characters of the title before the name; null if it isn't there) and update (a word of updates in the title)."""
    spaced = lambda *cs: F.concat(F.lit(" "), name_key(F.concat_ws(" · ", *cs)), F.lit(" "))
    own = texts.select(key, F.col("title").alias("_t"), F.lower("title").alias("_l"), spaced("title").alias("_no"), spaced("title", "other_title").alias("_nt"), spaced("summary", "other_summary").alias("_ns"), spaced(_address(F.col("url"))).alias("_nu"), F.col("title").rlike(_ascii(update)).alias("update"))
    kept = [c for c in folded.columns if c != key]
    lists = folded.groupBy(key).agg(F.collect_list(F.struct(*kept)).alias("_c"))

    def count(text: str, norm: Column) -> Column:
        token = F.concat(F.lit(" "), norm, F.lit(" "))
        return ((F.char_length(text) - F.char_length(F.replace(F.col(text), token, F.lit("")))) / F.char_length(token)).cast("int")

    def weigh(c: Column) -> Column:
        at = F.position(F.lower(c["name"]), F.col("_l"))
        return F.struct(*(c[k].alias(k) for k in kept), F.col("_no").contains(F.concat(F.lit(" "), c["norm"], F.lit(" "))).alias("in_own"), count("_nt", c["norm"]).alias("n_title"), count("_ns", c["norm"]).alias("n_summary"), count("_nu", c["norm"]).alias("n_url"), F.when(at > 0, F.substring(F.col("_t"), F.greatest(at - last, F.lit(1)), F.least(at - 1, F.lit(last)))).alias("before"))

    return lists.join(own, key).select(key, "update", F.inline(F.transform("_c", weigh)))


def _without_nested(scored: DataFrame, key: str, strong: Column, slack: int) -> DataFrame:
    """scored without names that a longer one holds as whole words, if that is strong or scores no less than theirs less ``slack``."""
    sized = scored.withColumn("_strong", strong).withColumn("_w", F.split("norm", " ")).withColumn("_sizes", F.collect_set(F.size("_w")).over(Window.partitionBy(key)))
    places = lambda n: F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))
    runs = F.array_distinct(F.flatten(F.transform(F.filter("_sizes", lambda n: n < F.size("_w")), places)))
    # The name itself comes first and brings its row, its runs bring strength and score.
    rows = sized.select(key, F.struct(*(c for c in scored.columns if c != key)).alias("_row"), "_strong", "score", F.posexplode(F.concat(F.array("norm"), runs)).alias("_at", "_run"))
    own = F.col("_at") == 0
    met = rows.groupBy(key, "_run").agg(F.max(F.when(own, F.col("_row"))).alias("_row"), F.bool_or(~own & F.col("_strong")).alias("_s"), F.max(F.when(~own, F.col("score"))).alias("_top"))
    gone = F.coalesce(F.col("_s") | (F.col("_top") >= F.col("_row.score") - slack), F.lit(False))
    return met.filter(F.col("_row").isNotNull() & ~gone).select(key, "_row.*")


def _ranked(df: DataFrame, key: str) -> tuple[DataFrame, Window]:
    w = Window.partitionBy(key).orderBy(F.desc("score"), "at", F.desc(F.char_length("name")), "norm")
    return df.withColumn("rank", F.row_number().over(w)), w


def title_candidates(items: DataFrame, key: str, title: str, summary: str, url: str | None = None, other_title: str | None = None, other_summary: str | None = None, accept: int = 210, alone: int = 250, anchored: int = 180, margin: int = 22) -> DataFrame:
    """(key, candidate, score, rank, eligible, accepted, confidence): names in an item's titles and summaries, the best by evidence.

    A name scores 110 in the title, 65 in the summary, 85 in the address, 12 a place up
    to 60, 55 with a colon, 75 behind a cue, 30 and 35 at the start; it loses 150 behind
    words of comparison and 100 behind the dash of an update.  Equal scores go by place
    and length.  Names of ``accept`` points with two kinds of evidence (one word: three,
    ``alone``; behind a cue: the summary, ``anchored``) are eligible; the first of them is
    accepted with a lead of ``margin`` over the next.
    """
    texts = _texts(items, key, {"title": title, "summary": summary, "url": url, "other_title": other_title, "other_summary": other_summary}, False)
    found = _matches(texts, key, CONTEXT_PATTERNS, False).filter((F.char_length("norm") >= 4) & ~F.col("norm").rlike(r"^\d+$") & ~F.col("norm").isin(*CONTEXT_NO_TITLE) & ~F.col("name").rlike(_ascii(CONTEXT_SUFFIX)))
    kind = F.col("kind")
    from_title = F.col("order") < 2
    has_colon = (kind == "colon") | (kind.isin("anchor", "leading") & F.col("name").contains(":"))
    folded = found.groupBy(key, "norm").agg(F.max_by("name", F.struct(F.char_length("name"), -F.col("order"), -F.col("nth"))).alias("name"), F.min("at").alias("at"), F.bool_or(has_colon).alias("colon"), F.bool_or(kind == "anchor").alias("anchor"), F.bool_or((kind == "leading") | (from_title & (F.col("at") == 0))).alias("leading"), F.bool_or(kind == "leading").alias("first"))
    seen = _with_evidence(folded, texts, key, CONTEXT_UPDATE, 45).withColumn("before", F.coalesce("before", F.lit("")))
    points = lambda c, n: F.when(c, n).otherwise(0)
    t, s, u = (F.col(n) > 0 for n in ("n_title", "n_summary", "n_url"))
    score = points(t, 110) + points(s, 65) + points(u, 85) + F.least(F.lit(60), 12 * (F.col("n_title") + F.col("n_summary") + F.col("n_url")))
    score += points(F.col("colon"), 55) + points(F.col("anchor"), 75) + points(F.col("leading"), 30) + points(F.col("first"), 35)
    score -= points(F.col("before").rlike(_ascii(CONTEXT_COMPARISON)), 150) + points(F.col("update") & F.substring("before", -3, 3).rlike(r"[-–—]\s*$"), 100)
    free, _ = _ranked(_without_nested(seen.withColumn("score", score), key, F.col("colon") | F.col("anchor"), 10), key)
    one = ~F.col("norm").contains(" ")
    fit = F.when(one & F.col("norm").isin(*CONTEXT_GENERIC), False).when(F.col("anchor"), s & (F.col("score") >= anchored)).when(one, t & s & u & (F.col("score") >= alone)).otherwise(t & (s | u) & (F.col("score") >= accept))
    w = Window.partitionBy(key, "eligible").orderBy("rank")
    led = free.withColumn("eligible", fit).withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    accepted = F.col("eligible") & (F.col("_n") == 1) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin))
    return led.select(key, F.col("name").alias("candidate"), "score", "rank", "eligible", accepted.alias("accepted"), F.least(F.lit(0.94), 0.78 + F.col("score") / 1600).alias("confidence"))


def primary_titles(items: DataFrame, key: str, title: str, summary: str, url: str | None = None, other_title: str | None = None, other_summary: str | None = None, accept: int = 230, margin: int = 30) -> DataFrame:
    """(key, candidate, score, rank, strong, accepted): names behind cues, with colons or capitalised, each match adding its pattern's points.

    Evidence adds 90 in the title, 100 in the summary, 60 in the address; words of
    comparison before the name take 500, of updates 400, a beginning with an action 130
    (300 if no cue is strong), an ordinary word 300.  The first is accepted from
    ``accept`` on with a lead of ``margin``, unless it is compared or an update, is in no
    summary without a strong cue, or is one word with neither address nor strong cue.
    """
    texts = _texts(items, key, {"title": title, "summary": summary, "url": url, "other_title": other_title, "other_summary": other_summary}, True)
    found = _matches(texts, key, PRIMARY_PATTERNS, True)
    kind = F.col("kind")
    valid = found.filter((F.char_length("norm") >= 3) & ~F.col("norm").rlike(r"^\d+$") & ~F.col("norm").isin(*PRIMARY_NO_TITLE) & ~F.col("name").rlike(_ascii(PRIMARY_COLLECTION)) & ~F.col("name").rlike(_ascii(PRIMARY_SUFFIX)))
    # What only a plain "in" says counts if the title says it too.
    sure = (kind != "summary-in") | F.col("name").rlike(_ascii(PRIMARY_CRAFT))
    longest = F.struct(F.char_length("name"), -F.col("order"), -F.col("nth"))
    folded = valid.groupBy(key, "norm", sure.alias("sure")).agg(F.max_by("name", longest).alias("name"), F.max(longest).alias("longest"), F.min("at").alias("at"), F.sum("points").cast("int").alias("points"), F.bool_or(kind.isin("title-cue", "summary-cue", "summary-in", "summary-leading")).alias("strong"), F.bool_or(kind == "title-colon").alias("colon"))
    counted = _with_evidence(folded, texts, key, CONTEXT_UPDATE, 55).filter("sure OR in_own")
    best = F.max_by(F.struct("name", "before"), F.col("longest")).alias("_b")
    seen = counted.groupBy(key, "norm").agg(best, F.min("at").alias("at"), F.sum("points").cast("int").alias("points"), F.bool_or("strong").alias("strong"), F.bool_or("colon").alias("colon"), *(F.max(n).alias(n) for n in ("n_title", "n_summary", "n_url"))).select("*", "_b.*").drop("_b")
    flagged = seen.withColumn("compared", F.coalesce(F.col("before").rlike(_ascii(PRIMARY_COMPARISON)), F.lit(False))).withColumn("updated", F.coalesce(F.substring("before", -45, 45).rlike(_ascii(PRIMARY_UPDATE)), F.lit(False)))
    points = lambda c, n: F.when(c, n).otherwise(0)
    t, s, u = (F.col(n) > 0 for n in ("n_title", "n_summary", "n_url"))
    score = F.col("points") + points(t, 90) + points(s, 100) + points(u, 60) - points(F.col("compared"), 500) - points(F.col("updated"), 400)
    score -= F.when(F.col("name").rlike(_ascii(PRIMARY_ACTION)), F.when(F.col("strong"), 130).otherwise(300)).otherwise(0) + points(F.col("norm").isin(*PRIMARY_GENERIC), 300)
    free, w = _ranked(_without_nested(flagged.withColumn("score", score), key, F.col("strong") | F.col("colon"), 25), key)
    led = free.withColumn("_next", F.lead("score").over(w))
    one = ~F.col("norm").contains(" ")
    accepted = (F.col("rank") == 1) & (F.col("score") >= accept) & ~F.col("compared") & ~F.col("updated") & (~one | u | F.col("strong")) & (s | F.col("strong")) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin))
    return led.select(key, F.col("name").alias("candidate"), "score", "rank", "strong", accepted.alias("accepted"))

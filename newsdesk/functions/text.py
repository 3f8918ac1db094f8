"""Text columns: keys, tokens, set similarity, markup, classification, summaries.

All are native expressions.  Null text gives null keys and empty arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of titles, English and Russian.
STOP_WORDS = (
    "the a an and or but for to of in on with from at by as is are was were will would could should this that these those its it "
    "new news game games gaming "
    "и в во на с со к ко из для о об от по за что как это этот эта эти новый новая новые игра игры игровой"
).split()

#: What makes an item unwanted, and what makes it one about games.
REJECT = (
    "survey|опрос", r"chance to win|win \$|giveaway|розыгрыш|выигра[йт]", "newsletter|subscribe|подписывайтесь|подписка",
    "audience|читател[ья]|редакци[яи]", "podcast|подкаст", "quiz|викторин", "job opening|we(?:'re| are) hiring|ваканси",
    "support us|donate|patreon|поддержать издание", "deal of the day|best deals|скидки дня|распродажа", "gift guide|подарочный гид",
    "letter from the editor|обращение редакции", "future of pc gamer|будущее pc gamer", "review|рецензи[яи]|обзор",
    "opinion|column|колонка|мнение", "movie|film|cinema|anime|сериал|кино|аниме",
)
SIGNALS = (
    r"\bgame\b|\bgames\b|игр[аыеу]|геймпле", "release|launch|релиз|выходит|вышла|вышел", "announce|анонс|представил|показал|трейлер",
    "update|patch|hotfix|обновлен|патч", "dlc|expansion|дополнени", "developer|studio|publisher|разработчик|студи[яи]|издател",
    "steam|valve|playstation|xbox|nintendo|switch|game pass|epic games", "pc|console|консол",
    "rpg|shooter|strategy|simulator|survival|horror|action|adventure|mmorpg",
    "движок|unreal engine|unity|directx|vulkan|proton|steam deck", "gaming gpu|gaming driver|игровой драйвер|игровая видеокарта",
    "sales|copies sold|тираж|продаж", "acquisition|layoffs|закрытие студии|увольнен|поглощени",
    "beta|demo|early access|бета|демоверси|ранний доступ", "esports|киберспорт",
)


def any_of(patterns: Iterable[str]) -> str:
    """One case-insensitive pattern that finds what any of the patterns finds."""
    return "(?iu)(?:" + ")|(?:".join(patterns) + ")"


def _normalised(text: Column, how: str) -> Column:
    """What a function of ICU's Normalizer (a library that Spark ships) makes of a text, by compatibility; ASCII rows keep their text."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(how), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), made).otherwise(text)


def nfkd(text: Column) -> Column:
    """Unicode decomposition, a text at a time where it stands: no worker of Python holds batches of them."""
    return _normalised(text, "decompose")


def nfkc(text: Column) -> Column:
    return _normalised(text, "compose")


def norm_text(text: Column, variant: str = "news", marks: str = "space", normalise: bool = True) -> Column:
    """A key of a text.

    ``variant``: *news* and *registry* keep letters and digits of all scripts,
    *popular* and *home* a-z, digits and Cyrillic, *calendar* ASCII alone.
    ``marks``: combining marks become spaces, or are removed.  ``normalise=False``
    leaves the decomposition out (a native plan, equal on ASCII).
    """
    t = F.regexp_replace(F.lower(text), "[™®©]", "") if variant == "registry" else F.lower(text)
    if normalise:
        t = nfkc(t) if variant == "home" else nfkd(t)
    t = F.regexp_replace(t, "[’'“”\"`]", "") if variant == "news" else t
    t = F.regexp_replace(t, r"\p{M}", "") if marks == "remove" else t
    keep = {"news": r"[^\p{L}\p{N}]+", "registry": r"[^\p{L}\p{N}]+", "popular": "[^a-z0-9а-яё]+", "home": "[^a-z0-9а-яё]+", "calendar": "[^a-z0-9]+"}[variant]
    return F.trim(F.regexp_replace(t, keep, " "))


def title_tokens(key: Column, least: int = 3, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Distinct tokens of a key with ``least`` characters, without stop words."""
    tokens = F.filter(F.split(F.coalesce(key, F.lit("")), " "), lambda t: F.char_length(t) >= least)
    return F.array_distinct(F.array_except(tokens, F.array(*map(F.lit, stop)))) if stop else F.array_distinct(tokens)


def _share(a: Column, b: Column, of: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / of).otherwise(0.0)


def overlap_min(a: Column, b: Column) -> Column:
    """Common elements over those of the smaller set; 0 if one is empty."""
    return _share(a, b, F.least(F.size(a), F.size(b)))


def overlap_max(a: Column, b: Column) -> Column:
    return _share(a, b, F.greatest(F.size(a), F.size(b)))


def coverage(a: Column, b: Column) -> Column:
    """Share of a's elements that b holds; 0 if one is empty."""
    return _share(a, b, F.size(a))


def strip_markup(text: Column) -> Column:
    """Text of HTML: without scripts, styles and tags, entities decoded, runs of white space as one space."""
    t = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        t = F.regexp_replace(t, entity, char)
    t = _numeric_entities(t)
    t = F.regexp_replace(t, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " "))


def _numeric_entities(text: Column) -> Column:
    """&#N; as its character in one pass; codes beyond Unicode go, those of lone surrogates become U+FFFD."""

    def one(piece: Column) -> Column:
        code = F.regexp_extract(piece, r"^0*(\d{1,7});", 1)
        n = F.when(code != "", code.cast("int"))
        char = F.when(n.between(0xD800, 0xDFFF), "\ufffd").when(n <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.hex(F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), 32).otherwise(n)), 8, "0")), "UTF-32")).otherwise("")
        return F.when(piece.rlike(r"^\d+;"), F.concat(char, F.regexp_replace(piece, r"^\d+;", ""))).otherwise(F.concat(F.lit("&#"), piece))

    decoded = F.array_join(F.transform(F.split(text, "&#"), lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")
    return F.when(text.contains("&#"), decoded).otherwise(text)


def relevant(text: Column) -> Column:
    """Whether an item is about games and none of the unwanted kinds."""
    return ~text.rlike(any_of(REJECT)) & text.rlike(any_of(SIGNALS))


#: Kinds of a title, in order of precedence.
KINDS = ("game", "remake", "remaster", "dlc", "expansion", "edition")
_DLC, _REMAKE = r"(?iu)\b(dlc|expansion|season pass|story pack|add[- ]?on)\b", r"(?iu)\b(remake|reimagined)\b"
_REMASTER, _EDITION = r"(?iu)\b(remaster(?:ed)?|definitive edition|hd collection|anniversary edition)\b", r"(?iu)\b(deluxe|ultimate|gold|complete|collector'?s)\b"
#: Fixed value: suffixes of commercial editions.
EDITION_SUFFIX = r"(?iu)\b(?:deluxe|ultimate|gold|complete|collector'?s|digital deluxe|goty|game of the year)\s+edition\b"


def infer_kind(title: Column, explicit: Column | None = None) -> Column:
    """The explicit kind if it is known, else what the title's words say."""
    said = F.when(title.rlike(_DLC), F.when(title.rlike("(?i)expansion"), "expansion").otherwise("dlc")).when(title.rlike(_REMAKE), "remake").when(title.rlike(_REMASTER), "remaster").when(title.rlike(_EDITION), "edition").otherwise("game")
    return said if explicit is None else F.when(F.lower(explicit).isin(*KINDS), F.lower(explicit)).otherwise(said)


def tag_by_rules(text: Column, rules: dict[str, str]) -> Column:
    """Ids of the rules (id to pattern) that a text matches, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?iu){p}"), F.lit(i)) for i, p in rules.items())))


#: Patterns of regions.
REGIONS = {
    "cis": "росси|казахстан|беларус|снг|армени|азербайджан|грузи|кыргыз|молдов|таджик|туркмен|узбекистан|рубл|тенге|vk play",
    "europe": r"европ|евросоюз|\beu\b|великобритан|британи|германи|франци|итали|испан|польш",
    "north-america": r"сша|америк|канад|мексик|\bus\b",
    "japan": "япони|японск",
    "korea": "коре|корейск",
    "china": "кита|китайск|гонконг|тайван",
    "latam": "бразил|аргентин|чили|колумби|перу|латинск.*америк",
    "mena": "ближн.*восток|саудов|эмират|турци|израил|егип",
    "sea": "юго-восточн.*ази|сингапур|малайзи|индонези|таиланд|вьетнам|филиппин",
    "oceania": "австрали|нов.*зеланд",
}


def tag_regions(text: Column) -> Column:
    """Ids of the regions that a text names."""
    return tag_by_rules(text, REGIONS)


def infer_axes(text: Column, axes: dict[str, dict[str, list[str]]], explicit: dict[str, Column] | None = None) -> Column:
    """map<axis, labels>: labels of which the normalised text holds a term; a profile's own labels (arrays, by axis) win over them."""
    entries, said = [], explicit or {}
    for axis, labels in axes.items():
        found = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (text.contains(t) for t in terms)), F.lit(label)) for label, terms in labels.items())))
        entries += [F.lit(axis), F.when(F.size(said[axis]) > 0, said[axis]).otherwise(found) if axis in said else found]
    return F.create_map(*entries)


#: Words that name no franchise.
FRANCHISE_STOP = ("series", "game", "games", "edition", "remastered", "remaster", "complete", "ultimate", "definitive", "deluxe", "simulator", "simulation", "the", "a", "an")


def franchise_term(title: Column) -> Column:
    """A term to search a franchise by: a token like XX-9, else up to three usable words of the last segment that has some, as written.

    Segments are divided by . : ; and dashes; stop words and years are not usable;
    of several segments one needs three characters.
    """
    clean = F.trim(F.regexp_replace(title, "[™®]", ""))
    code = F.regexp_extract(clean, r"(?U)\b(\p{L}{1,10}-\d{1,4})\b", 1)
    key = lambda w: F.trim(F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", " "))
    term = lambda seg: F.array_join(F.slice(F.filter(F.split(F.trim(seg), r"\s+"), lambda w: (key(w) != "") & ~key(w).isin(*FRANCHISE_STOP) & ~w.rlike(r"^(19|20)\d{2}$")), 1, 3), " ")
    segments = F.filter(F.transform(F.split(clean, r"[.:;—–]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    usable = F.filter(F.transform(F.reverse(segments), term), lambda x: F.char_length(x) >= 3)
    return F.when(code != "", code).when(F.size(segments) > 1, F.coalesce(F.try_element_at(usable, F.lit(1)), term(clean))).otherwise(term(clean))


#: What a text ends with that is no part of it.
BOILERPLATE = (
    r"(?is)\s+The post\s+.*?\s+appeared first on\s+.*$",
    r"(?isu)\s+(?:Сообщение|Публикация)\s+.*?\s+впервые\s+появил(?:ось|ась)\s+на\s+.*$",
    r"(?isu)\s+(?:Read|Learn) more\s*(?:[→»›]|\.\.\.)?.*$",
    r"(?isu)\s+(?:Читать|Подробнее)\s*(?:далее)?\s*(?:[→»›]|\.\.\.)?.*$",
    r"(?isu)\s+(?:Subscribe|Sign up|Подпишитесь).*$",
)
#: What adds to a sentence's weight or takes from it.
PROMOTIONAL_LEAD = r"(?iu)^(?:hi|hello|привет|hey\b|we(?:'re| are) (?:excited|thrilled|happy|pleased|delighted)|мы (?:очень )?(?:рады|счастливы)|today we(?:'re| are) (?:excited|thrilled|happy|pleased)|сегодня мы (?:рады|счастливы))"
CALL_TO_ACTION_LATIN = r"\b(?:stay tuned|wishlist|pre-order|preorder|subscribe|visit our|check out|don'?t miss)\b"
CALL_TO_ACTION = rf"(?iu)(?:{CALL_TO_ACTION_LATIN}|следите за|добавляйте? в желаемое|предзаказ|подписывайтесь|заходите)"
KEY_ACTION_LATIN = r"\b(?:release|launch|arriv|announce|reveal|confirm|add|remove|delay|cancel|update|patch|expansion|dlc|beta|demo|sales?|sold|acquir|close|layoff|ship|available)\b"
KEY_ACTION = rf"(?iu)(?:{KEY_ACTION_LATIN}|выход|выйдет|вышел|вышла|релиз|анонс|представ|показа|подтверд|добав|убер|удал|перенес|отмен|обнов|патч|дополнен|бета|демо|продаж|тираж|закры|увольнен|доступ)"
TIME_SIGNAL_LATIN = r"\b(?:today|tomorrow|week|month|year|january|february|march|april|may|june|july|august|september|october|november|december|\d{1,2}[./-]\d{1,2}|20\d{2})\b"
TIME_SIGNAL = rf"(?iu)(?:{TIME_SIGNAL_LATIN}|сегодня|завтра|недел|месяц|год|январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр|\d{{1,2}}[./-]\d{{1,2}}|20\d{{2}})"
PLATFORM_SIGNAL = r"(?i)\b(?:pc|steam|playstation|ps5|xbox|switch|nintendo|game pass|epic games|gog)\b"
WEAK_LEAD = r"(?iu)^(?:\b(?:it|this|that|these|those|he|she|they)\b|это|эта|этот|эти|он|она|они)"
#: Openings that are taken off a sentence.
OPENINGS = (
    r"(?i)^(?:today,?\s*)?we(?:'re| are) (?:excited|thrilled|happy|pleased|delighted) to (?:announce|share|reveal|confirm|show)(?: that)?\s+",
    r"(?iu)^(?:сегодня\s+)?мы (?:очень )?(?:рады|счастливы) (?:сообщить|поделиться|представить|показать|подтвердить)(?:,? что)?\s+",
    r"(?i)^we (?:want|wanted|would like) to (?:share|announce|reveal|confirm)(?: that)?\s+",
    r"(?iu)^мы (?:хотим|хотели бы) (?:сообщить|поделиться|представить|подтвердить)(?:,? что)?\s+",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def _shortened(text: Column, most: int) -> Column:
    """A text of at most ``most`` characters: cut behind its last whole sentence, if that leaves enough, else at a word."""
    part = F.substring(text, 1, most - 1)
    whole = F.regexp_extract(part, r"(?s)^(.*[.!?]) ", 1)
    word = F.regexp_extract(part, r"(?s)^(.*) ", 1)
    cut = F.when(F.char_length(whole) - 1 >= min(120, most * 0.45), F.trim(whole)).otherwise(F.concat(F.trim(F.when(F.char_length(word) > 80, word).otherwise(part)), F.lit("…")))
    return F.when(F.char_length(text) <= most, text).otherwise(cut)


def editorial_summary(text: Column, title: Column, most: int = 520, sentences: int = 3) -> Column:
    """The leading sentence of a text and up to two more in their order, of at most ``most`` characters.

    Boilerplate at the end goes.  A sentence of 24 characters or more scores
    max(0, 4 - 0.45 i) for its place i, 5 for an action, 2.2 for a time, 1.4 for a
    platform, 1.1 for a digit, up to 3 for words of the title, 1.4 for a length of 70
    to 260; promotion costs 5, a call to action 6, a weak pronoun in front 1.5.  Calls
    to action don't stand, announcing openings are taken off.  Null and empty texts
    give an empty summary.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for entity, char in (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        t = F.regexp_replace(t, entity, char)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\[\s*(?:…|\.\.\.)\s*\]", " "), r"\s+", " "))
    for pattern in BOILERPLATE:
        t = F.trim(F.regexp_replace(t, pattern, ""))
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: F.char_length(w) >= 4))
    has = lambda s, pattern, points: F.when(s.rlike(pattern), points).otherwise(0.0)
    # Texts without a Cyrillic letter need no pattern's Cyrillic half.
    holds = lambda s, cyrillic, pattern, latin: F.when(cyrillic, s.rlike(pattern)).otherwise(s.rlike(f"(?iu)(?:{latin})"))

    def points(s: Column, i: Column, named: Column, cyrillic: Column) -> Column:
        action = holds(s, cyrillic, KEY_ACTION, KEY_ACTION_LATIN)
        time = holds(s, cyrillic, TIME_SIGNAL, rf"{TIME_SIGNAL_LATIN}|\d{{1,2}}[./-]\d{{1,2}}|20\d{{2}}")
        base = F.greatest(F.lit(0.0), 4 - i * 0.45) + F.when(action, 5.0).otherwise(0.0) + F.when(time, 2.2).otherwise(0.0) + has(s, PLATFORM_SIGNAL, 1.4) + has(s, r"\d", 1.1)
        base = base + F.least(F.lit(3.0), 5 * coverage(named, words(s))) + F.when(F.char_length(s).between(70, 260), 1.4).otherwise(0.0)
        return base + has(s, PROMOTIONAL_LEAD, -5.0) - F.when(holds(s, cyrillic, CALL_TO_ACTION, CALL_TO_ACTION_LATIN), 6.0).otherwise(0.0) + has(s, WEAK_LEAD, -1.5)

    def plain(s: Column) -> Column:
        for pattern in OPENINGS:
            s = F.regexp_replace(s, pattern, "")
        # One letter becomes one letter: where its capital is several, it stays, but ß has one.
        first = F.substring(s, 1, 1)
        capital = F.when(first == "ß", "ẞ").when(F.char_length(F.upper(first)) == 1, F.upper(first)).otherwise(first)
        return F.trim(F.concat(capital, F.substring(s, 2, 1 << 20)))

    def scored(t: Column, named: Column, cyrillic: Column) -> Column:
        cut = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"([^.!?…]+(?:[.!?…]+|$))"), F.lit(1)), lambda s: F.trim(s)), lambda s: F.char_length(s) >= 24)
        rows = F.transform(cut, lambda s, i: F.struct((F.lit(0.0) - F.round(points(s, i, named, cyrillic), 6)).alias("p"), i.alias("i"), plain(s).alias("s")))
        return F.filter(rows, lambda x: (F.char_length(x["s"]) >= 24) & ~holds(x["s"], cyrillic, CALL_TO_ACTION, CALL_TO_ACTION_LATIN))

    def more(acc: Column, x: Column) -> Column:
        fits = (acc["n"] < sentences) & (F.char_length(acc["s"]) + 1 + F.char_length(x["s"]) <= most)
        return F.when(fits, F.struct((acc["n"] + 1).alias("n"), F.concat_ws(" ", acc["s"], x["s"]).alias("s"), F.concat(acc["took"], F.array(x["i"])).alias("took"))).otherwise(acc)

    def chosen(good: Column) -> Column:
        def led(lead: Column) -> Column:
            rest = F.filter(good, lambda x: (x["i"] != lead["i"]) & (x["p"] < 1))
            return F.aggregate(rest, F.struct(F.lit(1).alias("n"), lead["s"].alias("s"), F.array(lead["i"]).alias("took")), more)

        def finished(picked: Column) -> Column:
            left = F.filter(good, lambda x: ~F.array_contains(picked["took"], x["i"]))
            short = (F.char_length(picked["s"]) < 80) & (F.size(left) > 0)
            longer = _let(F.concat_ws(" ", picked["s"], F.try_element_at(left, F.lit(1))["s"]), lambda x: F.when(F.char_length(x) <= most, x).otherwise(picked["s"]))
            return F.when(short, longer).otherwise(picked["s"])

        # The best score comes first, then the first place.
        return _let(_let(F.array_min(good), led), finished)

    whole = lambda t: _let(_let(F.struct(words(F.coalesce(title, F.lit(""))).alias("w"), t.rlike("[\u0400-\u04FF]").alias("c")), lambda x: scored(t, x["w"], x["c"])), lambda good: F.when(F.size(good) > 0, chosen(good)).otherwise(t))
    return _let(t, lambda x: F.when(x == "", "").otherwise(_let(whole(x), lambda out: _shortened(out, most))))


def record_quality(title: Column, **present: Column) -> Column:
    """Points of a record: one for each field that holds something, ten off for a technical title."""
    filled = sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in present.values()), F.lit(0))
    return filled - F.when(title.rlike(r"(?i)^(app|test|untitled|game)[ _-]?\d+$"), 10).otherwise(0)


def article_metrics(text: Column) -> Column:
    """struct of word, sentence and image counts of an article, and of repeated links."""
    links = F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>]+)"), F.lit(1))
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.struct(words.alias("words"), F.size(F.regexp_extract_all(text, F.lit(r"[.!?](?:\s|$)"), F.lit(0))).alias("sentences"), F.size(F.regexp_extract_all(text, F.lit(r"(?i)<img\b"), F.lit(0))).alias("images"), (F.size(links) - F.size(F.array_distinct(links))).alias("repeated_links"))

"""Summaries against a plain computation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from newsdesk.functions import text as T
from newsdesk.plans.registry import table

SF = "/root/testdata/sf0.001"


def plain(pattern):
    """The Java pattern for Python: ASCII classes, case folding of all scripts."""
    return re.compile(re.sub(r"^\(\?[isu]+\)", "", pattern), re.I | (re.S if re.match(r"\(\?[iu]*s", pattern) else 0))


def words(t):
    return {w for w in re.sub(r"[^\w]|_", " ", t.lower()).split() if len(w) >= 4}


def shortened(t, most):
    if len(t) <= most:
        return t
    part = t[: most - 1]
    at = max(part.rfind(x) for x in (". ", "! ", "? "))
    if at >= min(120, most * 0.45):
        return part[: at + 1].strip()
    word = part.rfind(" ")
    return f"{part[: word if word > 80 else len(part)].strip()}…"


def summary(text, title, most=520, sentences=3):
    t = re.sub("<[^>]+>", " ", text or "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        t = re.sub(entity, char, t, flags=re.I)
    t = re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"\[\s*(?:…|\.\.\.)\s*\]", " ", t)).strip(" ")
    for p in T.BOILERPLATE:
        t = plain(p).sub("", t).strip(" ")
    if not t:
        return ""
    named, good = words(title or ""), []
    cut = [s for x in re.findall(r"[^.!?…]+(?:[.!?…]+|$)", t) if len(s := x.strip(" ")) >= 24]
    for i, s in enumerate(cut):
        score = max(0.0, 4 - i * 0.45)
        for p, points in ((T.KEY_ACTION, 5), (T.TIME_SIGNAL, 2.2), (T.PLATFORM_SIGNAL, 1.4), (r"[0-9]", 1.1), (T.PROMOTIONAL_LEAD, -5), (T.CALL_TO_ACTION, -6), (T.WEAK_LEAD, -1.5)):
            score += points if plain(p).search(s) else 0
        score += min(3, 5 * len(named & words(s)) / len(named)) if named and words(s) else 0
        score += 1.4 if 70 <= len(s) <= 260 else 0
        for p in T.OPENINGS:
            s = plain(p).sub("", s)
        s = (s[:1].upper() + s[1:]).strip(" ")
        if len(s) >= 24 and not plain(T.CALL_TO_ACTION).search(s):
            good.append((-round(score, 6), i, s))
    if not good:
        return shortened(t, most)
    lead = min(good)
    took, out = [lead], lead[2]
    for x in good:
        if x is not lead and x[0] < 1 and len(took) < sentences and len(out) + 1 + len(x[2]) <= most:
            took.append(x)
            out += f" {x[2]}"
    left = [x for x in good if x not in took]
    if len(out) < 80 and left and len(out) + 1 + len(left[0][2]) <= most:
        out += f" {left[0][2]}"
    return shortened(out, most)


ODD = [
    "We are thrilled to announce that the new expansion launches on PC in March 2026. Stay tuned and wishlist it now on the store. It is the biggest one so far for all of us here. A patch was released yesterday for the console version of the game.",
    "<p>Studio &amp; friends: a demo is available today on Steam &nbsp; for everyone.</p> The post Something here appeared first on Some Site. More",
    "Сегодня мы рады сообщить, что релиз игры перенесён на октябрь. Подробнее → читайте на сайте",
    "short. tiny! no?", "", None, "word " * 300, "One sentence without an end that goes on and on and names nothing in particular",
    "Hello players of this game, what a long time it was. Check out the store page of our game. They said that nothing would change at all in it.",
]


def test_summaries_equal_a_plain_computation(spark):
    rows = [(i, t, "Expansion launches for players today") for i, t in enumerate(ODD)]
    rows += [(100 + r.doc_id, r.text, (r.text or "").split(".")[0]) for r in table(spark, SF, "documents").collect()]
    df = spark.createDataFrame(rows, "id long, t string, title string")
    for most, sentences in ((520, 3), (120, 2)):
        got = {r.id: r.s for r in df.select("id", T.editorial_summary(F.col("t"), F.col("title"), most, sentences).alias("s")).collect()}
        assert len(got) == len(rows)
        for i, t, title in rows:
            assert got[i] == summary(t, title, most, sentences), (i, most)


def test_sections_use_one_of_a_duplicate_group(spark):
    from newsdesk.operators import topk

    rows = [("a", "s1", 1, 9.0, "x"), ("a", "s1", 2, 8.0, "x"), ("a", "s1", 3, 7.0, None), ("a", "s2", 2, 9.0, "x"), ("a", "s2", 4, 1.0, "y")]
    media = spark.createDataFrame(rows, "article string, section string, media_id long, score double, duplicate_group string")
    assert {(r.section, r.media_id) for r in topk.section_fill(media, "article", 1, 2).collect()} == {("s1", 1), ("s1", 3), ("s2", 4)}

"""Ratings: votes, critics, awards, acceptance of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import keep_first
from .topk import walk_groups


def vote_totals(votes: DataFrame, game: str, rating: str) -> DataFrame:
    """Votes and their mean (two decimals) per game; ratings outside 1 to 10 don't count."""
    return votes.filter(F.col(rating).between(1, 10)).groupBy(game).agg(F.count(F.lit(1)).alias("votes"), (F.floor(F.avg(rating) * 100 + 0.5) / 100).alias("mean"))


def critic_median(scores: DataFrame, game: str, source: str, score: str, least: int = 3) -> DataFrame:
    """Median of one score a source and a tenth of it, null with fewer than ``least`` sources; of a source the highest counts."""
    one = scores.groupBy(game, source).agg(F.max(score).alias("_s"))
    g = one.groupBy(game).agg(F.count(F.lit(1)).alias("sources"), F.median("_s").alias("_m"))
    return g.select(game, "sources", F.when(F.col("sources") >= least, F.col("_m")).alias("median"), F.when(F.col("sources") >= least, F.col("_m") / 10).alias("score"))


def publication_mean(scores: DataFrame, game: str, publication: str, order: list[Column], value: str, least: int, most: int) -> DataFrame:
    """Mean of the first score of each publication, of at most ``most``; status green with ``least`` or more, else red."""
    from .topk import cap_by_group

    one = cap_by_group(keep_first(scores, [game, publication], order), game, order, most)
    return one.groupBy(game).agg(F.count(F.lit(1)).alias("sources"), F.avg(value).alias("mean")).withColumn("status", F.when(F.col("sources") >= least, "green").otherwise("red"))


def weighted_score(scores: DataFrame, game: str, score: Column, scale: Column, weight: Column, accepted: Column, order: list[Column] | None = None) -> DataFrame:
    """Weighted mean on 100 (one decimal) of accepted scores; weights are 0.1 at least, values held within 0 and 100.

    With ``order`` a game's doubles are added in that order, so that a mean between
    two tenths is rounded alike however the rows are dealt.
    """
    rows = scores.filter(accepted & (scale > 0)).select(game, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score / scale * 100)).alias("_v"), F.greatest(F.lit(0.1), F.coalesce(weight, F.lit(1.0))).alias("_w"), *(c.alias(f"_o{i}") for i, c in enumerate(order or [])))
    sums = [F.sum(F.col("_v") * F.col("_w")), F.sum("_w")]
    if order:
        # Running sums in a window are added row by row; the last ones are the game's.
        by = Window.partitionBy(game).orderBy(*(f"_o{i}" for i in range(len(order))))
        so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.select(game, F.row_number().over(by).alias("_i"), *(x.over(so_far).alias(n) for x, n in zip(sums, ("_p", "_q"), strict=True)))
        sums = [F.max_by("_p", "_i"), F.max_by("_q", "_i")]
    return rows.groupBy(game).agg(F.count(F.lit(1)).alias("n"), (F.floor(sums[0] / sums[1] * 10 + 0.5) / 10).alias("score"))


def awards(rows: DataFrame, game: str, required: list[str], unique: list[str], listed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(per game its awards, rejected rows): rows need all required fields, and count once by ``unique``."""
    ok = F.lit(True)
    for c in required:
        ok = ok & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    good = rows.filter(ok).dropDuplicates([game, *unique])
    return good.groupBy(game).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*listed))).alias("awards")), rows.filter(~ok)


def source_reasons(terms: list[str], domains: list[str], url: str = "url", title: str = "title", publication: str = "publication", score: str = "score", scale: str = "scale", grade: str = "grade") -> Column:
    """What speaks against a source by itself, as an array of reasons.

    No publication or web address; a forbidden term in title or address, else a
    forbidden domain (or one below it); an address of fewer than two path segments;
    neither a score on a scale above 0 nor a grade.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    hay = F.lower(F.concat_ws(" ", text(title), text(url)))
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(text(url), F.lit("HOST")), F.lit(""))), r"^www\.", "")
    path = F.coalesce(F.try_parse_url(text(url), F.lit("PATH")), F.lit(""))
    term = F.lit(False)
    for t in terms:
        term = term | F.contains(hay, F.lit(t.lower()))
    domain = F.lit(False)
    for d in domains:
        domain = domain | (host == d.lower()) | F.endswith(host, F.lit(f".{d.lower()}"))
    rated = F.col(score).try_cast("double").isNotNull() & (F.coalesce(F.col(scale).try_cast("double"), F.lit(0.0)) > 0)
    return F.array_compact(F.array(
        F.when((text(publication) == "") | ~F.startswith(text(url), F.lit("http")), "missing"),
        F.when(term, "forbidden_term").when(domain, "forbidden_domain"),
        F.when(~F.startswith(text(url), F.lit("http")) | (F.size(F.filter(F.split(path, "/"), lambda x: x != "")) < 2), "shallow_path"),
        F.when(~rated & (text(grade) == ""), "no_score"),
    ))


def accept_sources(rows: DataFrame, game: str, order: str, maximum: int) -> DataFrame:
    """rows(game, order, url, publication, blocked) with accepted and reason, decided in order within a game.

    With a column ``reasons`` (source_reasons) instead of ``blocked``, all reasons are
    named, comma-joined, those of the order (duplicates) first.  A rejected row blocks
    neither its address nor its publication, so the walk is sequential; a game has a
    bounded list of sources.
    """
    named = "reasons" in rows.columns

    def walk(group: list) -> list:
        urls: set = set()
        publications: set = set()
        out = []
        for row in sorted(group, key=lambda x: (x["o"], x["url"], x["publication"], x["own"])):
            again = ["duplicate_url"] * (row["url"] in urls) + ["duplicate_publication"] * (row["publication"] in publications)
            if named:
                reason = ",".join(again + row["own"]) or ("maximum" if len(urls) >= maximum else "")
            else:
                reason = "blocked" if row["own"] else again[0] if again else "maximum" if len(urls) >= maximum else ""
            if not reason:
                urls.add(row["url"])
                publications.add(row["publication"])
            out.append((row["g"], row["o"], row["url"], not reason, reason))
        return out

    kinds = dict(rows.dtypes)
    few = rows.select(F.col(game).alias("g"), F.col(order).alias("o"), F.col("url").cast("string").alias("url"), "publication", F.col("reasons" if named else "blocked").alias("own"))
    made = walk_groups(few.withColumn("_k", F.col("g")), "_k", ["g", "o", "url", "publication", "own"], walk, f"g {kinds[game]}, o {kinds[order]}, url string, accepted boolean, reason string")
    return made.withColumnsRenamed({"g": game, "o": order})


def source_gate(decided: DataFrame, game: str, contemporary: Column, minimum: int, least_contemporary: int) -> DataFrame:
    """Per game of decided sources: accepted, contemporary, green, needs_more.

    Green with ``minimum`` accepted ones, of which ``least_contemporary`` (or all, if they are fewer) are contemporary.
    """
    g = decided.groupBy(game).agg(F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & contemporary).alias("contemporary"))
    green = (F.col("accepted") >= minimum) & (F.col("contemporary") >= F.least(F.lit(least_contemporary), F.col("accepted")))
    return g.withColumn("green", green).withColumn("needs_more", F.greatest(F.lit(0), F.lit(minimum) - F.col("accepted")))

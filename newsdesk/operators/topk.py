"""Ranked lists: caps by group, floors, fills, mixes, and greedy caps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import release, stored

#: Rows that a walk in one task takes at most.
WALK = 100_000


def walk_groups(df: DataFrame, key: str, columns: list[str], walk: Callable[[list], list], schema: str) -> DataFrame:
    """Rows that ``walk`` makes of each group's rows (dicts of ``columns``): sequential in a group, parallel over groups.

    A group's rows become one array, so many small groups share an Arrow batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [r for group in batch.column("g").to_pylist() for r in walk(group)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct(*columns)).alias("g")).select("g").mapInArrow(run, schema)


def top(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows with their rank; only n rows meet in one task."""
    few = df.orderBy(*order).limit(n)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def cap_by_group(df: DataFrame, group: str | list[str], order: list[Column], most: int, limit: int | None = None) -> DataFrame:
    """At most ``most`` rows of each group in order, then the first ``limit`` of all.

    Equal to walking the order and skipping full groups: a skipped row never
    counts for another group.
    """
    groups = [group] if isinstance(group, str) else group
    kept = df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def daily_cap(df: DataFrame, day: str, manual: Column, order: list[Column], cap: int) -> DataFrame:
    """df with ``day_rank`` and ``status``: manual rows first; beyond the cap "review" unless manual, else "public"."""
    w = Window.partitionBy(day).orderBy(manual.desc(), *order)
    return df.withColumn("day_rank", F.row_number().over(w)).withColumn("status", F.when((F.col("day_rank") > cap) & ~manual, "review").otherwise("public"))


def places(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's place from 1 in its group (``by`` may be empty), by ``order``.

    Rows are dealt by ranges of group and order, and numbered in a range; the rows
    of the ranges before it are added.  So no task holds a group.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = stored(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_b"))
    local = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order)))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return local.join(before, same).select(*df.columns, (F.col("_n") + F.col("_b")).alias(name))


def first_walked(rows: DataFrame, order: list[str], walk: Callable[[Iterator[tuple], bool], list], columns: list[str], schema: str, most: int) -> DataFrame:
    """What ``walk`` makes of the first ``most`` rows in order, as tuples of ``columns``; it is told whether these are all."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]):
        met = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
        if made := walk(met, len(met) < most):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return rows.orderBy(*order).limit(most).select(*columns).mapInArrow(run, schema)


def greedy_dates(df: DataFrame, key: str, dates: str, rank: str, per_day: int, pool: int | None = None, walk: int = WALK) -> DataFrame:
    """Keys taken in order of rank unless one of their dates is full; at most ``pool`` of them.

    A key that is skipped uses none of its dates, so the order matters where a key
    has several.  Decided in rounds, each written: an undecided key is taken if on
    every one of its dates fewer undecided keys precede it than there is room for,
    whatever becomes of those, and skipped if a date is full.  Besides, each round
    decides the undecided keys of the first ``walk`` rows one after the other, in
    one task: they depend on none behind them.  So keys that wait for each other in
    long chains take a round for some ``walk`` of them, others hardly any.
    """
    rows = df.select(F.col(key).alias("k"), F.array_distinct(dates).alias("d"), F.col(rank).alias("r")).filter(F.size("d") > 0)
    numbered = stored(rows.withColumn("i", F.monotonically_increasing_id()))
    lines = stored(numbered.select("k", "r", "i", F.size("d").alias("n"), F.explode("d").alias("d")))
    release(numbered)
    by_rank = Window.partitionBy("d").orderBy("r", "k", "i")
    taken, used = stored(lines.select("k", "r").limit(0)), stored(lines.select(F.col("d").alias("_d"), F.lit(0).alias("u")).limit(0))

    def in_order(met: list[tuple], all_of: bool) -> list[tuple]:
        keys: dict = {}
        for i, k, r, d, u in met:
            keys.setdefault(i, (k, r, []))[2].append((d, u))
        if not all_of:
            keys.popitem()  # its dates may be cut off
        full: dict = {}
        out = []
        for i, (k, r, own) in keys.items():
            ok = all(full.setdefault(d, u) < per_day for d, u in own)
            if ok:
                for d, _ in own:
                    full[d] += 1
            out.append((i, k, r, ok))
        return out

    kinds = dict(lines.dtypes)
    while not lines.isEmpty():
        room = lines.join(used, lines["d"].eqNullSafe(used["_d"]), "left").withColumn("u", F.coalesce("u", F.lit(0)))
        first = lines.withColumn("place", F.row_number().over(by_rank)).filter(F.col("place") <= per_day)
        first = first.join(used, first["d"].eqNullSafe(used["_d"]), "left").filter(F.col("place") <= per_day - F.coalesce("u", F.lit(0)))
        fit = first.groupBy("i", "k", "r", "n").agg(F.count(F.lit(1)).alias("ok")).filter("ok = n").select("i", "k", "r", F.lit(True).alias("taken"))
        walked = first_walked(room, ["r", "k", "i"], in_order, ["i", "k", "r", "d", "u"], f"i long, k {kinds['k']}, r {kinds['r']}, taken boolean", walk)
        new = stored(fit.unionByName(walked).distinct())
        old_taken, taken = taken, stored(taken.unionByName(new.filter("taken").select("k", "r")))
        more = lines.join(new.filter("taken").select("i"), "i", "left_semi").select(F.col("d").alias("_d"), F.lit(1).alias("u"))
        old_used, used = used, stored(used.unionByName(more).groupBy("_d").agg(F.sum("u").cast("int").alias("u")))
        full = used.filter(F.col("u") >= per_day)
        out = lines.join(full, lines["d"].eqNullSafe(full["_d"]), "left_semi").select("i").unionByName(new.select("i")).distinct()
        old_lines, lines = lines, stored(lines.join(out, "i", "left_anti"))
        release(old_taken, old_used, old_lines, new)
    release(used, lines)
    if pool is not None:
        taken = taken.orderBy("r", "k").limit(pool)
    return taken.select(F.col("k").alias(key), F.col("r").alias(rank))


def carry_over(current: DataFrame, previous: DataFrame, key: str, order: list[Column], slots: int) -> DataFrame:
    """current, and of previous as many rows with new keys as slots are left; ``carried`` tells them apart."""
    fill = previous.join(current.select(key), key, "left_anti").select(current.columns)
    both = current.withColumn("carried", F.lit(False)).unionByName(fill.withColumn("carried", F.lit(True)))
    return both.orderBy("carried", *order).limit(slots)


def public_floor(df: DataFrame, key: str, public: str, order: list[Column], least: int) -> DataFrame:
    """df with the best rows that aren't public made so until there are ``least``; at most that many rows are ranked."""
    have = df.agg(F.count_if(F.col(public)).alias("_have"))
    best = top(df.filter(~F.col(public)), order, least, "_n").crossJoin(F.broadcast(have)).filter(F.col("_n") <= least - F.col("_have")).select(key, F.lit(True).alias("_up"))
    return df.join(best, key, "left").withColumn("promoted", F.coalesce("_up", F.lit(False))).withColumn(public, F.col(public) | F.col("promoted")).drop("_up")


def live_window(df: DataFrame, ts: str, as_of: Column, days: int, least: int, fallback: int, order: list[Column]) -> DataFrame:
    """Rows of the last days; if there are fewer than ``least``, the newest max(least, fallback)."""
    recent = df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))
    enough = recent.agg((F.count(F.lit(1)) >= least).alias("_enough"))
    newest = df.orderBy(*order).limit(max(least, fallback))
    return recent.crossJoin(F.broadcast(enough)).filter("_enough").drop("_enough").unionByName(newest.crossJoin(F.broadcast(enough)).filter("NOT _enough").drop("_enough"))


def regional_mix(df: DataFrame, key: str, regional: Column, order: list[Column], size: int, reserved: int) -> DataFrame:
    """The first rows of all, of which up to ``reserved`` places go to regional rows that didn't make it."""
    first = top(df, order, size, "_n")
    extra = top(df.filter(regional).join(first.select(key), key, "left_anti"), order, reserved, "_n")
    n = extra.agg(F.count(F.lit(1)).alias("_k"))
    head = first.crossJoin(F.broadcast(n)).filter(F.col("_n") <= size - F.col("_k")).drop("_k").withColumn("mixed", F.lit(False))
    return head.unionByName(extra.withColumn("mixed", F.lit(True))).withColumnRenamed("_n", "place")


def group_members(df: DataFrame, by: Column, name: str, order: list[str], members: list[str]) -> DataFrame:
    """One row a group with its size and its members in order (calendar days, months, series)."""
    listed = F.array_sort(F.collect_list(F.struct(*order, *[m for m in members if m not in order])))
    return df.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"), listed.alias("members"))


def best_rank(rankings: DataFrame, key: str, position: str) -> DataFrame:
    """The best position of each key over several rankings, and in how many it stands."""
    return rankings.groupBy(key).agg(F.min(position).alias("best_rank"), F.count(F.lit(1)).alias("rankings"))


def recent_and_upcoming(df: DataFrame, day: str, as_of: Column, expectation: str, key: str, recent_days: int = 14, recent: int = 4, size: int = 12) -> DataFrame:
    """Up to ``recent`` rows of the last days, newest first, then upcoming ones by date and expectation, ``size`` in all."""
    past = df.filter((F.col(day) <= as_of) & (F.col(day) >= F.date_sub(as_of, recent_days)))
    past = top(past, [F.col(day).desc(), F.col(expectation).desc(), F.col(key)], recent, "place").withColumn("class", F.lit("recent"))
    ahead = top(df.filter(F.col(day) > as_of), [F.col(day), F.col(expectation).desc(), F.col(key)], size, "place").withColumn("class", F.lit("upcoming"))
    return past.unionByName(ahead).orderBy("class", "place").limit(size)


def section_fill(media: DataFrame, article: str, least: int = 3, most: int = 6) -> DataFrame:
    """(article, section, media_id): sections are filled in turn, each up to ``least``, then up to ``most``; a medium once.

    media(article, section, media_id, score) may offer a medium to several
    sections; with a column ``duplicate_group``, of a group's media only one is used.
    The walk is sequential in an article and parallel over articles.
    """
    same = "duplicate_group" if "duplicate_group" in media.columns else "media_id"

    def walk(group: list) -> list:
        used: set = set()
        out = []
        rows = sorted(group, key=lambda x: (-x["score"], x["media_id"]))
        sections = sorted({x["section"] for x in rows})
        count = dict.fromkeys(sections, 0)
        for limit in (least, most):
            for s in sections:
                for row in rows:
                    if row["section"] == s and count[s] < limit and row["same"] not in used:
                        used.add(row["same"])
                        count[s] += 1
                        out.append((row["article"], s, row["media_id"]))
        return out

    kinds = dict(media.dtypes)
    rows = media.withColumn("article", F.col(article)).withColumn("same", F.coalesce(F.col(same).cast("string"), F.col("media_id").cast("string")))
    out = walk_groups(rows, article, ["article", "section", "media_id", "score", "same"], walk, f"article {kinds[article]}, section {kinds['section']}, media_id {kinds['media_id']}")
    return out.withColumnRenamed("article", article)


def source_share(selected: DataFrame, article: str, source: str) -> DataFrame:
    """Per article: media, sources, and the largest source's share."""
    per = selected.groupBy(article, source).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(article).agg(F.sum("n").alias("media"), F.count(F.lit(1)).alias("sources"), (F.max("n") / F.sum("n")).alias("largest_share"))


def media_gate(selected: DataFrame, article: str, source: str, url: str, section: str, total: int, unique: int, sources: int = 5, share: float = 0.35, least: int = 1) -> DataFrame:
    """Per article of selected media: passed, with media, unique addresses, sources, the largest source's share and the smallest section.

    No medium twice, enough media and sources, no source with more than ``share``,
    and ``least`` media in every section.
    """
    per = selected.groupBy(article).agg(F.count(F.lit(1)).alias("media"), F.count_distinct(url).alias("unique"))
    smallest = selected.groupBy(article, section).agg(F.count(F.lit(1)).alias("n")).groupBy(article).agg(F.min("n").alias("smallest_section"))
    full = per.join(source_share(selected, article, source).select(article, "sources", "largest_share"), article).join(smallest, article)
    ok = (F.col("media") >= total) & (F.col("unique") == F.col("media")) & (F.col("unique") >= unique) & (F.col("sources") >= sources) & (F.col("largest_share") <= share) & (F.col("smallest_section") >= least)
    return full.withColumn("passed", ok)

"""The content ledger: selection, revisions, upserts, drift, change detection, readiness."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import release, stored
from .dedup import latest


def content_hash(columns: list[str | Column]) -> Column:
    """sha256 of a row's document; columns in the order given, null as null."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def select_news(events: DataFrame, sources: DataFrame, links: DataFrame, key: str, source: str, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of events with their sources in order: official ones first, then by name.

    Sources are gathered once per event before the join.  links(key, source), sources(source, name, official).
    """
    joined = links.join(sources, source, "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct((~F.col("official")).alias("late"), "name"))), lambda x: x["name"])
    per = joined.groupBy(key).agg(F.array_join(listed, "|").alias("sources"), F.count(F.lit(1)).alias("n_sources"))
    return events.join(per, key, "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0))).orderBy(*order).offset(page * size).limit(size)


def drift(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): missing, extra or mismatched rows of actual against expected; equal rows are left out."""
    both = expected.select(key, F.col(digest).alias("_e")).join(actual.select(key, F.col(digest).alias("_a")), key, "full_outer")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_e") != F.col("_a"), "mismatched")
    return both.select(key, status.alias("status")).filter("status IS NOT NULL")


#: Children of a node of a digest tree.
FANOUT = 16


def write_digest_tree(df: DataFrame, key: str, digest: str, path: str, depth: int = 3) -> None:
    """Writes (key, digest) of df below ``path``: ``rows`` in a folder a leaf, ``nodes`` with the digests of all levels.

    A leaf holds the keys of one of FANOUT ** depth hash ranges; a node's digest sums
    its rows' 128-bit hashes in two halves, so it needs no order and each level adds up the one
    below.  Depth 3 suits up to some billion rows, each level more sixteen times that.
    Rows without key take no part; repeated rows count as often as they occur.
    """
    depth = max(1, min(depth, 7))
    leaf = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FANOUT**depth)).cast("int")
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key), F.col(digest).alias("digest"), leaf.alias("leaf"))
    rows.repartition("leaf").write.partitionBy("leaf").parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.createDataFrame([(depth, rows.schema.json())], "depth int, fields string").coalesce(1).write.parquet(f"{path}/tree")
    line = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.coalesce(F.col("digest").cast("string"), F.lit("null"))))
    half = lambda at: F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(38,0)")
    sums = lambda a, b, n: (F.sum(a).cast("decimal(38,0)").alias("a"), F.sum(b).cast("decimal(38,0)").alias("b"), F.sum(n).alias("n"))
    lowest = stored(_tree_rows(spark, path)[1].groupBy(F.col("leaf").alias("node")).agg(*sums(half(1), half(17), F.lit(1))))
    levels = [lowest.withColumn("level", F.lit(depth))]
    for at in range(depth - 1, -1, -1):
        levels.append(levels[-1].groupBy(F.shiftright("node", 4).alias("node")).agg(*sums("a", "b", "n")).withColumn("level", F.lit(at)))
    reduce(DataFrame.unionByName, levels).write.parquet(f"{path}/nodes")
    release(lowest)


def _tree_rows(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Depth and rows(key, digest, leaf) of a digest tree."""
    tree = spark.read.parquet(f"{path}/tree").first()
    return tree["depth"], spark.read.schema(StructType.fromJson(json.loads(tree["fields"]))).parquet(f"{path}/rows")


def differing_leaves(spark: SparkSession, expected: str, actual: str) -> list[int]:
    """Leaves of two digest trees of equal depth whose rows differ: from the root, only children of differing nodes are looked at.

    The list has FANOUT ** depth numbers at most, whatever the number of rows.
    """
    trees = [spark.read.parquet(f"{path}/nodes") for path in (expected, actual)]
    depths = [_tree_rows(spark, path)[0] for path in (expected, actual)]
    if depths[0] != depths[1]:
        raise ValueError(f"digest trees of depth {depths[0]} and {depths[1]}")
    nodes = [0]
    for level in range(depths[0] + 1):
        e, a = (t.filter((F.col("level") == level) & F.col("node").isin(nodes)).select("node", F.struct("a", "b", "n").alias(name)) for t, name in zip(trees, "ea", strict=True))
        found = [r["node"] for r in e.join(a, "node", "full_outer").filter(~F.col("e").eqNullSafe(F.col("a"))).select("node").collect()]
        if not found or level == depths[0]:
            return sorted(found)
        nodes = [FANOUT * n + i for n in found for i in range(FANOUT)]
    return []


def drift_by_tree(spark: SparkSession, expected: str, actual: str, key: str) -> DataFrame:
    """``drift`` of two tables written as digest trees; rows of leaves with equal digests are not read."""
    leaves = differing_leaves(spark, expected, actual)
    sides = (_tree_rows(spark, path)[1].filter(F.col("leaf").isin(leaves)) for path in (expected, actual))
    return drift(*sides, key, "digest")


def append_revisions(ledger: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """New revisions of incoming rows whose digest is not the latest of their entity: (key, revision_no, digest)."""
    last = latest(ledger.select(key, "revision_no", digest), [key], ["revision_no"]).select(key, F.col("revision_no").alias("_no"), F.col(digest).alias("_d"))
    changed = incoming.join(last, key, "left").filter(F.col("_d").isNull() | (F.col("_d") != F.col(digest)))
    return changed.select(key, (F.coalesce("_no", F.lit(0)) + 1).alias("revision_no"), digest)


def upsert_keeping(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """new over old by key; in the columns ``keep`` a null or empty new value leaves the old one.  Rows of old never go."""
    columns = [c for c in old.columns if c != key]
    o = old.select(key, F.lit(True).alias("_o"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    n = new.select(key, F.lit(True).alias("_n"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    empty = lambda c: F.col(f"_n_{c}").isNull() | (F.col(f"_n_{c}").cast("string") == "")
    value = lambda c: F.when(F.col("_n").isNull() | (empty(c) if c in keep else F.lit(False)), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}"))
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "keep").otherwise("update")
    return o.join(n, key, "full_outer").select(key, *(value(c).alias(c) for c in columns), op.alias("op"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of parents in new are those of new; others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def merge_incoming(existing: DataFrame, incoming: DataFrame, key: str, ts: str, keep: list[str]) -> DataFrame:
    """Per key the newest incoming row with new fields, but ``keep`` (id, first seen) of the existing one; other rows as they are."""
    from .dedup import keep_newest

    newest = keep_newest(incoming, key, ts, keep[0])
    held = existing.select(key, *(F.col(c).alias(f"_k_{c}") for c in keep))
    merged = newest.join(held, key, "left").select(*(F.coalesce(f"_k_{c}", c).alias(c) if c in keep else F.col(c) for c in existing.columns))
    return merged.unionByName(existing.join(newest.select(key), key, "left_anti"))


def detect_changes(previous: DataFrame, current: DataFrame, key: str, date: str, precision: str) -> DataFrame:
    """(key, type, old_value, new_value): new_release, delayed, date_changed or missing_from_source."""
    value = lambda p, d: F.concat_ws(":", F.coalesce(p, F.lit("tbd")), F.coalesce(d.cast("string"), F.lit("")))
    p = previous.select(key, F.col(date).alias("_od"), value(F.col(precision), F.col(date)).alias("old_value"))
    c = current.select(key, F.col(date).alias("_nd"), value(F.col(precision), F.col(date)).alias("new_value"))
    kind = F.when(F.col("old_value").isNull(), "new_release").when(F.col("new_value").isNull(), "missing_from_source").when(F.col("old_value") == F.col("new_value"), None).when(F.col("_nd") > F.col("_od"), "delayed").otherwise("date_changed")
    return p.join(c, key, "full_outer").select(key, kind.alias("type"), "old_value", "new_value").filter("type IS NOT NULL")


def apply_locks(previous: DataFrame, new: DataFrame, key: str, locks: str, fields: list[str], first_seen: str) -> DataFrame:
    """new with locked fields and first_seen of the previous row; ``locks`` is an array of field names."""
    p = previous.select(key, F.col(locks).alias("_l"), *(F.col(c).alias(f"_p_{c}") for c in [*fields, first_seen]))
    locked = lambda c: F.when(F.array_contains("_l", c), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c)
    return new.join(p, key, "left").select(*(locked(c) if c in fields else F.coalesce(f"_p_{c}", c).alias(c) if c == first_seen else F.col(c) for c in new.columns))


def upsert_plan(current: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, op): insert or update, never delete; empty input plans nothing."""
    c = current.select(key, F.col(digest).alias("_c"))
    op = F.when(F.col("_c").isNull(), "insert").when(F.col("_c") != F.col(digest), "update")
    return incoming.select(key, digest).join(c, key, "left").select(key, op.alias("op")).filter("op IS NOT NULL")


def as_of_revision(ledger: DataFrame, key: str, at: Column) -> DataFrame:
    """The revision of each entity that was the latest at a number or a time (a condition on the ledger)."""
    return latest(ledger.filter(at), [key], ["revision_no"])


def status_counts(df: DataFrame, by: str, status: str, statuses: list[str]) -> DataFrame:
    """Rows of each status per group, in one aggregate."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables, sorted by name."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def date_conflicts(releases: DataFrame, other: DataFrame, key: str, date: str) -> DataFrame:
    """releases with needs_review: an exact date that another source gives differently."""
    o = other.select(key, F.col(date).alias("other_date"))
    return releases.join(o, key, "left").withColumn("needs_review", F.coalesce(F.col(date) != F.col("other_date"), F.lit(False)))


def feed_signature(columns: list[str], arrays: list[str]) -> Column:
    """A row's signature in which the order of array elements doesn't count."""
    return content_hash([*columns, *(F.array_sort(c).alias(c) for c in arrays)])


def readiness(publications: DataFrame, syncs: DataFrame, channel: str, as_of: Column, fresh_minutes: int) -> DataFrame:
    """Per channel: ready if published and the latest sync is exact, equal in digests and counts, and fresh."""
    pub = publications.filter("status = 'published'").groupBy(channel).agg(F.count(F.lit(1)).alias("publications"))
    last = latest(syncs, [channel], ["finished_at"])
    fresh = F.col("finished_at").between(as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(fresh_minutes)), as_of)
    ok = (F.col("status") == "exact") & (F.col("source_digest") == F.col("ledger_digest")) & (F.col("source_items") == F.col("ledger_items")) & fresh
    return pub.join(last, channel, "full_outer").select(channel, F.coalesce("publications", F.lit(0)).alias("publications"), (F.col("publications").isNotNull() & F.coalesce(ok, F.lit(False))).alias("ready"))


def normalise_records(df: DataFrame, key: str, url: str, title: str, sources: Column, statuses: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): rows need an id, an http address and a title; confidence is 0.55 + 0.1 for each of up to four sources, 1 at most."""
    reasons = F.array_compact(F.array(F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", F.lit("id")), F.when(~F.coalesce(F.col(url).rlike("(?i)^https?://"), F.lit(False)), F.lit("url")), F.when(F.coalesce(F.trim(title), F.lit("")) == "", F.lit("title"))))
    marked = df.withColumn("_reasons", reasons)
    confidence = F.least(F.lit(1.0), 0.55 + 0.1 * F.least(F.size(sources), F.lit(4)))
    valid = marked.filter(F.size("_reasons") == 0).drop("_reasons").withColumn("confidence", F.round(confidence, 3))
    if "status" in df.columns:
        valid = valid.withColumn("status", F.when(F.col("status").isin(*statuses), F.col("status")).otherwise(statuses[0]))
    return valid, marked.filter(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")


def failure_streaks(checks: DataFrame, source: str, ts: str, tie: str, ok: Column, persistent: int = 3) -> DataFrame:
    """Per source: failures since the last success, whether they persist, and the times of the last of each.

    ``ok`` is null where a run did not check.  No window: one aggregate finds the
    last success, another counts what follows.
    """
    marked = checks.withColumn("_ok", ok).withColumn("_at", F.struct(ts, tie))
    last = marked.groupBy(source).agg(F.max(F.when(F.col("_ok"), F.col("_at"))).alias("_s"), F.max(F.when(F.col("_ok"), F.col(ts))).alias("last_success"), F.max(F.when(~F.col("_ok"), F.col(ts))).alias("last_failure"))
    after = marked.filter(~F.col("_ok")).join(last.select(source, "_s"), source).filter(F.col("_s").isNull() | (F.col("_at") > F.col("_s"))).groupBy(source).agg(F.count(F.lit(1)).alias("failures"))
    return last.join(after, source, "left").select(source, F.coalesce("failures", F.lit(0)).alias("failures"), (F.coalesce("failures", F.lit(0)) >= persistent).alias("persistent"), "last_success", "last_failure")


def redirect_roots(redirects: DataFrame, most: int = 20) -> DataFrame:
    """(source, target, cyclic): the end of each chain of merges; a chain that comes back to itself is cyclic.

    Pointers double each round, so ``most`` rounds follow chains of 2 ** most steps; longer ones are an error.
    """
    now = redirects.select("source", "target")
    for turn in range(most + 1):
        if turn == most:
            raise ValueError(f"chains of merges are longer than 2 ** {most}")
        step = now.select(F.col("source").alias("target"), F.col("target").alias("next"))
        joined = now.join(step, "target", "left").select("source", F.coalesce("next", "target").alias("new"), "target")
        moved = joined.filter("new <> target AND new <> source AND target <> source").limit(1).count()
        now = joined.select("source", F.when(F.col("target") == F.col("source"), F.col("target")).otherwise(F.col("new")).alias("target"))
        if not moved:
            break
    # A chain inside a cycle never leaves the set of sources.
    inner = redirects.select(F.col("source").alias("target"), F.lit(True).alias("_c"))
    return now.join(inner, "target", "left").select("source", "target", F.coalesce("_c", F.lit(False)).alias("cyclic"))


def merge_entities(entities: DataFrame, redirects: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Entities united under the ends of their chains: arrays as unique unions, members listed; sources of cycles stay alone."""
    roots = redirect_roots(redirects).filter(~F.col("cyclic"))
    named = entities.join(roots.select(F.col("source").alias(key), F.col("target").alias("_root")), key, "left").withColumn("_root", F.coalesce("_root", key))
    return named.groupBy(F.col("_root").alias(key)).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in arrays), F.array_sort(F.collect_list(key)).alias("members"))



def undo_merges(entities: DataFrame, undone: DataFrame, key: str, reason: str = "merge_undone") -> DataFrame:
    """entities(key, status, status_reason, merged_into) with the merges of undone(key) taken back: they need review again.

    Undoing what is not merged is an error.
    """
    marked = entities.join(undone.select(key).distinct().withColumn("_undo", F.lit(True)), key, "left")
    back, merged = F.coalesce(F.col("_undo"), F.lit(False)), F.coalesce(F.col("status") == "merged_into_another_game", F.lit(False))
    status = F.when(back & ~merged, F.raise_error(F.concat(F.lit("not merged: "), F.col(key).cast("string"))).cast("string")).when(back, "needs_review").otherwise(F.col("status"))
    return marked.withColumns({"status": status, "status_reason": F.when(back, reason).otherwise(F.col("status_reason")), "merged_into": F.when(~back, F.col("merged_into"))}).select(entities.columns)


def roll_back(items: DataFrame, revisions: DataFrame, targets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """items with ``columns`` as they were in the revisions that targets(key, revision_no) name, and a status for those targets.

    *rolled_back* where the revision exists, else *revision_not_found*, with the item
    as it is; other items have a null status.
    """
    wanted = targets.select(key, "revision_no", F.lit(True).alias("_t")).distinct()
    found = wanted.join(revisions.select(key, "revision_no", F.struct(*columns).alias("_r")), [key, "revision_no"], "left")
    rows = items.join(found, key, "left")
    value = {c: F.when(F.col("_r").isNotNull(), F.col("_r")[c]).otherwise(F.col(c)) for c in columns}
    status = F.when(F.col("_r").isNotNull(), "rolled_back").when(F.col("_t"), "revision_not_found")
    return rows.withColumns(value).withColumn("rollback_status", status).select(*items.columns, "rollback_status")

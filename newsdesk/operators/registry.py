"""The registry of entities: identity, resolution, variants, series, registration, invariants."""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import game_basis, stable_id
from ..sources.scratch import stored
from .similarity import connected, dealt
from .topk import places

#: Pairs of two blocks of members, which one row makes, about.
PAIRS = 1 << 22


def _confidence(same: Column, exact: Column, strip: Column) -> Column:
    """How sure a pair is, by its ids, titles, kinds (_ck, _ek) and years (_cy, _ey)."""
    years = F.coalesce((F.col("_cy") != 0) & (F.col("_ey") != 0) & (F.col("_cy") != F.col("_ey")), F.lit(False))
    commercial = F.col("_ck").isin("game", "edition") & F.col("_ek").isin("game", "edition")
    return F.when(same, 1.0).when(years, 0.0).when(exact & (F.col("_ck") == F.col("_ek")), 0.98).when(exact & commercial, 0.9).when(strip & commercial, 0.84).when(F.col("_ck") != F.col("_ek"), 0.7).otherwise(0.0)


def _decision(confidence: Column) -> Column:
    return F.when(confidence >= 0.84, "match").when(confidence == 0.7, "ambiguous").otherwise("none")


def _by_names(candidates: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates(candidate, _c, ids), entities(entity, _e, ids), pairs(_c, _e, confidence) of classes, pairs(candidate, entity, _c, _e) that share an id).

    Rows with the same titles, kind and year are a class: classes meet by their titles, once.
    """
    own = lambda df, key, c, names: df.select(key, "ids", F.sha2(F.to_json(F.struct(*names, "kind", "year"), {"ignoreNullFields": "false"}), 256).alias(c), *names, "kind", "year")
    a, b = own(candidates, "candidate", "_c", ["alias", "stripped"]), own(entities, "entity", "_e", ["aliases", "stripped_aliases"])
    of_a, of_b = a.drop("candidate", "ids").dropDuplicates(["_c"]), b.drop("entity", "ids").dropDuplicates(["_e"])
    left = of_a.select("_c", F.col("kind").alias("_ck"), F.col("year").alias("_cy"), F.explode(F.array(F.concat(F.lit("a:"), F.col("alias")), F.concat(F.lit("s:"), F.col("stripped")))).alias("_k"))
    right = of_b.select("_e", F.col("kind").alias("_ek"), F.col("year").alias("_ey"), F.explode(F.array_distinct(F.concat(F.transform("aliases", lambda x: F.concat(F.lit("a:"), x)), F.transform("stripped_aliases", lambda x: F.concat(F.lit("s:"), x))))).alias("_k"))
    met = left.join(right, "_k").groupBy("_c", "_e", "_ck", "_ek", "_cy", "_ey").agg(F.bool_or(F.col("_k").startswith("a:")).alias("_exact"), F.bool_or(F.col("_k").startswith("s:")).alias("_strip"))
    pairs = stored(met.select("_c", "_e", _confidence(F.lit(False), F.col("_exact"), F.col("_strip")).alias("confidence")))
    ids = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct("ids")).alias("_x"))
    same = stored(ids(a, "candidate", "_c").join(ids(b, "entity", "_e"), "_x").select("candidate", "entity", "_c", "_e").distinct())
    return a.select("candidate", "_c"), b.select("entity", "_e"), pairs, same


def registration_counts(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(candidate, decision, entity, possible): the outcomes of registration_outcomes, and how many entities its queue holds for a candidate.

    Counted by classes of equal titles, kinds and years, without the pairs of their members.
    """
    c, e, pairs, same = _by_names(candidates, entities)
    sizes = e.groupBy("_e").agg(F.count(F.lit(1)).alias("_n"), F.max("entity").alias("_top"))
    match, unsure = F.col("confidence") >= 0.84, F.col("confidence") == 0.7
    named = pairs.join(sizes, "_e").groupBy("_c").agg(F.sum(F.when(match, F.col("_n")).otherwise(0)).alias("_m"), F.sum(F.when(unsure, F.col("_n")).otherwise(0)).alias("_a"), F.max(F.when(match, F.col("_top"))).alias("_e"))
    # A pair that shares an id counts as a match, and no more by its names.
    known = same.join(pairs, ["_c", "_e"], "left").groupBy("candidate").agg(F.count(F.lit(1)).alias("_i"), F.count_if(match).alias("_im"), F.count_if(unsure).alias("_ia"), F.max("entity").alias("_ie"))
    full = c.join(named, "_c", "left").join(known, "candidate", "left")
    n = lambda x: F.coalesce(x, F.lit(0))
    full = full.select("candidate", (n("_m") - n("_im") + n("_i")).alias("_m"), (n("_a") - n("_ia")).alias("_a"), F.coalesce("_ie", "_e").alias("_e"))
    one, some = (F.col("_m") == 1) & (F.col("_a") == 0), F.col("_m") + F.col("_a")
    return full.select("candidate", F.when(one, "matched").when(some > 0, "needs_review").otherwise("created").alias("decision"), F.when(one, F.col("_e")).alias("entity"), F.when(one, 0).otherwise(some).alias("possible"))


def identity_matches(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(candidate, entity, decision, confidence) of pairs that share an external id, an alias or a stripped alias.

    candidates(candidate, ids, alias, stripped, kind, year) and entities(entity,
    ids, aliases, stripped_aliases, kind, year).  An id is certain; equal titles of
    different years never match; equal titles match by kind (0.98, 0.90, 0.84 for
    commercial editions), else they are ambiguous (0.7).
    """
    c, e, pairs, same = _by_names(candidates, entities)
    # Members of a class go as blocks, one row each, so that classes that meet many others shuffle no row for each member and
    # class met; blocks are dealt and make their pairs where they meet.  Those that share an id are told apart on the way.
    count = lambda df, k, n: df.groupBy(k).agg(F.ceil(F.count(F.lit(1)) / isqrt(PAIRS)).cast("int").alias(n))
    of_c, of_e = stored(count(c, "_c", "_nc")), stored(count(e, "_e", "_ne"))
    split = lambda df, sizes, k, n, key, at: df.join(sizes, k).withColumn(at, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).groupBy(k, at)
    known = same.groupBy("candidate").agg(F.collect_list("entity").alias("_ids"))
    left = split(c.join(known, "candidate", "left"), of_c, "_c", "_nc", "candidate", "_i").agg(F.collect_list(F.struct("candidate", "_ids")).alias("_l"))
    right = split(e, of_e, "_e", "_ne", "entity", "_j").agg(F.collect_list("entity").alias("_m"))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    wanted = stored(pairs.join(of_c, "_c").join(of_e, "_e").select("_c", "_e", "confidence", blocks("_nc").alias("_i"), "_ne").withColumn("_j", blocks("_ne")).drop("_ne"))
    each = dealt(wanted.join(left, ["_c", "_i"]), wanted.drop("confidence").join(right, ["_e", "_j"]), ["_c", "_e", "_i", "_j"])
    met = each.select(F.explode("_l").alias("_x"), "_m", "confidence").select("_x.candidate", "_x._ids", F.explode("_m").alias("entity"), "confidence")
    met = met.filter(F.col("_ids").isNull() | ~F.array_contains("_ids", F.col("entity"))).select("candidate", "entity", "confidence")
    out = met.unionByName(same.select("candidate", "entity", F.lit(1.0).alias("confidence")))
    return out.select("candidate", "entity", _decision(F.col("confidence")).alias("decision"), "confidence")


def identity_decisions(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Per candidate: matched with one match and nothing ambiguous, review, or new."""
    g = matches.groupBy("candidate").agg(F.count_if(F.col("decision") == "match").alias("_m"), F.count_if(F.col("decision") == "ambiguous").alias("_a"), F.max(F.when(F.col("decision") == "match", F.col("entity"))).alias("_e"))
    status = F.when((F.col("_m") == 1) & (F.col("_a") == 0), "matched").when(F.coalesce(F.col("_m") + F.col("_a"), F.lit(0)) > 0, "review").otherwise("new")
    return candidates.select("candidate").join(g, "candidate", "left").select("candidate", status.alias("status"), F.when(status == "matched", F.col("_e")).alias("entity"))


def resolve_cascade(records: DataFrame, steps: list[tuple[str, str, DataFrame]], key: str) -> DataFrame:
    """(key, entity, how): the first step whose index(k, entity) knows a record's column by one entity alone.

    Steps are (name, column, index).  A step with several entities is ambiguous
    and stops the cascade: outcome ``ambiguous-<name>`` without an entity.
    """
    out = records
    for name, column, index in steps:
        one = index.groupBy(F.col("k").alias(f"_k_{name}")).agg(F.count_distinct("entity").alias(f"_n_{name}"), F.min("entity").alias(f"_e_{name}"))
        out = out.join(one, out[column] == F.col(f"_k_{name}"), "left")
    how = reduce(lambda acc, s: acc.when(F.col(f"_n_{s}") == 1, s).when(F.col(f"_n_{s}") > 1, f"ambiguous-{s}"), [s for s, _, _ in steps[1:]], F.when(F.col(f"_n_{steps[0][0]}") == 1, steps[0][0]).when(F.col(f"_n_{steps[0][0]}") > 1, f"ambiguous-{steps[0][0]}")).otherwise("unresolved")
    entity = F.coalesce(*(F.when(how == s, F.col(f"_e_{s}")) for s, _, _ in steps))
    return out.select(key, entity.alias("entity"), how.alias("how"))


def attach_variants(variants: DataFrame, bases: DataFrame, key: str) -> DataFrame:
    """(key, base, outcome): variants(key, alias, base_hint) go to the base of their hint, else of their stripped title; several bases are an error, none a review."""
    hint = variants.join(bases.select(F.col("entity").alias("_h"), F.lit(True).alias("_ok")), F.col("base_hint") == F.col("_h"), "left")
    index = bases.groupBy(F.col("alias").alias("_a")).agg(F.count_distinct("entity").alias("_n"), F.min("entity").alias("_e"))
    full = hint.join(index, F.col("alias") == F.col("_a"), "left")
    outcome = F.when(F.col("_ok"), "attached").when(F.col("_n") == 1, "attached").when(F.col("_n") > 1, "error").otherwise("review")
    return full.select(key, F.when(F.col("_ok"), F.col("base_hint")).when(F.col("_n") == 1, F.col("_e")).alias("base"), outcome.alias("outcome"))


def series_members(catalogue: DataFrame, described: DataFrame, order: list[str], member: str) -> DataFrame:
    """Per series its members in order: those of the catalogue, then described ones that it doesn't assign."""
    return _members(catalogue, described, member).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, member))), lambda x: x[member].cast("string")), ",").alias("members"))


def series_places(catalogue: DataFrame, described: DataFrame, order: list[str], member: str) -> DataFrame:
    """(series, member, place): as series_members, one row a member, so that no series is held in one task."""
    return places(_members(catalogue, described, member).select("series", *order, member), ["series"], [F.col(c) for c in [*order, member]], "place").select("series", member, "place")


def _members(catalogue: DataFrame, described: DataFrame, member: str) -> DataFrame:
    return catalogue.unionByName(described.join(catalogue.select(member).distinct(), member, "left_anti").select(catalogue.columns))


def register(candidates: DataFrame, trust: Column) -> DataFrame:
    """One entity for each group of candidates(candidate, ids, alias, kind, year) that share an external id, or alias, kind and year.

    Order-free: the id comes from the group's least basis, the title from its most
    trusted row.  Aliases of unlike kinds or years never connect groups.
    """
    same = F.concat_ws(":", F.lit("a"), "alias", "kind", F.coalesce(F.col("year").cast("string"), F.lit("")))
    keys = candidates.select(F.col("candidate"), F.explode(F.array_distinct(F.concat(F.transform("ids", lambda x: F.concat(F.lit("i:"), x)), F.array(same)))).alias("_k"))
    heads = keys.groupBy("_k").agg(F.min("candidate").alias("b"))
    edges = keys.join(heads, "_k").select(F.col("candidate").alias("a"), "b").filter("a <> b").distinct()
    parts = connected(edges).select(F.col("node").alias("candidate"), "component")
    named = candidates.join(parts, "candidate", "left").withColumn("component", F.coalesce("component", "candidate")).withColumn("_trust", trust)
    basis = game_basis(F.col("alias"), F.col("year"), F.col("kind"), id=F.array_min("ids"))
    g = named.withColumn("_basis", basis).groupBy("component").agg(F.min("_basis").alias("_basis"), F.max_by("alias", F.struct("_trust", "candidate")).alias("title"), F.count(F.lit(1)).alias("records"), F.array_sort(F.array_distinct(F.collect_list("alias"))).alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return g.select(stable_id("game_", F.col("_basis")).alias("entity"), "title", "records", "aliases", "ids")


def identity_violations(entities: DataFrame, entity: str, owned: dict[str, Column]) -> DataFrame:
    """(rule, key, owners) of values that more than one entity owns; ``owned``: rule to an array column."""
    parts = [entities.select(F.lit(rule).alias("rule"), F.explode(F.array_distinct(values)).alias("key"), entity).withColumn("key", F.col("key").cast("string")) for rule, values in owned.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("rule", "key").agg(F.count_distinct(entity).alias("owners")).filter("owners > 1")


def attach_articles(articles: DataFrame, steps: list[tuple[str, str, DataFrame]], key: str) -> DataFrame:
    """(status, n): how articles bind to entities, by the cascade's steps."""
    return resolve_cascade(articles, steps, key).groupBy(F.col("how").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def project_catalogue(resolved: DataFrame, key: str, entity: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(records, issues): the first record of each entity, and duplicates and unresolved ones with their reason."""
    w = Window.partitionBy(entity).orderBy(*order)
    # Unresolved records are no group: they don't meet in one task.
    marked = resolved.filter(F.col(entity).isNotNull()).withColumn("_n", F.row_number().over(w))
    unresolved = resolved.filter(F.col(entity).isNull()).select(key, entity, F.lit("unresolved").alias("issue"))
    return marked.filter("_n = 1").drop("_n"), marked.filter("_n > 1").select(key, entity, F.lit("duplicate").alias("issue")).unionByName(unresolved)


def resolve_system(records: DataFrame, games: DataFrame, variants: DataFrame, externals: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, status, entity, reason) of records(key, game_id, slug, variant_id, ids, alias) by the indexes of a registry of active games.

    games(entity, slug), variants(entity, variant_id, slug), externals(entity, id),
    aliases(entity, alias).  In this order: the owner of a variant (by id, or slug),
    the explicit id, the slug, a single external id, a single alias.  Outcomes:
    embedded_variant, matched, mismatch (the explicit id is unknown or another than
    the slug's or the variant's), unresolved.  Of several variants with one id or
    slug the smallest owner counts.
    """
    own = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    r = records.select(key, own("game_id").alias("_g"), own("slug").alias("_s"), own("variant_id").alias("_v"), "ids", own("alias").alias("_a"))
    one = lambda df, c, name: df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_k{name}")).agg(F.min("entity").alias(f"_{name}"), F.count_distinct("entity").alias(f"_n{name}"))
    known = games.select(F.col("entity").cast("string").alias("_kid"), F.col("entity").alias("_explicit")).distinct()
    r = r.join(known, r["_g"] == F.col("_kid"), "left")
    for df, c, name, column in ((games, "slug", "slug", "_s"), (variants, "variant_id", "byvariant", "_v"), (variants, "slug", "byslug", "_s"), (aliases, "alias", "alias", "_a")):
        r = r.join(one(df, c, name), F.col(column) == F.col(f"_k{name}"), "left")
    met = r.select(key, F.explode(F.array_distinct("ids")).alias("id")).join(externals.select("id", "entity"), "id").groupBy(key).agg(F.min("entity").alias("_ext"), F.count_distinct("entity").alias("_next"))
    r = r.join(met, key, "left")
    owner = F.coalesce("_byvariant", "_byslug")
    other = lambda a, b: F.coalesce(a != b, F.lit(False))
    unknown = F.col("_g").isNotNull() & F.col("_explicit").isNull()
    cases = [
        (owner.isNotNull() & other(F.col("_explicit"), owner), "mismatch", owner, "variant_base_game_id_mismatch"),
        (owner.isNotNull(), "embedded_variant", owner, "embedded_variant"),
        (unknown & F.col("_slug").isNotNull(), "mismatch", F.col("_slug"), "unknown_explicit_game_id"),
        (unknown, "unresolved", None, "unknown_explicit_game_id"),
        (other(F.col("_explicit"), F.col("_slug")), "mismatch", F.col("_slug"), "game_id_slug_mismatch"),
        (F.col("_explicit").isNotNull(), "matched", F.col("_explicit"), "canonical_game_id"),
        (F.col("_slug").isNotNull(), "matched", F.col("_slug"), "canonical_slug"),
        (F.col("_next") == 1, "matched", F.col("_ext"), "canonical_external_id"),
        (F.col("_next") > 1, "unresolved", None, "ambiguous_external_id"),
        (F.col("_nalias") == 1, "matched", F.col("_alias"), "canonical_alias"),
        (F.col("_nalias") > 1, "unresolved", None, "ambiguous_alias"),
    ]
    kind = games.schema["entity"].dataType
    out = F.struct(F.lit("unresolved").alias("status"), F.lit(None).cast(kind).alias("entity"), F.lit("not_found").alias("reason"))
    for condition, status, entity, reason in reversed(cases):
        out = F.when(condition, F.struct(F.lit(status).alias("status"), (F.lit(None) if entity is None else entity).cast(kind).alias("entity"), F.lit(reason).alias("reason"))).otherwise(out)
    return r.select(key, out.alias("_o")).select(key, "_o.status", "_o.entity", "_o.reason")


def registration_outcomes(candidates: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, review queue) of candidates by identity_matches.

    outcomes(candidate, decision, entity): matched with one match and nothing
    ambiguous, needs_review with several or ambiguous ones, else created.  The queue
    has a row for each possible entity of a candidate under review: (candidate,
    entity, reason), best first by confidence.
    """
    said = identity_decisions(candidates, matches)
    decision = F.when(F.col("status") == "review", "needs_review").when(F.col("status") == "new", "created").otherwise(F.col("status"))
    outcomes = said.select("candidate", decision.alias("decision"), "entity")
    queue = matches.filter("decision <> 'none'").join(outcomes.filter("decision = 'needs_review'").select("candidate"), "candidate", "left_semi")
    place = Window.partitionBy("candidate").orderBy(F.desc("confidence"), "entity")
    return outcomes, queue.select("candidate", "entity", F.col("decision").alias("reason"), F.row_number().over(place).alias("place"))

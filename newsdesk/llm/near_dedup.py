"""Near-duplicate documents by SetSketch registers (operator 9).

1. *Sketch.*  Each document's set of five-word shingles becomes ``REGISTERS``
   truncated exponential minima ``floor(1 - log_b(min x))``, with steps spaced by
   the base ``b``.  Registers merge by their maximum, and two sets agree in a
   register about as often as their Jaccard similarity says.
2. *Classes.*  Documents with one set form a class; only its smallest doc_id goes on.
3. *Bands.*  ``BANDS`` groups of registers are hashed to keys.  At a similarity of
   0.75 a pair shares no key with a probability of 3e-7.
4. *Stars.*  Under each key, members are paired with the smallest.  The likelihood
   of a pair's registers at 0.75, given both set sizes, drops hopeless pairs; the
   others are verified on full sets.
5. *Rest.*  Where members of one key are still in several components, those outside
   the largest are held against the others by the likelihood of their registers, and
   where a link is likely, against all members of such a component by full sets.
   Pairs inside a component are never formed, so groups of copies cost in proportion
   to their size.
6. *Hot keys.*  A key that leaves more than ``HOT`` members outside its largest
   component (much boilerplate, texts just below the threshold) is settled by rare
   shingles: sets with a similarity of 0.75 share one among the rarest quarter of the
   larger and the rarest seventh of the smaller, so members meet under these alone.
   How many members hold a shingle is counted exactly, by one shuffle of hashes; a
   shingle of at most ``RARE`` members brings each of them that many partners at most,
   and one of more comes late in its order.  Nothing is left out: both ways are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, free_name, map_batches, release, staged, table, tidy, utf8, window_hashes
from .substring_dedup import _Words

#: Words in a shingle, and the similarity in hundredths from which documents are linked.
SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Base of the register scale.
BASE = 1.02
#: Standard deviations by which a pair's likelihood at the threshold may fall short.
Z = 5.0
#: Members of a key outside its largest component up to which all of them are held against the key's members.
HOT = 64
#: Members of a key or a component in one group.
BLOCK = 1024
#: Parts into which the members of a component are dealt before they meet what is known of it.
SALTS = 32
#: Members of hot keys that a rare shingle has at most.
RARE = 4
#: Frequent shingles that are sent to every task (16 bytes each); with more, shingles are joined with them by shuffle.
SENT_FREQUENT = 1 << 20
#: Members verified against one centre in a group, and nodes held at once against members of a component.
CHUNK = 256

_RNG = np.random.default_rng(9)
_FACTORS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingle_set(text: bytes | None, words: _Words, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; with fewer words, one of all of them."""
    w = text.translate(ASCII_LOWER).split() if text else []
    if not w:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(words.of(w), min(n, len(w))))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16, a row for each set); a set without elements has zeros."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    run = np.concatenate([sets[i] for i in full])
    heads = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    least = np.empty((len(full), REGISTERS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(REGISTERS):
            x = (run ^ _MASKS[k]) * _FACTORS[k]
            x ^= x >> np.uint64(32)
            least[:, k] = np.minimum.reduceat(x * _FACTORS[-1 - k], heads)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    out[full] = np.clip(np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 1e-16))) / math.log(BASE)), 1 - 200, 60000).astype(np.int64) + 200
    return out


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, mask): joint maximum-likelihood similarity of register rows, and whether ``percent`` is within Z of it.

    For set sizes n_a, n_b and similarity J, a register of the first is larger
    with probability p(u - v J), of the second with p(v - u J), where u and v are
    the sets' shares of n_a + n_b and p(x) = -log_b(1 - x (b - 1) / b).
    """
    more, fewer = (a > b).sum(axis=1).astype(np.float64), (a < b).sum(axis=1).astype(np.float64)
    same = a.shape[1] - more - fewer
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def loglik(j: np.ndarray) -> np.ndarray:
        p = [np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-9, 1) for x in (u - v * j, v - u * j)]
        return more * np.log(p[0]) + fewer * np.log(p[1]) + same * np.log(np.clip(1 - p[0] - p[1], 1e-9, 1))

    grid = np.linspace(0, 1, 101)
    all_of = np.stack([loglik(np.minimum(g, 1) * top) for g in grid])
    best = all_of.argmax(axis=0)
    estimate = grid[best] * top
    at = percent / 100
    reach = loglik(np.minimum(np.full_like(u, at), top))
    # A set much smaller than the other cannot reach the threshold at all.
    return estimate, (top >= at - 1e-9) & ((estimate >= at) | (2 * (all_of.max(axis=0) - reach) <= Z * Z))


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, n_shingles, set_hash, registers) of docs(doc_id, text); set_hash is null for empty sets, sub a hash of the text."""

    def make():
        from xxhash import xxh3_128_digest

        words = _Words()

        def each(batch):
            sizes, hashes, rows = [], [], []
            texts = utf8(batch.column("text"))
            for i in range(0, len(texts), 16):  # few at a time: the minima run over all of their shingles
                sets = [shingle_set(t, words) for t in texts[i : i + 16]]
                sizes += map(len, sets)
                hashes += [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                rows += [r.astype("<u2").tobytes() for r in registers(sets)]
            return [batch.column("doc_id"), batch.column("sub"), sizes, hashes, rows]

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows.withColumn("sub", F.xxhash64("text")), make, "doc_id long, sub long, n_shingles long, set_hash binary, registers binary")


def _likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, b) whose registers leave the threshold likely."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def make():
        def each(batch):
            stack = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
            n = [batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b")]
            mask = pa.array(likely(stack("r_a"), stack("r_b"), *n)[1])
            return [batch.column("a").filter(mask), batch.column("b").filter(mask)]

        return each

    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), make, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked) of distinct pairs(a, b), decided on full sets from texts(node, text).

    Pairs are grouped by b in chunks of about CHUNK members; a task holds one
    centre's set and streams the members by.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"), "a")
    members = dealt.join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "chunk", "a", "text")
    centres = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(texts.select(F.col("node").alias("b"), "text"), "b").select("b", "chunk", F.lit(None).cast("long").alias("a"), "text")
    ordered = members.unionByName(centres).repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]):
        words, centre = _Words(), np.empty(0, dtype=np.uint64)
        for batch in batches:
            out = [[], [], []]
            for b, a, text in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), utf8(batch.column("text")), strict=True):
                own = shingle_set(text, words)
                if a is None:
                    centre = own
                    continue
                both = len(np.intersect1d(own, centre, assume_unique=True))
                for column, x in zip(out, (a, b, 100 * both >= percent * (len(own) + len(centre) - both)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["a", "b", "linked"])

    return ordered.mapInArrow(tidy(run), "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(a, b): the smallest node that each node can reach.

    Alternates large-star and small-star, both with one aggregate and one join,
    until the edges are stars; each round is written to the shared folder.
    """

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = signature(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        before, now = now, staged(small, "edges")
        release(before)
        old, mark = mark, signature(now)
        if mark == old:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _open_keys(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component, main, others, size) of the members of keys that hold several components.

    ``main`` is the key's largest component, ``others`` the members outside it.
    """
    m = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = m.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = per.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others")).filter("parts > 1")
    return m.join(keys.drop("parts"), "key")


def _asks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component): nodes outside the largest component of a key of few others, and components under it that hold a likely partner.

    The key's members are dealt into blocks; its at most HOT asking nodes go to each.
    """
    inside = members.filter(F.col("others") <= HOT).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    asked = inside.filter("component <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), "node", "component")
    shown = inside.select("key", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "node", "component")
    rows = asked.unionByName(shown).join(classes.select("node", "n_shingles", "registers"), "node")
    ordered = rows.repartition("key", "block").sortWithinPartitions("key", "block", "role")
    share = PERCENT / 100
    least = math.floor(REGISTERS * share - Z * math.sqrt(REGISTERS * share * (1 - share)))

    def run(batches: Iterator[pa.RecordBatch]):
        group, queries, held, done = None, [], None, set()
        for batch in batches:
            pairs = []
            for key, block, role, node, component, n, reg in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "role", "node", "component", "n_shingles", "registers")), strict=True):
                if (key, block) != group:
                    group, queries, held, done = (key, block), [], None, set()
                if role == 0:
                    queries.append((node, component, n, reg))
                    continue
                if held is None:
                    if not queries:
                        continue
                    held = np.array([q[1] for q in queries]), np.frombuffer(b"".join(q[3] for q in queries), dtype="<u2").reshape(-1, REGISTERS)
                # Too few equal registers make every likelihood hopeless; the others are judged together.
                near = (held[0] != component) & (np.count_nonzero(held[1] == np.frombuffer(reg, dtype="<u2"), axis=1) >= least)
                pairs += [(*queries[k], component, n, reg) for k in np.flatnonzero(near).tolist() if (queries[k][0], component) not in done]
            found = []
            if pairs:
                stack = lambda k: np.frombuffer(b"".join(p[k] for p in pairs), dtype="<u2").reshape(-1, REGISTERS)  # noqa: B023, E731
                size = lambda k: np.array([p[k] for p in pairs], dtype=np.float64)  # noqa: B023, E731
                for k in np.flatnonzero(likely(stack(3), stack(6), size(2), size(5))[1]).tolist():
                    pair = pairs[k][0], pairs[k][4]
                    if pair not in done:
                        done.add(pair)
                        found.append(pair)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["node", "component"])

    return ordered.mapInArrow(tidy(run), "node long, component long")


def _shingles(rows: DataFrame) -> DataFrame:
    """(shingle, node, component, n) of rows(node, component, text), n being the size of the node's set."""

    def run(batches: Iterator[pa.RecordBatch]):
        words = _Words()
        for batch in batches:
            for node, component, text in zip(batch.column("node").to_pylist(), batch.column("component").to_pylist(), utf8(batch.column("text")), strict=True):
                own = shingle_set(text, words)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *(pa.array(np.full(len(own), x)) for x in (node, component, len(own)))], ["shingle", "node", "component", "n"])

    return rows.mapInArrow(tidy(run), "shingle long, node long, component long, n long")


def _prefixes_sent(rows: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """(shingle, indexed, node, component, n): each set's prefix, by frequent(shingle, held) that is sent to every task."""
    found = frequent.toPandas()
    order = np.argsort(found["shingle"].to_numpy().view(np.uint64))
    sent = rows.sparkSession.sparkContext.broadcast((found["shingle"].to_numpy().view(np.uint64)[order], found["held"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]):
        words, (names, held) = _Words(), sent.value
        for batch in batches:
            for node, component, text in zip(batch.column("node").to_pylist(), batch.column("component").to_pylist(), utf8(batch.column("text")), strict=True):
                own = shingle_set(text, words)
                n, often = len(own), np.zeros(len(own), dtype=np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    often = np.where(names[at] == own, held[at], 0)
                own = own.view(np.int64)
                own = own[np.lexsort((own, often))]
                probe, index = n + percent * n // -100 + 1, n + 2 * percent * n // -(100 + percent) + 1
                own = own[:probe]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.arange(len(own)) < index), *(pa.array(np.full(len(own), x)) for x in (node, component, n))], ["shingle", "indexed", "node", "component", "n"])

    return rows.mapInArrow(tidy(run), "shingle long, indexed boolean, node long, component long, n long")


def _prefixes_joined(rows: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """The same where frequent shingles are too many to send; each is dealt over salts, so that no task holds all members of one."""
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    held = _shingles(rows).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(6)), F.lit(SALTS))).join(frequent.withColumn("salt", salt), ["shingle", "salt"], "left")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("held", F.lit(0)), "shingle"))
    share = lambda up, down: F.ceil(up * F.col("n") / down)
    placed = held.withColumn("place", place).filter(F.col("place") <= F.col("n") - share(percent, 100) + 1)
    return placed.select("shingle", (F.col("place") <= F.col("n") - share(2 * percent, 100 + percent) + 1).alias("indexed"), "node", "component", "n")


def _rare_asks(members: DataFrame, texts: DataFrame, percent: int = PERCENT, sent: int = SENT_FREQUENT) -> DataFrame:
    """(node, component) for the members of hot keys: components with a member that shares a rare shingle and may reach the threshold.

    Shingles that more than RARE of these members hold are ordered by their number,
    after all others, which go by hash.  Of sets x and y, |x| >= |y|, with the
    similarity t, the first |x| - ceil(t |x|) + 1 shingles of x and the first
    |y| - ceil(2 t |y| / (1 + t)) + 1 of y have one in common, whatever the order.
    """
    hot = members.filter(F.col("others") > HOT).select("node", "component").distinct()
    rows = staged(hot.join(texts, "node"), "hot")
    frequent = staged(_shingles(rows).groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > RARE), "frequent")
    prefixes = _prefixes_sent if frequent.count() <= sent else _prefixes_joined
    rare = staged(prefixes(rows, frequent, percent), "rare")
    # Of a shingle's components only their sizes' range: copies don't multiply.
    index = rare.filter("indexed").groupBy("shingle", F.col("component").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    asks = rare.join(index, "shingle").filter((F.col("component") != F.col("other")) & (F.col("least") <= F.col("n")) & (100 * F.col("most") >= percent * F.col("n")))
    out = staged(asks.select("node", F.col("other").alias("component")).distinct(), "asks")
    release(rows, frequent, rare)
    return out


def _cross(asks: DataFrame, labels: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the nodes of asks(node, component) and members of those components, by full sets.

    Blocks of nodes meet blocks of members; of each node and block one link is
    enough, as the members are connected already.
    """
    members = texts.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = asks.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("askers"))
    sizes = sizes.join(members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("holders")), "component")
    spread = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asks.join(sizes, "component").select("component", spread("askers", 2).alias("i"), "node", "holders").select("component", "i", each("holders").alias("j"), F.lit(0).alias("role"), "node")
    # A large component is dealt over several tasks before it meets its sizes.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(4)), F.lit(SALTS)))
    held_by = salted.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["component", "salt"]).select("component", spread("holders", 3).alias("j"), "node", "askers").select("component", each("askers").alias("i"), "j", F.lit(1).alias("role"), "node")
    rows = asked.unionByName(held_by).join(texts, "node")
    ordered = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "role")

    def run(batches: Iterator[pa.RecordBatch]):
        words, group, queries, held = _Words(), None, [], None
        for batch in batches:
            found = []
            for component, i, j, role, node, text in zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "role", "node")), utf8(batch.column("text")), strict=True):
                if (component, i, j) != group:
                    group, queries, held = (component, i, j), [], None
                own = shingle_set(text, words)
                if role == 0:
                    queries.append((node, own))
                    continue
                if held is None:
                    if not queries:
                        continue
                    lengths = np.array([len(q[1]) for q in queries])
                    held = np.array([q[0] for q in queries]), np.concatenate([q[1] for q in queries]), lengths, np.cumsum(lengths) - lengths, np.ones(len(queries), dtype=bool)
                nodes, run_, lengths, heads, open_ = held
                if not open_.any():
                    continue
                at = np.minimum(np.searchsorted(own, run_), len(own) - 1)
                common = np.add.reduceat((own[at] == run_).astype(np.int64), heads)
                for k in np.flatnonzero(open_ & (nodes != node) & (100 * common >= percent * (lengths + len(own) - common))).tolist():
                    open_[k] = False
                    found.append((int(nodes[k]), node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return ordered.mapInArrow(tidy(run), "a long, b long")


def _texts(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """(node, text) of the classes in involved(node, rep): texts of their smallest document.

    Where rows share a doc_id, only those whose shingles are the class's count.
    """

    def make():
        from xxhash import xxh3_128_digest

        words = _Words()

        def each(batch):
            texts = utf8(batch.column("text"))
            same = pa.array([xxh3_128_digest(shingle_set(t, words).tobytes()) == h for t, h in zip(texts, batch.column("set_hash").to_pylist(), strict=True)])
            return [batch.column("node").filter(same), batch.column("text").filter(same)]

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return map_batches(rows.join(involved.hint("shuffle_hash"), "rep"), make, "node long, text string")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, n_shingles, component_id) of the rows of docs(doc_id, text); see near_groups."""
    sketches = staged(sketch(docs), "sketches")
    named = sketches.filter("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # Numbers are given once, as the table is written, so no two classes share one.
    classes = staged(named.withColumn("node", F.monotonically_increasing_id()), "classes")
    bytes_a_band = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * bytes_a_band + 1, F.lit(bytes_a_band))))
    rows = classes.select("node", "rep", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.min(F.struct("rep", "node")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = staged(rows.select("key", "node").join(shared.select("key", F.col("first.node").alias("centre")), "key"), "buckets")
    involved = classes.select("node", "rep", "set_hash").join(buckets.select("node").distinct(), "node")
    texts = staged(_texts(docs, involved), "texts")
    stars = buckets.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    linked = staged(verify(_likely_pairs(stars, classes), texts).filter("linked").select("a", "b"), "linked")
    labels = staged(components(linked), "labels")
    members = staged(_open_keys(buckets.select("key", "node"), labels), "members")
    asks = staged(_asks(members, classes).distinct(), "asks")
    if members.filter(F.col("others") > HOT).head(1):
        both = asks.unionByName(rare := _rare_asks(members, texts)).distinct()
        asks, old = staged(both, "asks"), asks
        release(old, rare)
    more = staged(_cross(asks, labels, texts), "linked")
    if more.head(1):
        old, labels = labels, staged(components(linked.unionByName(more)), "labels")
        release(old)
    release(buckets, members, texts, linked, asks, more)
    reached = classes.select("set_hash", "node", "rep").join(labels, "node", "left")
    alone = reached.filter("component IS NULL").select("set_hash", F.col("rep").alias("component_id"))
    linked_ = reached.filter("component IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS)))
    least = linked_.groupBy("component").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ends = alone.unionByName(linked_.join(least, ["component", "salt"]).select("set_hash", "component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sketches.select("doc_id", "sub", "n_shingles", "set_hash").join(ends, "set_hash", "left").select("doc_id", "sub", "n_shingles", own.alias("component_id"))


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id it can reach by links.

    Null and empty texts have no shingles and are linked with nothing.  Rows
    without doc_id take no part (component_id is null).  Rows with one doc_id but
    other texts are linked only if their texts are.
    """
    return _grouped(docs).drop("sub")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, columns unchanged, with one document of each group: that with its smallest doc_id.

    Rows without doc_id stay.  Of repeated rows of the smallest doc_id all stay.
    Rows with one doc_id are judged by their own texts.
    """
    name = free_name("sub", docs.columns)
    gone = _grouped(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("sub").alias("_sub")).distinct()
    keyed = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(gone, (keyed["doc_id"].cast("long") == gone["_id"]) & (keyed[name] == gone["_sub"]), "left_anti").select(docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE_OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""

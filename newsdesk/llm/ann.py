"""Nearest neighbours by shifted space-filling curves (operator 8).

Vectors are projected to a few dimensions, each curve with its own rotation and
shift, and ordered by their Hilbert keys.  Spark deals each order into ranges
(blocks).  A query looks at the window of blocks around its own on every curve;
what the windows find is merged and reranked by exact inner products.

The window's share of an order and the number of curves are fitted on a bounded
sample: the cheapest setting that reaches ``RECALL`` there, where neighbours are
farther apart than among all vectors.  Vectors without any structure need windows
that cover everything; the search is then exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Neighbours of a query, and which rows are queries.
NEIGHBOURS, QUERY_STEP = 20, 20
#: Curves, projected dimensions and bits of each.
CURVES, DIMENSIONS, BITS = 3, 6, 10
#: Vectors in a block.
BLOCK = 4096
#: Sample that projections and windows are fitted on, and its queries; recall it must reach.
SAMPLE, SAMPLE_QUERIES, RECALL = 4096, 256, 0.97


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of cells (n x d integers below 2 ** bits), d * bits <= 63."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess work: rotate and reflect the sub-cubes
        p = q - 1
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # interleave
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projections, shifts, and the share of each order that a query's window covers."""

    def __init__(self, sample: np.ndarray, neighbours: int, curves: int = CURVES):
        rng = np.random.default_rng(8)
        d = min(DIMENSIONS, sample.shape[1])
        self.centre = sample.mean(axis=0)
        _, _, axes = np.linalg.svd(sample - self.centre, full_matrices=False)
        main = axes[: min(len(axes), 2 * d)]
        self.planes, self.low, self.step = [], [], []
        for _ in range(curves):
            plane = main.T @ np.linalg.qr(rng.normal(size=(len(main), len(main))))[0][:, :d]
            seen = (sample - self.centre) @ plane
            low, high = seen.min(axis=0), seen.max(axis=0)
            room = np.maximum(high - low, 1e-9)
            self.planes.append(plane)
            self.low.append(low - room * rng.uniform(0.05, 0.5, size=plane.shape[1]))
            self.step.append(room * 1.6 / (1 << BITS))
        self.curves, self.share = self._fit(sample, neighbours)

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        cells = np.floor(((vectors - self.centre) @ self.planes[curve] - self.low[curve]) / self.step[curve])
        return hilbert_keys(np.clip(np.nan_to_num(cells), 0, (1 << BITS) - 1), BITS)

    def _fit(self, sample: np.ndarray, neighbours: int) -> tuple[int, float]:
        n = len(sample)
        if n <= neighbours + 1:
            return 1, 1.0
        asked = np.linspace(0, n - 1, min(SAMPLE_QUERIES, n)).astype(int)
        scores = sample[asked] @ sample.T
        scores[np.arange(len(asked)), asked] = -np.inf
        near = np.argpartition(-scores, neighbours, axis=1)[:, :neighbours]
        away = []
        for c in range(len(self.planes)):
            rank = np.empty(n, dtype=np.int64)
            rank[np.argsort(self.keys(sample, c), kind="stable")] = np.arange(n)
            away.append(np.abs(rank[near] - rank[asked][:, None]) / n)
        best = (1.0, 1, 1.0)
        for curves in range(1, len(away) + 1):
            least = np.minimum.reduce(away[:curves])
            share = float(np.quantile(least, RECALL)) * 2
            best = min(best, (curves * share, curves, share))
        return best[1], min(1.0, best[2])


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with v of doubles: rows with an id, and a vector of the usual length that is finite and not zero."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """(cls, v, least): distinct vectors with their ``keep`` smallest ids; the window drops the others before the shuffle."""
    own = Window.partitionBy("cls", "v").orderBy("vec_id")
    few = vectors.withColumn("cls", F.xxhash64("v")).withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= keep)
    return few.groupBy("cls", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("least"))


def _matrix(packed: list[bytes] | bytes, d: int) -> np.ndarray:
    return np.frombuffer(packed if isinstance(packed, bytes) else b"".join(packed), dtype="<f8").reshape(-1, d)


def _dots(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of a with each row, summed in order of the components."""
    out = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        out += a[k] * rows[:, k]
    return out


def search(vectors: DataFrame, step: int = QUERY_STEP, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors found for each row whose vec_id is divisible by ``step``.

    Nearness is the inner product in double precision, nearest first, ties to the
    smaller vec_id.  Ids or vectors that are null, zero, not finite or of another
    length than most take no part; of rows with one vec_id the least vector counts.  A query is never its
    own neighbour, and gets all candidates if there are fewer than ``neighbours``.
    """
    spark = vectors.sparkSession
    rows = staged(valid_vectors(vectors), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    keep = neighbours + 1
    classes = staged(_distinct(rows, keep).withColumn("ask", F.lit(None).cast("boolean")), "classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], schema)
    # At most SAMPLE vectors reach the driver.
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("cls", F.lit(8)), "cls").limit(SAMPLE).select("v").collect()])
    d = sample.shape[1]
    curves = Curves(sample, min(neighbours, max(1, len(sample) - 1)))
    asked = rows.filter(F.col("vec_id") % step == 0).select(F.xxhash64("v").alias("cls"), "v", F.col("vec_id").alias("query_id"))
    flagged = classes.drop("ask").join(asked.select("cls", "v", F.lit(True).alias("ask")).distinct(), ["cls", "v"], "left")

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), dtype=np.float64)
            least = pa.array([x[0] for x in batch.column("least").to_pylist()], pa.int64())
            packed = pa.array([x.tobytes() for x in v.astype("<f8")], pa.binary())
            for c in range(curves.curves):
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.int32()), pa.array(curves.keys(v, c)), least, packed, batch.column("ask")], ["curve", "key", "node", "packed", "ask"])

    # A class is named by its smallest id.
    blocks = max(1, -(-n * curves.curves // block))
    dealt = flagged.select("v", "least", "ask").mapInArrow(keyed, "curve int, key long, node long, packed binary, ask boolean").repartitionByRange(blocks, "curve", "key", "node")

    def pack(batches: Iterator[pa.RecordBatch]):
        names = ["curve", "block", "nodes", "matrix", "queries", "query_matrix"]
        held: dict[int, list] = {}
        for batch in batches:
            for curve, node, packed, ask in zip(*(batch.column(c).to_pylist() for c in ("curve", "node", "packed", "ask")), strict=True):
                own = held.setdefault(curve, [[], [], [], []])
                own[0].append(node)
                own[1].append(packed)
                if ask:
                    own[2].append(node)
                    own[3].append(packed)
        for curve, (nodes, packed, queries, query_packed) in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([curve], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([nodes], pa.list_(pa.int64())), pa.array([b"".join(packed)], pa.binary()), pa.array([queries], pa.list_(pa.int64())), pa.array([b"".join(query_packed)], pa.binary())], names)

    index = staged(dealt.mapInArrow(pack, "curve int, block int, nodes array<bigint>, matrix binary, queries array<bigint>, query_matrix binary"), "index")
    place = Window.partitionBy("curve").orderBy("block")
    total = Window.partitionBy("curve")
    narrow = index.select("curve", "block").withColumn("at", F.row_number().over(place) - 1).withColumn("of", F.count(F.lit(1)).over(total))
    reach = F.ceil(F.lit(curves.share / 2) * F.col("of")).cast("int")
    # A window that would leave the order is moved inside.
    first = F.greatest(F.lit(0), F.least(F.col("at") - reach, F.col("of") - 1 - 2 * reach))
    last = F.least(F.col("of") - 1, F.greatest(F.col("at") + reach, 2 * reach))
    own = index.join(narrow, ["curve", "block"])
    asking = own.filter(F.size("queries") > 0).select("curve", F.explode(F.sequence(first, last)).alias("at"), F.lit(1).alias("role"), F.concat_ws("-", "curve", "block").alias("group"), F.col("queries").alias("nodes"), F.col("query_matrix").alias("matrix"))
    holding = own.select("curve", "at", F.lit(0).alias("role"), F.lit(None).cast("string").alias("group"), "nodes", "matrix")
    meeting = asking.unionByName(holding).repartition("curve", "at").sortWithinPartitions("curve", "at", "role")
    found_schema = "group string, queries array<bigint>, near array<bigint>, scores array<double>"

    def meet(batches: Iterator[pa.RecordBatch]):
        nodes, matrix = np.empty(0, dtype=np.int64), np.empty((0, d))
        for batch in batches:
            for r in batch.to_pylist():
                if r["role"] == 0:
                    nodes, matrix = np.array(r["nodes"], dtype=np.int64), _matrix(r["matrix"], d)
                    continue
                asked_by = _matrix(r["matrix"], d)
                rough = asked_by @ matrix.T
                # All rows that may be among the best or tie with them, whatever the order of summing has rounded.
                margin = 4 * d * np.finfo(float).eps * np.linalg.norm(asked_by, axis=1) * np.linalg.norm(matrix, axis=1).max(initial=0.0)
                least = np.partition(rough, len(nodes) - keep, axis=1)[:, len(nodes) - keep] - margin if keep < len(nodes) else np.full(len(asked_by), -np.inf)
                picks = [np.flatnonzero(~(r < x)) for r, x in zip(rough, least, strict=True)]
                near, scores = np.full((len(asked_by), keep), -1, dtype=np.int64), np.full((len(asked_by), keep), -np.inf)
                for i, pick in enumerate(picks):
                    exact = _dots(asked_by[i], matrix[pick])
                    order = np.lexsort((nodes[pick], -exact))[:keep]
                    near[i, : len(order)], scores[i, : len(order)] = nodes[pick][order], exact[order]
                yield pa.RecordBatch.from_arrays([pa.array([r["group"]]), pa.array([r["nodes"]], pa.list_(pa.int64())), pa.array([near.ravel()], pa.list_(pa.int64())), pa.array([scores.ravel()], pa.list_(pa.float64()))], ["group", "queries", "near", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]):
        group, best = None, {}

        def close():
            rows = [(q, node, s) for q, found in best.items() for node, s in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "node", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group:
                    yield from close()
                    group, best = r["group"], {}
                for i, q in enumerate(r["queries"]):
                    new = {x: s for x, s in zip(r["near"][i * keep : (i + 1) * keep], r["scores"][i * keep : (i + 1) * keep], strict=True) if s > -np.inf}
                    both = best.get(q, {}) | new
                    best[q] = dict(sorted(both.items(), key=lambda z: (-z[1], z[0]))[:keep])
        yield from close()

    met = meeting.mapInArrow(meet, found_schema).repartition("group").sortWithinPartitions("group")
    # Windows of several curves may find one class twice; they agree on its score.
    pairs = met.mapInArrow(merge, "query long, node long, score double").groupBy("query", "node").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).filter(F.col("_n") <= keep).drop("_n")
    names = classes.select("cls", "v", F.col("least")[0].alias("node"), "least")
    queries = asked.join(names.select("cls", "v", F.col("node").alias("query")), ["cls", "v"]).select("query_id", "query")
    members = ranked.join(names.select("node", F.explode("least").alias("vec_id")), "node").select("query", "vec_id", "score")
    top = members.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= keep).drop("_n")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    others = queries.join(top, "query").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return others.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE_OP8 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""

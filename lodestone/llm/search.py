"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts with few edges
between them.  A small classifier learns to tell a vector's part.  It files every vector,
and it routes each query to its most probable parts, whose vectors are all compared in
double precision.  How many parts that takes is measured on the sample's own neighbours,
and audited on the table: if a bounded number of queries, compared with all vectors, find
too few of their nearest, every query visits twice as many parts, at last all, which is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.vectors import is_vector, matrix, unit, usual_length
from lodestone.llm.workspace import Workspace

#: The graph and the classifier are fitted on at most so many vectors, those that come first by hash.
SAMPLE = 8192
#: Vectors of a part, about, and parts at least and at most (the sample can tell no more apart); tables of fewer vectors than this have one part.
PART, LEAST_PARTS, MOST_PARTS, TRIVIAL = 2048, 8, 256, 512
#: Rows of a part that one task compares at once.
BLOCK_ROWS = 4096
GRAPH_DEGREE, SLACK, ROUNDS = 10, 1.05, 12
#: The share of the sample's true neighbours that the routed parts must hold; queries audited on the table, and the recall that they must have.
COVER, AUDIT, LEAST_RECALL = 0.97, 64, 0.95


@dataclass
class Router:
    """Weights of the classifier (components and a constant by part) and the parts that a query visits."""

    weights: np.ndarray
    visits: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        z = np.column_stack([unit(x), np.ones(len(x))]) @ self.weights
        return np.argsort(-z, axis=1, kind="stable")


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k vectors of largest inner product with each, itself left out."""
    out = []
    for a in range(0, len(x), 128):  # a few MB at a time, for this runs on the driver
        s = x[a : a + 128] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k].copy())  # a view would hold the whole block
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Cuts the graph: nodes move to the part of most of their neighbours while it has room."""
    n, rng = len(x), np.random.default_rng(seed)
    most = int(np.ceil(SLACK * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    part = _fill(x @ centres.T, most)
    for _ in range(3):  # a rough start by place
        centres = np.stack([x[part == p].mean(axis=0) for p in range(parts)])
        part = _fill(x @ centres.T, most)
    for _ in range(ROUNDS):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        wish, size, moved = votes.argmax(axis=1), np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[wish[i]] < most:
                size[part[i]] -= 1
                size[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if moved * 100 < n:
            break
    return part


def _fill(score: np.ndarray, most: int) -> np.ndarray:
    """The best part with room for each node, the clearest cases first."""
    n, parts = score.shape
    order = np.argsort(-score, axis=1, kind="stable")
    clear = -np.take_along_axis(score, order[:, :1], 1).ravel()
    part, size = np.zeros(n, np.int64), np.zeros(parts, np.int64)
    for i in np.argsort(clear, kind="stable"):
        for p in order[i]:
            if size[p] < most:
                part[i] = p
                size[p] += 1
                break
    return part


def learn(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 150, rate: float = 0.05) -> np.ndarray:
    """Softmax regression from the direction of a vector to its part."""
    z = np.column_stack([unit(x), np.ones(len(x))])
    w, m, v = np.zeros((z.shape[1], parts)), 0.0, 0.0
    true = np.zeros((len(x), parts))
    true[np.arange(len(x)), part] = 1
    for t in range(1, steps + 1):
        s = z @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = z.T @ (p / p.sum(axis=1, keepdims=True) - true) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def fit(x: np.ndarray, parts: int, k: int) -> Router:
    """Fits on sampled vectors; the visits cover ``COVER`` of the sample's k nearest."""
    if parts <= 1 or len(x) <= 4 * parts or len(x) <= k + 1:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1)
    scaled = x / np.linalg.norm(x, axis=1).mean()
    part = balanced_parts(unit(x), neighbour_graph(scaled, min(GRAPH_DEGREE, len(x) - 1)), parts)
    router = Router(learn(x, part, parts), parts)
    order = router.order(x)
    filed = order[:, 0]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    asked = np.arange(0, len(x), max(1, len(x) // 1024))
    near = neighbour_graph(scaled, k)[asked]
    deep = np.sort(rank[asked[:, None], filed[near]].ravel())
    router.visits = int(deep[min(len(deep) - 1, int(np.ceil(COVER * len(deep))))]) + 1
    return router


def _by_length(batch: pa.RecordBatch, usual: int):
    """Rows of the usual length and their vectors; lengths and rows of each other length."""
    size = np.diff(batch.column("v").offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
    rows = np.flatnonzero(size == usual)
    others = [(int(d), np.flatnonzero(size == d)) for d in np.unique(size) if d != usual]
    return rows, matrix(batch.column("v").take(pa.array(rows))) if len(rows) else None, others


def best_of(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[list[dict]]:
    """The k best of ``x`` for each query, by scores whose terms are added in one order wherever a pair is compared."""
    lists = []
    for a in range(0, len(q), 256):
        with np.errstate(over="ignore", invalid="ignore"):
            s = q[a : a + 256] @ x.T
        s = np.where(np.isnan(s), np.inf, s)
        mine = own[a : a + 256, None] == ids
        s[mine] = -np.inf
        m = min(k, s.shape[1])
        least = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        for row, low, no, v in zip(s, least, mine, q[a : a + 256], strict=True):
            # the product's last bits depend on the block: take what is close to the last one too
            near = np.flatnonzero((row >= low - 1e-9 * abs(low) - 1e-12 if np.isfinite(low) else row >= low) & ~no)
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (x[near] * v).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            lists.append([{"score": float(exact[i]), "vec_id": int(ids[near[i]])} for i in order])
    return lists


FOUND = pa.schema([("query_id", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])
FOUND_DDL = "query_id long, found array<struct<score:double,vec_id:long>>"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """query_id and its k best (far: the negative score, vec_id), the nearest first."""
    best = found.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    ordered = F.array_sort(F.transform("found", lambda x: F.struct((-x["score"]).alias("far"), x["vec_id"].alias("vec_id"))))
    return best.select("query_id", F.slice(ordered, 1, k).alias("best"))


def routed_search(ws: Workspace, rows: DataFrame, queries: DataFrame, router: Router, usual: int, k: int, name: str) -> DataFrame:
    """query_id and its k best among the vectors of the parts that it visits; vectors of other lengths than usual have a part for each length."""
    n, parts, visits = rows.count(), router.weights.shape[1], router.visits
    blocks = max(1, -(-n // (parts * BLOCK_ROWS)) * 2)

    def placed(batch: pa.RecordBatch, visits: int) -> pa.RecordBatch:
        mine, x, others = _by_length(batch, usual)
        at, part = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if x is not None:
            order = router.order(x)[:, :visits]
            at.append(np.repeat(mine, order.shape[1]))
            part.append(order.ravel())
        for d, others_ in others:
            at.append(others_)
            part.append(np.full(len(others_), -d))
        return pa.RecordBatch.from_arrays([*batch.take(pa.array(np.concatenate(at))).columns, pa.array(np.concatenate(part).astype(np.int32))], ["vec_id", "v", "part"])

    def file(batches):
        yield from (placed(b, 1) for b in batches)

    def route(batches):
        yield from (placed(b, visits) for b in batches)

    def compare(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return FOUND.empty_table()
        found = best_of(matrix(asked.column("v")), asked.column("vec_id").to_numpy(), matrix(there.column("v")), there.column("vec_id").to_numpy(), k)
        return pa.table([asked.column("vec_id"), pa.array(found, FOUND.field("found").type)], schema=FOUND)

    schema = "vec_id long, v array<double>, part int"
    # a part that holds many rows is compared in blocks
    filed = rows.mapInArrow(file, schema).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    routed = queries.mapInArrow(route, schema).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    per_part = ws.save(routed.groupBy("part", "block").cogroup(filed.groupBy("part", "block")).applyInArrow(compare, FOUND_DDL), f"found{name}")
    # at most visits x blocks short lists a query
    return ws.save(_merged(per_part, k), f"best{name}")


def audit(rows: DataFrame, queries: DataFrame, best: DataFrame, k: int, most: int = AUDIT) -> float:
    """The share of the true nearest that ``best`` has, on the ``most`` queries that come first by hash, compared with all vectors."""
    picked = queries.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(most).collect()
    asked: dict[int, list] = {}
    for r in picked:
        asked.setdefault(len(r["v"]), []).append(r)
    asked = {d: (np.array([r["vec_id"] for r in rs]), np.array([r["v"] for r in rs], np.float64)) for d, rs in asked.items()}

    def compare(batches):
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            for d, (own, q) in asked.items():
                at = np.flatnonzero(size == d)
                if len(at):
                    found = best_of(q, own, matrix(batch.column("v").take(pa.array(at))), batch.column("vec_id").to_numpy()[at], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found, FOUND.field("found").type)], schema=FOUND)

    true = _merged(rows.mapInArrow(compare, FOUND_DDL), k).select("query_id", F.transform("best", lambda x: x["far"]).alias("true"))
    # by scores: of equal ones any will do
    both = true.join(best, "query_id", "left").select("true", F.coalesce(F.transform("best", lambda x: x["far"]), F.array().cast("array<double>")).alias("found"))
    seen = both.agg(F.sum(F.size("true")).alias("all"), F.sum(F.size(F.filter("true", lambda t: F.col("found")[F.size("found") - 1] >= t))).alias("hit")).first()
    return seen["hit"] / seen["all"] if seen["all"] else 1.0


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` rows of largest inner product with each row whose vec_id ``every`` divides.

    Takes vec_id and embedding; returns query_id, rank (from 1), vec_id, score, nearest
    first, ties to the smaller vec_id.

    Defined results: vectors that are null, empty, zero, hold null or non-finite
    components, or have a null id, take no part; a query's candidates are the vectors of its
    length; rows with a query's id are not its candidates; a repeated query row answers once,
    a repeated candidate row is a candidate each time; with fewer candidates all are returned;
    an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(vectors.sparkSession, "search")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = ws.save(rows.where(F.col("vec_id").isNotNull() & is_vector(F.col("v"))), "rows")
    usual, n = usual_length(rows, "v"), rows.count()
    parts = min(MOST_PARTS, max(LEAST_PARTS, n // PART)) if n >= TRIVIAL else 1
    turn = F.xxhash64("vec_id", F.lit(3))
    sample = rows.where(F.size("v") == usual).orderBy(turn, "vec_id").limit(SAMPLE).select("v").toArrow()
    router = fit(matrix(sample.column("v")).reshape(sample.num_rows, max(1, usual)), parts, k)
    del sample
    parts = router.weights.shape[1]
    queries = ws.save(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    while True:
        best = routed_search(ws, rows, queries, router, usual, k, str(router.visits))
        if router.visits >= parts or audit(rows, queries, best, k) >= LEAST_RECALL:
            break
        router.visits = min(parts, 2 * router.visits)
    flat = best.select("query_id", F.posexplode("best").alias("rank", "x"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op8_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op8_search": op8_search}
ORACLE_SQL: dict[str, str] = {}

"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors of one label become one node with a count.
2. Nodes are dealt to clusters of their label: to the nearest centroid (home) and to the
   next ones (overlap).  Each shard builds a graph: the nearest candidates of a node,
   pruned so that a kept neighbour stands for those that lie nearer to it.
3. The adjacency lists that a node got in its shards are united.
4. Home by home, every node is searched for: a greedy beam walks from the medoid, then the
   range expands over the edges as long as it finds vectors within the threshold.
   Every link is verified by the cosine in double precision.
5. Recall is audited on a bounded number of nodes, some of any kind and some with links,
   against all vectors of their label, and the overlap is widened where it is too low.  Once
   every node is in every shard of its label, all vectors of the shard are compared, which
   is exact.

Vectors of one label and length are a kind; only those can link.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.vectors import is_vector, matrix, unit
from lodestone.llm.workspace import Workspace

THRESHOLD = 0.93
#: Nodes of a cluster, about; centroids of one label at most; clusters that a node is dealt to.
CLUSTER, MOST_CENTROIDS, ALL_CENTROIDS, OVERLAP = 512, 4096, 16384, 3
#: Edges out of a node, candidates it is pruned from, slack of the pruning, width of the beam.
DEGREE, POOL, ALPHA, BEAM = 24, 64, 1.2, 16
#: Nodes that are audited of each sort; true links that tell enough; the least recall of links.
AUDIT, AUDIT_LINKS, LEAST_RECALL = 256, 64, 0.97
_BLOCK = 1024


def robust_prune(x: np.ndarray, pool: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of every node from its ``pool`` (nearest first): -1 where there are fewer.

    A candidate is dropped if a kept neighbour is nearer to it, by the factor alpha, than
    the node is.  All nodes are pruned in step.
    """
    n, m = pool.shape
    apart = np.sqrt(np.maximum(0, 2 - 2 * sims))
    alive, out = pool >= 0, np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for d in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        r = rows[some]
        pick = np.argmax(alive[r], axis=1)
        kept = pool[r, pick]
        out[r, d] = kept
        alive[r, pick] = False
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rmk,rk->rm", x[pool[r]], x[kept])))
        alive[r] &= ~(alpha * between <= apart[r])
    return out


def build_graph(x: np.ndarray) -> np.ndarray:
    n = len(x)
    m = min(POOL, n - 1)
    if m < 1:
        return np.full((n, DEGREE), -1, np.int64)
    out = []
    for a in range(0, n, _BLOCK):
        s = x[a : a + _BLOCK] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        pool = np.argpartition(-s, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(s, pool, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
        out.append(robust_prune(x, pool, near))
    return np.concatenate(out)


def greedy(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, medoid: int, beam: int = BEAM) -> np.ndarray:
    """The ``beam`` best nodes that each query meets on its walk from the medoid (-1: fewer)."""
    q = len(queries)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf)
    seen = np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], seen[:, 0] = medoid, queries @ x[medoid], False
    for _ in range(len(x)):
        open_ = np.where(seen, -np.inf, sims)
        pick = np.argmax(open_, axis=1)
        going = np.flatnonzero(open_[np.arange(q), pick] > -np.inf)
        if not len(going):
            break
        seen[going, pick[going]] = True
        more = edges[ids[going, pick[going]]]
        known = (more[:, :, None] == ids[going][:, None, :]).any(axis=2) | (more < 0)
        s = np.where(known, -np.inf, np.einsum("qdk,qk->qd", x[more], queries[going]))
        all_ids, all_sims = np.concatenate([ids[going], more], 1), np.concatenate([sims[going], s], 1)
        all_seen = np.concatenate([seen[going], np.isneginf(s)], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[going], sims[going], seen[going] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_sims, all_seen))
    return np.where(np.isneginf(sims), -1, ids)


def search_range(x: np.ndarray, start: np.ndarray, flat: np.ndarray, query: np.ndarray, seeds: np.ndarray, threshold: float) -> np.ndarray:
    """All nodes within the threshold that edges over such nodes lead to."""
    inside = np.zeros(len(x), bool)
    visited = np.zeros(len(x), bool)
    visited[seeds] = True
    front = seeds[x[seeds] @ query >= threshold]
    while len(front):
        inside[front] = True
        size = start[front + 1] - start[front]
        at = np.repeat(start[front] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        new = flat[at]
        new = np.unique(new[~visited[new]])
        visited[new] = True
        front = new[x[new] @ query >= threshold]
    return np.flatnonzero(inside)


def _centroids(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Of each kind of ``2 * CLUSTER`` nodes at least, those that come first by hash: one for ``CLUSTER`` nodes, ``MOST_CENTROIDS`` at most.

    All kinds together have ``ALL_CENTROIDS`` at most, by their sizes, so what goes to the
    tasks has a bound.  Kinds with a share below two are one shard each and have none.
    """
    from pyspark.sql import Window as W

    every = max(1, nodes.count())
    total = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    total = total.withColumn("share", F.least(F.lit(MOST_CENTROIDS), F.floor(F.col("n") / CLUSTER), F.floor(F.col("n") * ALL_CENTROIDS / every))).where("share >= 2")
    # a hash below the share of twice the number wanted; of these the first by hash
    turn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30))
    likely = turn < F.least(F.lit(1.0), (F.col("share") * 2 + 32) / F.col("n")) * (1 << 30)
    picked = nodes.withColumn("turn", turn).join(total, "kind").where(likely)
    picked = picked.withColumn("nth", F.row_number().over(W.partitionBy("kind").orderBy("turn", "node"))).where(F.col("nth") <= F.col("share"))
    out: dict[int, list] = {}
    for r in picked.select("kind", "nth", "v").orderBy("kind", "nth").toLocalIterator():
        out.setdefault(r["kind"], []).append(r["v"])
    return {k: unit(np.array(v, np.float64)) for k, v in out.items()}


def _dealt(nodes: DataFrame, centroids: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """A row for every shard of every node: cluster (of its kind), home."""
    names = ["node", "kind", "copies", "v", "cluster", "home"]

    def deal(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            at, cluster, home = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for k in np.unique(kind):
                rows, c = np.flatnonzero(kind == k), centroids.get(int(k))
                m = 1 if c is None else min(overlap, len(c))
                near = np.zeros((len(rows), 1), np.int64)
                if c is not None:
                    near = np.argsort(-(unit(matrix(batch.column("v").take(pa.array(rows)))) @ c.T), axis=1, kind="stable")[:, :m]
                at.append(np.repeat(rows, m))
                cluster.append(near.ravel())
                home.append(np.tile(np.arange(m) == 0, len(rows)))
            part = batch.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(cluster).astype(np.int32)), pa.array(np.concatenate(home))], names)

    return nodes.mapInArrow(deal, "node long, kind long, copies long, v array<double>, cluster int, home boolean")


def _adjacency(ws: Workspace, dealt: DataFrame) -> DataFrame:
    """node and its neighbours from all its shards."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table.column("node").to_numpy()
        edges = build_graph(unit(matrix(table.column("v"))))
        return pa.table([pa.array(node), pa.array([node[e[e >= 0]] for e in edges], pa.list_(pa.int64()))], ["node", "near"])

    lists = dealt.groupBy("kind", "cluster").applyInArrow(build, "node long, near array<long>")
    return ws.save(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")


def _links(dealt: DataFrame, adjacency: DataFrame, threshold: float, exact: bool = False) -> DataFrame:
    """node, n_links (to copies of other nodes), linked (the smallest node that it hangs together with here).

    Nodes that are guests of a shard come without n_links, if they are linked there.  With
    ``exact``, a node is compared with all of its home shard.
    """
    rows = dealt.select("node", "kind", "copies", "v", "cluster", "home").join(adjacency, "node", "left")
    schema = pa.schema([("node", pa.int64()), ("n_links", pa.int64()), ("linked", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, copies, home = (table.column(c).to_numpy() for c in ("node", "copies", "home"))
        x = unit(matrix(table.column("v")))
        near = table.column("near").combine_chunks()
        size = np.diff(near.offsets.to_numpy())
        flat = near.flatten().to_numpy()
        a = np.repeat(np.arange(len(node)), np.where(near.is_valid().to_numpy(zero_copy_only=False), size, 0))
        place = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        there = node[place] == flat
        a, b = a[there], place[there]
        pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
        start, to = np.searchsorted(pairs[:, 0], np.arange(len(node) + 1)), pairs[:, 1]
        edges = np.full((len(node), DEGREE), -1, np.int64)
        order = np.argsort(-np.einsum("ek,ek->e", x[pairs[:, 0]], x[to]), kind="stable") if len(pairs) else np.zeros(0, np.int64)
        order = order[np.argsort(pairs[order, 0], kind="stable")]
        rank = np.arange(len(pairs)) - start[pairs[order, 0]]
        # the walk takes the nearest half of the slots, and spreads the other half over the rest
        degree = (start[1:] - start[:-1])[pairs[order, 0]]
        half = DEGREE // 2
        slot = np.where(rank < half, rank, half + (rank - half) * half // np.maximum(1, degree - half))
        edges[pairs[order, 0], np.minimum(slot, DEGREE - 1)] = to[order]
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        mine = np.flatnonzero(home)
        found = None if exact else greedy(x, edges, x[mine], medoid)
        n_links, root = np.zeros(len(mine), np.int64), np.arange(len(node))
        for k, u in enumerate(mine):
            if exact:
                inside = np.flatnonzero(x @ x[u] >= threshold - 1e-9)
            else:
                seeds = np.unique(np.r_[found[k][found[k] >= 0], u])
                inside = search_range(x, start, to, x[u], seeds, threshold - 1e-9)
            inside = inside[inside != u]
            inside = inside[(x[inside] * x[u]).sum(axis=1) >= threshold]  # one order of terms for both sides
            n_links[k] = copies[inside].sum()
            roots = np.unique(root[np.r_[inside, u]])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
        # links of nodes that are at home elsewhere count there, but join here
        guests = np.flatnonzero(~home & (root != np.arange(len(node))))
        who = np.r_[mine, guests]
        return pa.table([pa.array(node[who]), pa.array(np.r_[n_links, np.zeros(len(guests), np.int64)], mask=np.arange(len(who)) >= len(mine)), pa.array(node[root[who]])], schema=schema)

    return rows.groupBy("kind", "cluster").applyInArrow(search, "node long, n_links long, linked long")


def audit(nodes: DataFrame, found: DataFrame, threshold: float, most: int = AUDIT) -> tuple[float, int]:
    """Recall of links, and how many true ones that was measured on: on some nodes of any kind and on some that have links.

    Those that come first by hash, ``most`` of each sort, or eight times as many where they have too few links to tell.
    """
    turn = F.xxhash64("node", F.lit(11))
    linked = nodes.join(found.where("n_links > 0").select("node"), "node", "left_semi")
    for wanted in (most, 8 * most):
        both = nodes.orderBy(turn).limit(wanted).unionByName(linked.orderBy(turn).limit(wanted)).dropDuplicates(["node"])
        picked = both.join(found, "node", "left").select("node", "kind", "v", F.coalesce("n_links", F.lit(0)).alias("n_links")).collect()
        by_kind: dict[int, list] = {}
        for r in picked:
            by_kind.setdefault(r["kind"], []).append(r)
        asked = {k: (np.array([r["node"] for r in rows]), unit(np.array([r["v"] for r in rows], np.float64))) for k, rows in by_kind.items()}

        def count(batches, asked=asked):
            for batch in batches:
                kind, copies, node = (batch.column(c).to_numpy() for c in ("kind", "copies", "node"))
                for k in np.unique(kind):
                    if int(k) not in asked:
                        continue
                    ids, q = asked[int(k)]
                    rows = np.flatnonzero(kind == k)
                    near = (unit(matrix(batch.column("v").take(pa.array(rows)))) @ q.T >= threshold) & (node[rows, None] != ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.T @ copies[rows])], ["node", "true"])

        true = nodes.mapInArrow(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
        true = {r["node"]: r["true"] for r in true.collect()}  # a row for each node asked
        hit = sum(min(true.get(r["node"], 0), r["n_links"]) for r in picked)
        every = sum(true.values())
        if every >= AUDIT_LINKS:
            break
    return (hit / every if every else 1.0), every


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """Links vectors of one label whose cosine is ``threshold`` at least.

    Takes vec_id, embedding and label; returns vec_id, n_links, component_id, kept (the
    vector with the smallest id of its component), one row per vector.

    Defined results: vectors that are null, empty, zero or hold null or non-finite
    components, and those with a null label or a null id, link with nothing and are
    their own component; equal vectors link; repeated rows are vectors of their own
    that share an id; vectors of different lengths do not link; an empty
    table gives no rows; other columns are ignored.
    """
    ws = Workspace(vectors.sparkSession, "neighbours")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("int").alias("label"))
    takes_part = is_vector(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(takes_part).withColumn("kind", F.shiftleft(F.col("label").cast("long"), 24) + F.size("v"))
    keyed = ws.save(good.withColumn("key", F.sha2(F.concat_ws(",", F.col("kind").cast("string"), F.to_json("v")), 256)).select("vec_id", "v", "kind", "key"), "keyed")
    nodes = keyed.groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("kind").alias("kind"), F.first("v").alias("v"))
    # an id may stand for several vectors, so nodes are named by a hash of theirs
    nodes = ws.save(nodes.select("key", F.xxhash64("key").alias("node"), F.col("node").alias("least"), "copies", "kind", "v"), "nodes")
    basic = nodes.select("node", "kind", "copies", "v")
    centroids = _centroids(basic)
    most = max(map(len, centroids.values()), default=1)
    for k in itertools.count():
        exact = k > 0 and overlap >= most
        dealt = ws.save(_dealt(basic, centroids, overlap), f"dealt{k}")
        searched = ws.save(_links(dealt, _adjacency(ws, dealt), threshold, exact), f"searched{k}")
        found = searched.where("n_links is not null").select("node", "n_links")
        if exact or audit(basic, found, threshold)[0] >= LEAST_RECALL:
            break
        overlap *= 2
    joined = connected_components(ws, searched.select(F.col("node").alias("a"), F.col("linked").alias("b")), "groups")
    component = F.coalesce("component", "node")
    by_node = nodes.select("key", "node", "copies", "least").join(found, "node").join(joined, "node", "left").withColumn("component", component)
    by_node = ws.save(by_node, "by_node")
    least = by_node.groupBy("component").agg(F.min("least").alias("component_id"))
    info = ws.save(by_node.join(least, "component").select("key", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), "component_id"), "info")
    linked = keyed.select("vec_id", "key").join(info, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where(~takes_part)
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON r.other = p.a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n ON n.a = v.vec_id
"""

QUERIES = {"op3_neighbours": op3_neighbours}
ORACLE_SQL = {"op3_neighbours": OP3_SQL}

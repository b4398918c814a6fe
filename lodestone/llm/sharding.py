"""Balanced label propagation: linked documents end in one shard while shards stay even.

DataFrame operations only.  Documents that share a text are neighbours.  Linked documents
start in hash-random shards; in each round a join tells every group where most of its
bytes are, and members move there as far as the quotas of both shards allow.  Documents
without neighbours cut no edge wherever they lie, so they level the sizes afterwards.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.workspace import Workspace, literal_table, running_totals

SHARDS, ROUNDS = 8, 3
#: Moves between two shards are let through by slices of the linked groups.
MOVE_SLICES = 1024
#: Unlinked documents are dealt out in units of one size class (a power of two) and one of so many hash slices.
FILL_SLICES = 256


def propagate(ws: Workspace, linked: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, int]]:
    """Moves members of a group together.  ``linked``: grp, size, turn, group_bytes and more.

    Returns the rows with ``shard``, and the bytes of each shard.  No shard takes in bytes
    beyond ``quota``.  The driver sees sums over at most shards x shards x slices.
    """
    state = ws.save(linked.withColumn("shard", F.pmod("turn", F.lit(shards)).cast("int")), "state0")
    for k in range(rounds):
        per_shard = state.groupBy("grp", "shard").agg(F.sum("size").alias("w"))
        best = per_shard.groupBy("grp").agg(F.max_by("shard", F.struct("w", F.xxhash64("grp", "shard"))).alias("best"))
        best = ws.save(best, f"best{k}")
        # a group moves as one, but one too large for the quotas moves document by document
        own = F.when(F.col("group_bytes") * 64 > quota, F.col("turn")).otherwise(F.lit(0))
        told = state.join(best, "grp").withColumn("slice", F.pmod(F.xxhash64("grp", own, F.lit(k)), F.lit(MOVE_SLICES)))
        moves = ws.save(told, f"told{k}")
        sums = moves.groupBy("shard", "best", "slice").agg(F.sum("size").alias("w")).collect()
        load, wish = defaultdict(int), defaultdict(dict)
        for r in sums:
            load[r["shard"]] += r["w"]
            if r["shard"] != r["best"]:
                wish[r["shard"], r["best"]][r["slice"]] = r["w"]
        limits = _limits(load, wish, shards, quota)
        if not limits:
            state = moves.drop("best", "slice")
            break
        table = literal_table(ws.spark, [{"shard": a, "best": b, "upto": n} for (a, b), n in limits.items()], "shard int, best int, upto int")
        # at most shards x shards rows
        moved = moves.join(F.broadcast(table), ["shard", "best"], "left")
        moved = moved.withColumn("shard", F.when(F.col("slice") < F.col("upto"), F.col("best")).otherwise(F.col("shard")))
        state = ws.save(moved.drop("best", "slice", "upto"), f"state{k + 1}")
        ws.drop(f"best{k}", f"told{k}", f"state{k}")
    sizes = {s: 0 for s in range(shards)} | {r["shard"]: r["w"] for r in state.groupBy("shard").agg(F.sum("size").alias("w")).collect()}
    return state, sizes


def _limits(load: dict, wish: dict, shards: int, quota: int) -> dict:
    """For each pair of shards, below which slice documents may move.

    What two shards want of each other is exchanged; the rest of a shard's wishes shares
    the room that its target still has.
    """
    total = {p: sum(w.values()) for p, w in wish.items()}
    room = {}
    for b in range(shards):
        rest = sum(max(0, total.get((a, b), 0) - total.get((b, a), 0)) for a in range(shards))
        free = max(0, quota - load.get(b, 0))
        room[b] = min(1.0, free / rest) if rest else 0.0
    out = {}
    for (a, b), slices in wish.items():
        back = total.get((b, a), 0)
        allowed = min(total[a, b], back) + max(0, total[a, b] - back) * room[b]
        upto, moved = 0, 0
        for n in sorted(slices):
            if moved + slices[n] > allowed:
                break
            moved, upto = moved + slices[n], n + 1
        if upto:
            out[a, b] = upto
    return out


def level(ws: Workspace, rest: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Deals out unlinked documents, the largest units first, each to the emptiest shard.

    The units are counted, not the documents: there are at most 64 size classes times
    ``FILL_SLICES`` of them, whatever the size of the corpus.
    """
    unit = [F.floor(F.log2(F.col("size").cast("double"))).cast("int").alias("class"), F.pmod("turn", F.lit(FILL_SLICES)).cast("int").alias("part")]
    units = rest.groupBy(*unit).agg(F.sum("size").alias("w")).collect()
    load, dealt = dict(sizes), []
    for r in sorted(units, key=lambda r: (-r["w"], r["class"], r["part"])):
        to = min(load, key=lambda s: (load[s], s))
        load[to] += r["w"]
        dealt.append({"class": r["class"], "part": r["part"], "shard": to})
    table = literal_table(ws.spark, dealt, "class int, part int, shard int")
    return rest.select("*", *unit).join(F.broadcast(table), ["class", "part"]).drop("class", "part")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Puts every document (doc_id, text) into a shard; documents with equal texts are linked.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard.
    The law is ``bytes``: shards have nearly equal sizes.  A group stays together unless
    it is larger than a shard's quota or would break it.

    Defined results: a null text has no bytes and links like an empty one; null doc_ids
    and repeated rows are placed like any other row; an empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    ws = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("grp"))
    rows = ws.save(rows.withColumn("turn", F.xxhash64("doc_id", "grp")), "rows")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("group_bytes")).where("copies > 1").drop("copies")
    groups = ws.save(groups, "groups")
    quota = -(-(seen["bytes"] or 0) // shards)
    linked, sizes = propagate(ws, rows.join(groups, "grp"), shards, quota, rounds)
    rest = ws.save(rows.join(groups, "grp", "left_anti"), "rest")
    columns = ["doc_id", "size", "text_crc32", "turn", "shard"]
    placed = ws.save(linked.select(*columns).unionByName(level(ws, rest, sizes).select(*columns)), "placed")
    slots = running_totals(ws, placed.withColumn("one", F.lit(1)), ["shard"], ["turn", "doc_id"], "one", "slot", seen["n"], "slots")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op4_sharding": op4_sharding}
ORACLE_SQL: dict[str, str] = {}

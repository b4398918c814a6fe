"""Chat formatting by quotation linking, with DataFrame operations only.

Every message is split into lines with a quote level (the number of > before it).  Runs of
lines of one level, and single lines, are normalised and hashed; quoted passages are
joined, within their conversation, to the last earlier message whose own text holds the same
passage.  The quoted message that most of a message's first-level quotes come from is its
parent; a message that quotes nothing known answers the one before it.  Parents are
followed by pointer jumping, so a conversation of any length is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.workspace import Workspace

QUOTE = r"^((?:[ \t]*>)+)"
#: Lines that introduce a quotation, in the four languages of the tables.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb\b.*|el\b.*\bescribió|.*\bwrites)\s*:\s*$"
#: Turns of one conversation that are looked at together for the message before.
TURN_SLICE = 256
MOST_JUMPS = 40


def parse(messages: DataFrame) -> DataFrame:
    """Lines of messages: mid, conv_id, turn, line, level, body, norm, run.

    A run is broken by another level and by a blank line; a line that introduces a
    quotation, as the last before one, has level -1.
    """
    lines = messages.select("mid", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "raw"))
    mark = F.regexp_extract("raw", QUOTE, 1)
    lines = lines.withColumn("level", F.length(F.regexp_replace(mark, "[^>]", "")))
    lines = lines.withColumn("body", F.when(F.col("level") > 0, F.regexp_replace("raw", r"^(?:[ \t]*>)+ ?", "")).otherwise(F.col("raw")))
    lines = lines.withColumn("norm", F.trim(F.regexp_replace(F.lower("body"), r"\s+", " ")))
    w = W.partitionBy("mid").orderBy("line")
    following = F.lead("level").over(w)
    lines = lines.withColumn("level", F.when((F.col("level") == 0) & F.col("body").rlike(ATTRIBUTION) & (F.coalesce(following, F.lit(0)) > 0), F.lit(-1)).otherwise(F.col("level")))
    breaks = (F.col("level") != F.coalesce(F.lag("level").over(w), F.lit(-2))) | (F.col("norm") == "")
    return lines.withColumn("breaks", breaks).withColumn("run", F.sum(F.col("breaks").cast("int")).over(w)).drop("raw", "breaks")


def passages(lines: DataFrame) -> DataFrame:
    """Hashed passages: mid, conv_id, turn, level, hash, chars; runs, single lines, and whole own texts."""

    def joined(rows: DataFrame, *by: str) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "norm"))), lambda x: x["norm"]), " ")
        return rows.groupBy("mid", "conv_id", "turn", "level", *by).agg(text.alias("norm"))

    said = lines.where("norm <> '' and level >= 0")
    runs, whole = joined(said, "run").drop("run"), joined(said.where("level = 0"))
    every = said.select("mid", "conv_id", "turn", "level", "norm").unionByName(runs).unionByName(whole)
    return every.select("mid", "conv_id", "turn", "level", F.md5("norm").alias("hash"), F.length("norm").alias("chars")).distinct()


def before(messages: DataFrame, ws: Workspace) -> DataFrame:
    """conv_id, turn and the turn before it (null: the first)."""
    turns = messages.select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    turns = ws.save(turns.withColumn("slice", F.floor(F.col("turn") / TURN_SLICE)), "turns")
    ends = turns.groupBy("conv_id", "slice").agg(F.max("turn").alias("last"))
    ends = ws.save(ends.withColumn("earlier", F.lag("last").over(W.partitionBy("conv_id").orderBy("slice"))).select("conv_id", "slice", "earlier"), "ends")
    inside = F.lag("turn").over(W.partitionBy("conv_id", "slice").orderBy("turn"))
    return turns.join(ends, ["conv_id", "slice"]).select("conv_id", "turn", F.coalesce(inside, F.col("earlier")).alias("previous"))


def origins(asked: DataFrame, own: DataFrame, ws: Workspace) -> DataFrame:
    """``asked`` (conv_id, hash, turn, ...) where an earlier turn said the passage, with ``origin``: the last turn that did.

    Turns are sliced, so a passage that is said again and again makes no pairs and is not sorted in one task.
    """
    by, slice_ = ["conv_id", "hash"], F.floor(F.col("turn") / TURN_SLICE).alias("slice")
    wanted = asked.where("conv_id is not null and turn is not null")
    said = own.join(wanted.select(*by).distinct(), by, "left_semi").select(*by, "turn", F.col("turn").alias("origin"))
    both = ws.save(wanted.unionByName(said, allowMissingColumns=True).select("*", slice_), "said")
    ends = both.groupBy(*by, "slice").agg(F.max("origin").alias("last"))
    before_ = W.partitionBy(*by).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ends = ws.save(ends.select(*by, "slice", F.max("last").over(before_).alias("earlier")), "said_ends")
    inside = W.partitionBy(*by, "slice").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("inside", F.max("origin").over(inside)).where("mid is not null").join(ends, [*by, "slice"])
    return found.withColumn("origin", F.coalesce("inside", "earlier")).where("origin is not null").drop("inside", "earlier", "slice")


def follow(parents: DataFrame, ws: Workspace) -> DataFrame:
    """conv_id, turn, root_turn, depth: parents are followed twice as far in every round, where they lead on."""
    asked = F.col("parent_turn").isNotNull()
    now = parents.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("root_turn"), asked.cast("long").alias("depth"), asked.alias("open"))
    now = ws.save(now, "jump0")
    for k in range(1, MOST_JUMPS):
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        step = now.where("open").join(up, ["conv_id", "root_turn"]).select("conv_id", "turn", F.col("next").alias("root_turn"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("open"))
        now = ws.save(now.where("not open").unionByName(step), f"jump{k}")
        if not now.where("open").limit(1).count():
            break
    return now.drop("open")


def link_quotations(conversations: DataFrame) -> DataFrame:
    """Reply-ordered messages without their quotations.

    Takes conv_id, turn, role and text.  Returns conv_id, root_turn, turn, role, text (own
    words only), parent_turn, depth, quoted (passages at any level), linked (those found
    in an earlier message) and formatted (the message in chat markup).  Ordered by
    conv_id, root_turn and turn, every message comes after the one that it answers.

    Defined results: equal rows (all four columns) are one message; messages of one
    conversation and turn share their parent's turn and are told apart by role and text;
    null texts are empty; messages without conv_id or turn stand alone, with null
    parent, root and depth 0; quotations are searched for in earlier turns only, and a
    passage that several said counts for the last of them; an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(conversations.sparkSession, "chat")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    messages = ws.save(rows.dropDuplicates().withColumn("mid", F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text")))), "messages")
    lines = ws.save(parse(messages), "lines")
    known = ws.save(passages(lines), "passages")
    own = known.where("level = 0 and conv_id is not null and turn is not null").select("conv_id", "hash", "turn").distinct()
    asked = known.where("level > 0")
    hits = ws.save(origins(asked, own, ws), "hits")
    # first-level quotes decide, by the characters that they share with a message
    votes = hits.where("level = 1").groupBy("conv_id", "turn", "origin").agg(F.sum("chars").alias("chars"))
    chosen = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("chars", "origin")).alias("best")).select("conv_id", "turn", F.col("best.origin").alias("quoted_turn"))
    parents = before(messages, ws).join(ws.save(chosen, "chosen"), ["conv_id", "turn"], "left")
    parents = ws.save(parents.select("conv_id", "turn", F.coalesce("quoted_turn", "previous").alias("parent_turn")), "parents")
    roots = ws.save(follow(parents, ws).join(parents, ["conv_id", "turn"]), "roots")
    body = lines.where("level = 0").groupBy("mid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("own"))
    quoted = asked.groupBy("mid").agg(F.count(F.lit(1)).alias("quoted"))
    linked = hits.select("mid", "level", "hash").distinct().groupBy("mid").agg(F.count(F.lit(1)).alias("linked"))
    out = messages.join(body, "mid", "left").join(quoted, "mid", "left").join(linked, "mid", "left").join(roots, ["conv_id", "turn"], "left")
    text = F.regexp_replace(F.coalesce("own", F.lit("")), r"^\s+|\s+$", "")
    return out.select(
        "conv_id", "root_turn", "turn", "role", text.alias("text"), "parent_turn", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.coalesce("quoted", F.lit(0).cast("long")).alias("quoted"), F.coalesce("linked", F.lit(0).cast("long")).alias("linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n")).alias("formatted"),
    )


def op6_chat(spark, sf_dir: str) -> DataFrame:
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


QUERIES = {"op6_chat": op6_chat}
ORACLE_SQL: dict[str, str] = {}

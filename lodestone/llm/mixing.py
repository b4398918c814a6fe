"""Mixing sources to target weights, with DataFrame operations only.

Documents get a hash-random key (of id and text).  Word counts are summed per (source, slice of the key
range), running totals over the slices give every slice its place in its source, and
only the rows of one slice are ever sorted together.  The mix takes a source as many
whole times as its budget holds, and then its first words in key order up to the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.workspace import Workspace, fresh

WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3
#: Rows of one source and key slice, about; slices of a range.
SLICE_ROWS, RANGE_SLICES = 256, 4096


def word_count(text: Column) -> Column:
    """Runs of anything but blanks and control separators; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``sizes``: source, source_size (one row per source).  Adds ``target``.

    Sources by code point, null last, weigh ``weights`` in turn.  All targets together
    are all sizes together; a target stops at ``most_epochs`` times its source and the
    excess is shared again by weight.  That is the level at which sources fill: in the
    order of size per weight, those below the level are full.
    """
    nth, ring = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.array(*[F.lit(w) for w in weights])
    by_fill = W.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.col("total") - F.col("full_before")) / F.col("weight_left")
    out = (
        sizes.withColumn("weight", F.element_at(ring, (nth % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * most_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # full while the level that the rest would get is above its own limit
        .withColumn("full", level * F.col("weight") > F.col("most"))
    )
    # the first source that is not full has the largest weight_left: take the struct of that one
    out = out.withColumn("level", F.max(F.when(~F.col("full"), F.struct("weight_left", (F.col("total") - F.col("full_before")).alias("left")))).over(everything))
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.weight_left")
    return out.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = MOST_EPOCHS, seed: str = "mix", ws: Workspace | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken.

    The taken words of a source add up to its target, rounded: the document at the end of
    a budget is taken in part.  Words that a source repeats count each time.

    Defined results: a null text has no words; a null source is a source of its own, the
    last; null doc_ids are ordered like any other; repeated rows are single rows that
    tie, each with its own share; an empty table gives no rows; columns other than
    doc_id, text, source and ``keep`` are ignored.
    """
    ws = ws or Workspace(docs.sparkSession, "mix")
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"), turn.alias("turn"), *keep)
    rows = ws.save(rows, "rows")
    n = rows.count()
    slices = max(1, n // SLICE_ROWS)
    # eight hex digits of the key, cut evenly into slices
    at = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * slices / (1 << 32))
    rows = rows.withColumn("slice", at).withColumn("s_key", F.coalesce("source", F.lit(""))).withColumn("s_null", F.col("source").isNull())
    parts = rows.groupBy("s_key", "s_null", "slice").agg(F.sum("size").alias("part"), F.first("source").alias("source"))
    # totals before each slice in two steps: over ranges of slices, then over the slices of a range
    parts = ws.save(parts.withColumn("range", F.floor(F.col("slice") / RANGE_SLICES)), "slices")
    ranges = parts.groupBy("s_key", "s_null", "range").agg(F.sum("part").alias("range_part"))
    earlier = W.partitionBy("s_key", "s_null").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("s_key", "s_null", "range", F.coalesce(F.sum("range_part").over(earlier), F.lit(0)).alias("range_before"))
    inside = W.partitionBy("s_key", "s_null", "range").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.join(ranges, ["s_key", "s_null", "range"]).withColumn("before", F.col("range_before") + F.coalesce(F.sum("part").over(inside), F.lit(0)))
    parts = ws.save(parts.drop("range", "range_before"), "parts")
    sources = targets(parts.groupBy("s_key", "s_null").agg(F.first("source").alias("source"), F.sum("part").alias("source_size")).select("source", "source_size"), weights, most_epochs)
    sources = sources.select(F.coalesce("source", F.lit("")).alias("s_key"), F.col("source").isNull().alias("s_null"), "source_size", "target")
    parts = ws.save(parts.drop("source", "part").join(sources, ["s_key", "s_null"]), "placed")
    w = W.partitionBy("s_key", "s_null", "slice").orderBy("turn", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(parts, ["s_key", "s_null", "slice"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keep)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The documents of the mix, with their columns as they came: one row for each time a document is taken.

    A document at the end of a budget is taken whole if at least half of it fits.
    """
    key, times = fresh(docs, "mix_row"), fresh(docs, "mix_times")
    ws = Workspace(docs.sparkSession, "mixed")
    # equal rows of one key share their decision evenly enough: the key is the row's own content
    docs_keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    source = docs_keyed.select("doc_id", "source", "text", F.col(key).alias("row_key"))
    taken = mix(source, weights, most_epochs, ws=ws, keep=("row_key",))
    decided = taken.groupBy("doc_id", "row_key").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    decided = ws.save(decided.select(F.col("doc_id").alias("d"), "row_key", F.when(F.col("s") > 0, F.floor(F.col("t") / F.col("s") + 0.5)).otherwise(F.lit(0)).cast("int").alias(times)).where(F.col(times) > 0), "decided")
    out = docs_keyed.join(decided, docs_keyed["doc_id"].eqNullSafe(decided["d"]) & (docs_keyed[key] == decided["row_key"]))
    again = fresh(docs, "mix_again")
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs_keyed[c] for c in docs.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS turn FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, total - coalesce(sum(most) OVER before, 0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left FROM w
  WINDOW before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, left_over / weight_left * weight > most AS filled FROM f),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN filled THEN CAST(most AS DOUBLE) ELSE
    CAST((SELECT max({'w': weight_left, 'l': left_over}).l FROM g WHERE NOT filled) AS DOUBLE) * weight / (SELECT max(weight_left) FROM g WHERE NOT filled) END AS target FROM g),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id ASC NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
    + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - start)) AS BIGINT) AS taken
FROM p
"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL = {"op5_mixing": OP5_SQL}

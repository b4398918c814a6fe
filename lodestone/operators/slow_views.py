"""Slow-query views: which incoming queries contain a plan that is known to be slow?

Plans are tables of nodes.  ``capture`` reads a query's optimised plan; ``summarise`` makes
one row a subplan with what matching needs; ``excavate`` keeps the slow subplans; and
``match`` joins incoming subplans with stored ones, level by level: structure, join
types, ranges, sort keys, group keys, remaining predicates.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.recursion import recursive_union

NODE = "query_id string, node_id int, parent_id int, node_type string, join_type string, object string, ranges array<struct<col:string,low:double,low_inc:boolean,high:double,high_inc:boolean>>, sort_keys array<array<string>>, group_keys array<array<string>>, residual array<string>"

#: How much a join keeps; a stored join may be replaced by one that keeps as much or more.
JOIN_SCALE = {"LeftSemi": 1, "LeftAnti": 1, "Inner": 2, "Cross": 2, "LeftOuter": 3, "RightOuter": 3, "FullOuter": 4}

_COMPARISON = re.compile(r"\((\w+)#\d+L? (<=|>=|<|>|=) (-?\d+(?:\.\d+)?)D?\)|\((-?\d+(?:\.\d+)?)D? (<=|>=|<|>|=) (\w+)#\d+L?\)")
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}


def capture(df: DataFrame, query_id: str) -> DataFrame:
    """The nodes of a query's optimised plan; a plan is bounded by its query's text."""
    plan = df._jdf.queryExecution().optimizedPlan()
    out: list[tuple] = []

    def walk(node, parent: int | None) -> None:
        me, kind = len(out), node.nodeName()
        text = re.sub(r"#\d+L?", "", node.simpleString(1000))
        scan = re.search(r"\[([^\]]*)\] parquet|Relation (\S+)", text)
        own = node.simpleString(1000)
        ranges, rest = _predicates(own) if kind == "Filter" else ([], [])
        join = re.search(r"\b(LeftSemi|LeftAnti|Inner|Cross|LeftOuter|RightOuter|FullOuter)\b", own) if kind == "Join" else None
        residual = rest + ([re.sub(r"^Join \w+,?\s*", "", text)] if kind == "Join" else [])
        sort = [sorted(re.findall(r"(\w+) (?:ASC|DESC)", text))] if kind == "Sort" else []
        group = [sorted(x.strip() for x in re.search(r"Aggregate \[([^\]]*)\]", text)[1].split(",") if x.strip())] if kind == "Aggregate" and re.search(r"Aggregate \[([^\]]*)\]", text) else []
        out.append((query_id, me, parent, kind, join[1] if join else None, (scan[1] or scan[2]) if scan else None, ranges, sort, group, residual))
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k), me)

    walk(plan, None)
    return df.sparkSession.createDataFrame(out, NODE)


def _predicates(text: str) -> tuple[list[tuple], list[str]]:
    """Bounds by column, and what of a filter is no bound on a number; the narrowest of several bounds counts.

    A filter with OR, NOT or CASE in it has no bounds: it is one predicate that must be equal.
    """
    if re.search(r"\bOR\b|\bNOT\b|\bCASE\b", text):
        return [], [re.sub(r"#\d+L?", "", re.sub(r"^Filter ", "", text))]
    bounds: dict[str, list] = {}
    for m in _COMPARISON.finditer(text):
        name, op, value = (m[1], m[2], float(m[3])) if m[1] else (m[6], _FLIP[m[5]], float(m[4]))
        b = bounds.setdefault(name, [None, False, None, False])
        if op in (">", ">=", "=") and (b[0] is None or (value, op == ">") > (b[0], not b[1])):
            b[0], b[1] = value, op != ">"
        if op in ("<", "<=", "=") and (b[2] is None or (value, op != "<") < (b[2], b[3])):
            b[2], b[3] = value, op != "<"
    rest = _COMPARISON.sub("", re.sub(r"^Filter ", "", text))
    rest = [re.sub(r"#\d+L?", "", x).strip("() ") for x in rest.split(" AND ")]
    return [(n, *b) for n, b in sorted(bounds.items())], sorted(x for x in rest if x and not x.startswith("isnotnull"))


def summarise(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """One row a subplan: its structure, joins in order, ranges, keys and remaining predicates.

    Every node is told to all nodes above it; the steps up are joins, as many as the
    deepest plan has levels, and each is stored before the next.
    """
    up = nodes.where("parent_id is not null").select("query_id", F.col("node_id").alias("top"), F.col("parent_id").alias("above"))
    below = nodes.select("query_id", F.col("node_id").alias("top"), "node_id")
    below = recursive_union(below, lambda step: step.join(up.hint("merge"), ["query_id", "top"]).select("query_id", F.col("above").alias("top"), "node_id"), distinct=False, most_steps=depth)
    # nodes may be made from a small file, which says nothing about their size: never broadcast
    told = below.join(nodes.hint("merge"), ["query_id", "node_id"])
    scale = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, n in JOIN_SCALE.items() for v in (k, n)]), F.col("join_type")), F.lit(0))
    each = F.struct("node_id", F.concat_ws(":", "node_type", F.coalesce("object", F.lit(""))).alias("what"), scale.alias("scale"), "ranges", "sort_keys", "group_keys", "residual")
    rows = told.groupBy("query_id", "top").agg(F.array_sort(F.collect_list(each.alias("n")), lambda a, b: a["node_id"] - b["node_id"]).alias("plan"))
    flat = lambda f: F.flatten(F.transform("plan", lambda x: x[f]))
    what = F.filter(F.transform("plan", lambda x: x["what"]), lambda w: ~F.startswith(w, F.lit("Project")) & ~F.startswith(w, F.lit("Filter")))
    return rows.select(
        "query_id", F.col("top").alias("node_id"), F.sha2(F.to_json(what), 256).alias("structure"), F.size("plan").alias("nodes"),
        F.filter(F.transform("plan", lambda x: x["scale"]), lambda s: s > 0).alias("joins"), flat("ranges").alias("ranges"),
        flat("sort_keys").alias("sort_keys"), flat("group_keys").alias("group_keys"), F.array_sort(F.array_distinct(flat("residual"))).alias("residual"),
    )


def excavate(subplans: DataFrame, costs: DataFrame, min_duration: float, tolerance: float = 1.0) -> DataFrame:
    """The subplans to store: more than a leaf, and at least ``min_duration * tolerance`` ms with all below them.

    ``costs``: query_id, node_id, sub_cost.
    """
    return subplans.join(costs.hint("merge"), ["query_id", "node_id"]).where((F.col("nodes") > 1) & (F.col("sub_cost") >= min_duration * tolerance))


def wider(new: Column, old: Column) -> Column:
    """Every bound of the incoming plan leaves in at least what the stored plan's bound on that column does."""

    def fits(n: Column) -> Column:
        def inside(o: Column) -> Column:
            low = n["low"].isNull() | (o["low"] > n["low"]) | ((o["low"] == n["low"]) & (n["low_inc"] | ~o["low_inc"]))
            high = n["high"].isNull() | (o["high"] < n["high"]) | ((o["high"] == n["high"]) & (n["high_inc"] | ~o["high_inc"]))
            return (o["col"] == n["col"]) & F.coalesce(low, F.lit(False)) & F.coalesce(high, F.lit(False))

        return F.exists(old, inside)

    return F.forall(new, fits)


def _keys_held(a: Column, b: Column) -> Column:
    """Every key set of a lies in a key set of b."""
    return F.forall(a, lambda s: F.exists(b, lambda d: F.size(F.array_except(s, d)) == 0))


#: What a match depends on.
SHAPE = ("structure", "joins", "ranges", "sort_keys", "group_keys", "residual")


def match(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """query_id and node_id of incoming subplans with the stored slow plan that each contains.

    Equal shapes are compared once; their subplans then meet by the shapes' names.
    """
    shape = F.sha2(F.to_json(F.struct(*SHAPE)), 256)
    incoming, store = incoming.withColumn("shape", shape), store.withColumn("shape", shape)
    shapes = lambda df, x: df.groupBy("shape").agg(*[F.first(c).alias(c) for c in SHAPE]).select(*[F.col(c).alias(f"{x}_{c}") for c in ("shape", *SHAPE)])
    joins = F.forall(F.zip_with("n_joins", "o_joins", lambda n, o: n >= o), lambda v: F.coalesce(v, F.lit(False)))
    new, old = shapes(incoming, "n"), shapes(store, "o")
    found = new.join(old, F.col("n_structure") == F.col("o_structure")).where(
        joins & wider(F.col("n_ranges"), F.col("o_ranges")) & _keys_held(F.col("o_sort_keys"), F.col("n_sort_keys"))
        & _keys_held(F.col("o_group_keys"), F.col("n_group_keys")) & (F.size(F.array_except("n_residual", "o_residual")) == 0)
    ).select("n_shape", "o_shape")
    slow = store.select(F.col("shape").alias("o_shape"), F.col("query_id").alias("slow_query"), F.col("node_id").alias("slow_node"), "sub_cost")
    named = incoming.select("query_id", "node_id", F.col("shape").alias("n_shape"))
    return named.join(found.join(slow, "o_shape"), "n_shape").select("query_id", "node_id", "slow_query", "slow_node", "sub_cost")


def explain_slow(df: DataFrame, store: DataFrame, query_id: str = "incoming") -> DataFrame:
    """The nodes of a query's plan, each with the slow plan that is known to begin there, if any."""
    nodes = capture(df, query_id)
    hits = match(summarise(nodes), store)
    return nodes.join(hits, ["query_id", "node_id"], "left").select("node_id", "parent_id", "node_type", "object", "slow_query", "sub_cost").orderBy("node_id")


def statements(spark: SparkSession, log: DataFrame) -> DataFrame:
    """Statistics of statements whose constants are taken out.  ``log``: text, ms, rows."""
    plain = F.regexp_replace(F.regexp_replace("text", r"'(?:[^']|'')*'", "?"), r"\b\d+(?:\.\d+)?\b", "?")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return log.groupBy(plain.alias("query")).agg(F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("total_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.avg("ms").alias("mean_ms"), F.sum("rows").alias("rows"))

"""Streams over the event feed run to the end, change feeds, user functions, and slow-query views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import user
from lodestone.operators import slow_views
from lodestone.plans.pairs import Pairs
from lodestone.streaming import feeds

P = Pairs()


def _events(t):
    return feeds.event_stream(t.spark, f"{t.sf_dir}/events.parquet")


@P.add("stream_tumbling", """
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def stream_tumbling(t):
    return feeds.run_complete(feeds.tumbling(_events(t), "1 hour"))


@P.add("stream_sliding", """
SELECT w AS window_start, w + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT *, unnest([time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '45 minutes', time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '30 minutes',
    time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes', time_bucket(INTERVAL '15 minutes', ts)]) AS w FROM events) GROUP BY ALL""")
def stream_sliding(t):
    return feeds.run_complete(feeds.sliding(_events(t), "1 hour", "15 minutes"))


@P.add("stream_sessions", """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stream_sessions(t):
    return feeds.run_complete(feeds.sessions(_events(t), "30 minutes"))


@P.add("stream_interval_join", """
SELECT a.event_id AS l_id, b.event_id AS r_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1 hour'
WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def stream_interval_join(t):
    out = feeds.interval_join(_events(t).where("event_type = 'view'"), _events(t).where("event_type = 'purchase'"), "user_id", "1 HOUR")
    return feeds.run_append(out.select("l_id", "r_id"))


@P.add("stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(t):
    return feeds.run_append(_events(t).join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"))


@P.add("stream_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stream_dedup(t):
    return feeds.run_append(feeds.first_of(_events(t), ["user_id", "event_type"], "60 days")).agg(F.count(F.lit(1)).alias("n"))


@P.add("feed_apply_changes", """
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id)
SELECT user_id, value FROM last WHERE event_type <> 'error'""")
def feed_apply_changes(t):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    changes = t.events.select(F.col("event_id").alias("lsn"), op.alias("op"), "user_id", "value")
    return feeds.apply_changes(t.events.select("user_id", "value").limit(0), changes, ["user_id"])


@P.add("udaf_geometric_mean", "SELECT p_type, round(exp(avg(ln(p_retailprice))), 4) AS g FROM part GROUP BY p_type")
def udaf(t):
    return t.part.groupBy("p_type").agg(F.round(user.geometric_mean("p_retailprice"), 4).alias("g"))


@P.add("udtf_words", "SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1)::INT AS position, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf(t):
    return t.part.select("p_partkey", "p_name").lateralJoin(user.Words(F.col("p_name").outer())).select("p_partkey", "position", "word")


@P.add("udf_sql", "SELECT p_partkey, round(p_retailprice * 1.1, 4) AS gross FROM part")
def udf_sql(t):
    user.create_functions(t.spark)
    return t.part.select("p_partkey", F.round(F.expr("price_with_tax(p_retailprice)"), 4).alias("gross"))


@P.add("udf_strict", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || o_orderpriority END AS s FROM orders")
def udf_strict(t):
    joined = user.strict(lambda a, b: F.concat_ws("", a, b))
    return t.orders.select("o_orderkey", joined(F.nullif("o_orderstatus", F.lit("P")), F.col("o_orderpriority")).alias("s"))


@P.add("slow_view_match", "SELECT 'wider' AS query_id UNION ALL SELECT 'same'")
def slow_view_match(t):
    """Which of four queries contain the slow one: a join with a range on the quantity."""

    def query(low: int, high: int):
        return t.lineitem.where(F.col("l_quantity").between(low, high)).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").count()

    slow = slow_views.summarise(slow_views.capture(query(5, 10), "slow"))
    costs = slow.select("query_id", "node_id", F.lit(900.0).alias("sub_cost"))
    store = slow_views.excavate(slow, costs, 500.0)
    incoming = None
    for name, low, high in (("wider", 4, 12), ("same", 5, 10), ("narrower", 6, 9), ("disjoint", 20, 30)):
        nodes = slow_views.capture(query(low, high), name)
        incoming = nodes if incoming is None else incoming.unionByName(nodes)
    return slow_views.match(slow_views.summarise(incoming), store).where("node_id = 0").select("query_id").distinct()


@P.add("slow_view_nodes", """
WITH q AS (SELECT p_partkey, p_type, p_size AS low, p_size + p_partkey % 9 AS high, p_retailprice FROM part)
SELECT 'q' || n.p_partkey AS query_id, 'q' || o.p_partkey AS slow_query, o.p_retailprice AS sub_cost FROM q n JOIN q o
ON n.p_type = o.p_type AND n.low <= o.low AND n.high >= o.high AND o.p_partkey % 20 = 0 AND o.p_retailprice >= 905""")
def slow_view_nodes(t):
    """Plans as a table of nodes: an aggregate over a join of a filtered scan; one in twenty is known to be slow."""
    name, size = F.concat(F.lit("q"), F.col("p_partkey").cast("string")), F.col("p_size").cast("double")
    span = F.array(F.struct(F.lit("quantity").alias("col"), size.alias("low"), F.lit(True).alias("low_inc"), (size + F.col("p_partkey") % 9).alias("high"), F.lit(True).alias("high_inc")))
    keys, none = F.array(F.array(F.lit("priority"))), F.array().cast("array<array<string>>")
    plan = [("Aggregate", None, None, None, keys), ("Join", 0, "Inner", None, none), ("Filter", 1, None, None, none), ("Scan", 2, None, F.col("p_type"), none), ("Scan", 1, None, F.lit("orders"), none)]
    node = [F.struct(
        F.lit(k).alias("node_id"), F.lit(parent).cast("int").alias("parent_id"), F.lit(kind).alias("node_type"), F.lit(join).cast("string").alias("join_type"),
        (F.lit(None).cast("string") if table is None else table).alias("object"), (span if kind == "Filter" else F.filter(span, lambda _: F.lit(False))).alias("ranges"),
        none.alias("sort_keys"), group.alias("group_keys"), F.array().cast("array<string>").alias("residual")) for k, (kind, parent, join, table, group) in enumerate(plan)]
    nodes = t.part.select(name.alias("query_id"), F.explode(F.array(*node)).alias("n")).select("query_id", "n.*")
    subplans = slow_views.summarise(nodes)
    costs = t.part.where("p_partkey % 20 = 0").select(name.alias("query_id"), F.lit(0).alias("node_id"), F.col("p_retailprice").alias("sub_cost"))
    return slow_views.match(subplans, slow_views.excavate(subplans, costs, 905.0)).where("node_id = 0").select("query_id", "slow_query", "sub_cost")


@P.add("statement_statistics", "SELECT 'SELECT ? FROM t WHERE x = ?' AS query, count(*) AS calls, sum(value) > 0 AS busy FROM events")
def statement_statistics(t):
    log = t.events.select(F.concat(F.lit("SELECT 1  FROM t WHERE x = "), F.col("user_id")).alias("text"), F.col("value").alias("ms"), F.lit(1).alias("rows"))
    return slow_views.statements(t.spark, log).select("query", "calls", (F.col("total_ms") > 0).alias("busy"))


QUERIES, ORACLE_SQL = P.queries, P.oracle

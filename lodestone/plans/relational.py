"""Scans, predicates, joins, aggregates, windows, sorting and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import recursion, relational as R, windows as V
from lodestone.plans.pairs import Pairs

P = Pairs()

# Scans and sources ------------------------------------------------------------------
P.same("scan_filter_project", "SELECT l_orderkey, l_partkey, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_discount = 0.05")
P.same("scan_bitmap_or", "SELECT o_orderkey, o_custkey FROM {orders} WHERE (o_totalprice < 20000 OR o_orderpriority = '1-URGENT') AND o_orderstatus = 'F'")
P.same("scan_values", "SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(id, name)")
P.same("scan_subquery", "SELECT k, n FROM (SELECT l_returnflag AS k, count(*) AS n FROM {lineitem} GROUP BY l_returnflag) AS s WHERE n > 10")
P.same("scan_result_one_time_filter", "SELECT n_nationkey FROM {nation} WHERE 1 = 2")
P.same("scan_cte_shared", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey) SELECT a.o_custkey, round(a.t, 2) AS t FROM big a WHERE a.t > (SELECT avg(t) * 2 FROM big)")


@P.add("scan_minmax", "SELECT min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def scan_minmax(t):
    return t.lineitem.agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@P.add("scan_knn", "SELECT p_partkey, round(abs(p_retailprice - 1000), 2) AS distance FROM part ORDER BY abs(p_retailprice - 1000), p_partkey LIMIT 10")
def scan_knn(t):
    far = F.abs(F.col("p_retailprice") - 1000)
    return t.part.orderBy(far, "p_partkey").limit(10).select("p_partkey", F.round(far, 2).alias("distance"))


@P.add("sample_bernoulli")
def sample_bernoulli(t):
    return R.bernoulli_sample(t.orders, ["o_orderkey"], 10, 42).select("o_orderkey")


@P.add("sample_system")
def sample_system(t):
    return R.system_sample(t.lineitem, 50, 7, 1000).select("l_orderkey", "l_linenumber")


@P.add("sample_system_rows", "SELECT CAST(25 AS BIGINT) AS n")
def sample_system_rows(t):
    return R.sample_rows(t.customer, ["c_custkey"], 25, 3).agg(F.count(F.lit(1)).alias("n"))


@P.add("srf_generate_series", "SELECT n FROM generate_series(1, 20, 3) AS g(n)")
def srf_generate_series(t):
    return R.generate_series(t.spark, 1, 20, 3)


@P.add("srf_lockstep", "SELECT n_nationkey, unnest(generate_series(1, 2)) AS a, unnest(generate_series(1, 4)) AS b FROM nation")
def srf_lockstep(t):
    return R.lockstep(t.nation.select("n_nationkey"), a=F.expr("sequence(1L, 2L)"), b=F.expr("sequence(1L, 4L)"))


@P.add("srf_rows_from_ordinality", "SELECT r_regionkey, part, row_number() OVER (PARTITION BY r_regionkey ORDER BY i) AS ord FROM (SELECT r_regionkey, unnest(string_split(r_name, 'A')) AS part, generate_subscripts(string_split(r_name, 'A'), 1) AS i FROM region)")
def srf_rows_from(t):
    return R.rows_from(t.region.select("r_regionkey", F.split("r_name", "A").alias("p")), "ord", part=F.col("p")).select("r_regionkey", "part", "ord")


# Predicates -------------------------------------------------------------------------
P.same("pred_case", "SELECT p_size, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, count(*) AS n FROM {part} GROUP BY 1, 2")
P.same("pred_coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS s, greatest(o_custkey, 100) AS g, least(o_custkey, NULL, 50) AS l FROM {orders}")
P.same("pred_in_list", "SELECT count(*) AS n FROM {part} WHERE p_type IN ('PROMO', 'SMALL') AND p_size NOT IN (1, 2, 3)")
P.same("pred_null_tests", "SELECT x, x IS NULL AS a, x IS TRUE AS b, x IS NOT FALSE AS c, x IS NOT DISTINCT FROM NULL AS d FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS v(x)",
       "SELECT x, x IS NULL AS a, x IS NOT DISTINCT FROM true AS b, x IS DISTINCT FROM false AS c, x IS NOT DISTINCT FROM NULL AS d FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS v(x)")
P.same("pred_three_valued", "SELECT a, b, a AND b AS conj, a OR b AS disj, NOT a AS neg FROM (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS x(a) CROSS JOIN (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS y(b)")
P.same("pred_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 's%' AND p_name NOT LIKE '%nut' AND p_name ILIKE '%RING%'")
P.same("pred_regex", "SELECT p_partkey, p_name FROM {part} WHERE regexp_like(p_name, '^(red|blue) [a-n]')", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) [a-n]')")
P.same("pred_row_compare", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE struct(l_quantity, l_linenumber) < struct(25.0D, 3)", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_quantity, l_linenumber) < (25.0, 3)")
P.same("pred_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
P.same("pred_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
P.same("pred_not_in_null_aware", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT nullif(c_nationkey, 3) FROM {customer})")
P.same("pred_in_subquery", "SELECT count(*) AS n FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size = 7)")
P.same("pred_scalar_subquery_correlated", "SELECT o_orderkey, (SELECT count(*) FROM {lineitem} WHERE l_orderkey = o_orderkey) AS n FROM {orders}")
P.same("pred_quantified_all", "SELECT p_partkey FROM {part} WHERE p_retailprice >= (SELECT max(p_retailprice) FROM {part})", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part)")
P.same("pred_between_symmetric", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN least(20, 15) AND greatest(20, 15)", "SELECT p_partkey FROM part WHERE p_size BETWEEN 15 AND 20")
P.same("pred_collate", "SELECT r_name FROM {region} WHERE r_name COLLATE UTF8_LCASE = 'asia'", "SELECT r_name FROM region WHERE r_name COLLATE NOCASE = 'asia'")
P.same("cast_rounding", "SELECT x, CAST(rint(x) AS INT) AS half_even, CAST(round(CAST(x AS DECIMAL(10, 2))) AS INT) AS half_away FROM (VALUES (-2.5D), (-1.5D), (-0.5D), (0.5D), (1.5D), (2.5D)) AS v(x)",
       "SELECT x, CAST(round_even(x, 0) AS INT) AS half_even, CAST(round(CAST(x AS DECIMAL(10, 2))) AS INT) AS half_away FROM (VALUES (-2.5::DOUBLE), (-1.5), (-0.5), (0.5), (1.5), (2.5)) AS v(x)")

# Joins ------------------------------------------------------------------------------
P.same("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_acctbal > 9000")
P.same("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000")
P.same("join_right", "SELECT c_custkey, n_name FROM {customer} RIGHT JOIN {nation} ON c_nationkey = n_nationkey AND c_acctbal > 9900")
P.same("join_full", "SELECT a.p_size AS a, b.p_size AS b FROM (SELECT DISTINCT p_size FROM {part} WHERE p_size < 30) a FULL JOIN (SELECT DISTINCT p_size FROM {part} WHERE p_size > 20) b ON a.p_size = b.p_size")
P.same("join_semi", "SELECT s_suppkey FROM {supplier} LEFT SEMI JOIN {customer} ON s_nationkey = c_nationkey AND c_acctbal > 9950", "SELECT s_suppkey FROM supplier SEMI JOIN customer ON s_nationkey = c_nationkey AND c_acctbal > 9950")
P.same("join_anti", "SELECT p_partkey FROM {part} LEFT ANTI JOIN {lineitem} ON p_partkey = l_partkey AND l_quantity > 40", "SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 40")
P.same("join_cross", "SELECT r1.r_name AS a, r2.r_name AS b FROM {region} r1 CROSS JOIN {region} r2")
P.same("join_using", "SELECT k, count(*) AS n FROM (SELECT l_partkey AS k, l_suppkey FROM {lineitem}) a JOIN (SELECT p_partkey AS k, p_size FROM {part} WHERE p_size < 5) b USING (k) GROUP BY k")
P.same("join_natural", "SELECT count(*) AS n FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM {supplier}) b")
P.same("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
P.same("join_or_of_ands", "SELECT count(*) AS n FROM {lineitem} JOIN {part} ON (l_partkey = p_partkey AND p_size < 5 AND l_quantity < 10) OR (l_partkey = p_partkey AND p_size > 45 AND l_quantity > 40)")
P.same("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
P.same("join_aggregated", "SELECT p_partkey, n FROM {part} JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) a ON p_partkey = l_partkey WHERE n > 40")
P.same(
    "join_lateral",
    "SELECT c_custkey, o.o_orderkey FROM {customer}, LATERAL (SELECT o_orderkey FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 2) o",
    "SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o",
)


@P.add("join_asof", """
SELECT e.event_id, e.user_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(t):
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return R.asof_join(clicks, bought, "ts", ["user_id"]).select("event_id", "user_id", "last_purchase")


@P.add("join_band", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - 5 AND s_acctbal + 5")
def join_band(t):
    s = t.supplier.select("s_suppkey", (F.col("s_acctbal") - 5).alias("lo"), (F.col("s_acctbal") + 5).alias("hi"))
    return R.interval_join(t.customer.select("c_custkey", "c_acctbal"), s, "c_acctbal", "lo", "hi", 10.0).select("c_custkey", "s_suppkey")


@P.add("join_range_overlap", """
WITH r AS (SELECT p_partkey AS id, p_retailprice AS lo, p_retailprice + p_size / 20.0 AS hi FROM part)
SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.lo < b.hi AND b.lo < a.hi AND a.id < b.id""")
def join_range_overlap(t):
    r = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size") / 20.0).alias("hi"))
    return R.overlap_pairs(r, "id", "lo", "hi", 2.0)


# Changes to rows ---------------------------------------------------------------------
@P.add("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(t):
    return R.update_rows(t.customer.select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, c_acctbal=F.lit(0.0))


@P.add("dml_delete_returning", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
def dml_delete(t):
    return R.delete_rows(t.supplier.select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0)[1]


@P.add("dml_upsert", """
SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey + 20 FROM nation) UNION ALL SELECT n_nationkey + 20, 'new ' || n_name FROM nation""")
def dml_upsert(t):
    nation = t.nation.select("n_nationkey", "n_name")
    new = nation.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.concat(F.lit("new "), "n_name").alias("n_name"))
    return R.upsert(nation, new, ["n_nationkey"])


@P.add("dml_insert_do_nothing", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 20, 'new ' || n_name FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def dml_do_nothing(t):
    nation = t.nation.select("n_nationkey", "n_name")
    new = nation.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.concat(F.lit("new "), "n_name").alias("n_name"))
    return R.upsert(nation, new, ["n_nationkey"], update=False)


# Aggregation -------------------------------------------------------------------------
P.same("agg_plain_empty", "SELECT count(*) AS n, sum(l_quantity) AS s FROM {lineitem} WHERE l_quantity < 0")
P.same("agg_group_only", "SELECT l_returnflag, l_linestatus FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
P.same("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber) AS l FROM {lineitem} GROUP BY l_returnflag",
       "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS l FROM lineitem GROUP BY l_returnflag")
P.same("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(value) FILTER (WHERE user_id % 2 = 0), 2) AS even FROM {events} GROUP BY event_type")
P.same("agg_ordered_set", "SELECT p_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS pd, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice), 4) AS pc FROM {part} GROUP BY p_type",
       "SELECT p_type, CAST(quantile_disc(p_size, 0.5) AS DOUBLE) AS pd, round(quantile_cont(p_retailprice, 0.25), 4) AS pc FROM part GROUP BY p_type")
P.same("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
       "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS TINYINT) AS g1, CAST(grouping(l_linestatus) AS TINYINT) AS g2 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
P.same("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS g FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
       "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
P.same("agg_having_no_group", "SELECT count(*) AS n FROM {nation} HAVING count(*) > 1000")
P.same("agg_bool", "SELECT p_brand, bool_and(p_size > 1) AS a, bool_or(p_size = 50) AS o, every(p_retailprice > 0) AS e FROM {part} GROUP BY p_brand", "SELECT p_brand, bool_and(p_size > 1) AS a, bool_or(p_size = 50) AS o, bool_and(p_retailprice > 0) AS e FROM part GROUP BY p_brand")
P.same("agg_bit", "SELECT p_type, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM {part} GROUP BY p_type")
P.same("agg_statistics", "SELECT p_type, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 2) AS vp, round(corr(p_size, p_retailprice), 6) AS r, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(covar_pop(p_size, p_retailprice), 4) AS cp, regr_count(p_size, p_retailprice) AS rc FROM {part} GROUP BY p_type",
       "SELECT p_type, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 2) AS vp, round(corr(p_size, p_retailprice), 6) AS r, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(covar_pop(p_size, p_retailprice), 4) AS cp, CAST(regr_count(p_size, p_retailprice) AS BIGINT) AS rc FROM part GROUP BY p_type")
P.same("agg_nested_in_window", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s, round(sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 2) AS per_flag FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
P.same("agg_partitionwise", "SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS m FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")


@P.add("agg_ordered_array", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name DESC), ',') AS names, string_agg(n_name, '|' ORDER BY n_nationkey) AS s FROM nation GROUP BY n_regionkey")
def agg_ordered(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(A.ordered_array("n_name", "n_name", descending=True), ",").alias("names"), A.ordered_string("n_name", "|", "n_nationkey").alias("s"))


@P.add("agg_hypothetical", """
SELECT p_type, count(*) FILTER (WHERE p_size < 25) + 1 AS rank, count(DISTINCT p_size) FILTER (WHERE p_size < 25) + 1 AS dense_rank,
  round(count(*) FILTER (WHERE p_size < 25) / count(*), 6) AS percent_rank, round((count(*) FILTER (WHERE p_size <= 25) + 1) / (count(*) + 1), 6) AS cume_dist FROM part GROUP BY p_type""")
def agg_hypothetical(t):
    x, g = F.col("p_size"), F.lit(25)
    return t.part.groupBy("p_type").agg(A.hypothetical_rank(x, g).alias("rank"), A.hypothetical_dense_rank(x, g).alias("dense_rank"), F.round(A.hypothetical_percent_rank(x, g), 6).alias("percent_rank"), F.round(A.hypothetical_cume_dist(x, g), 6).alias("cume_dist"))


@P.add("agg_grouping_sets", "SELECT p_brand, p_type, grouping(p_brand, p_type) AS grouping_id, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def agg_grouping_sets(t):
    return A.grouping_sets(t.part, [["p_brand"], ["p_type"], []], [F.count(F.lit(1)).alias("n")])


@P.add("agg_grouping_sets_empty", "SELECT p_brand, grouping(p_brand) AS grouping_id, count(*) AS n FROM part WHERE p_size < 0 GROUP BY GROUPING SETS ((p_brand), ())")
def agg_grouping_sets_empty(t):
    return A.grouping_sets(t.part.where("p_size < 0"), [["p_brand"], []], [F.count(F.lit(1)).alias("n")])


@P.add("agg_mode", "SELECT o_orderpriority, mode FROM (SELECT o_orderpriority, o_custkey % 7 AS mode, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey % 7) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def agg_mode(t):
    return t.orders.withColumn("m", F.col("o_custkey") % 7).groupBy("o_orderpriority").agg(A.first_value_of_mode("m").alias("mode"))


@P.add("agg_enum_max", "SELECT c_mktsegment, arg_max(o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 0 END) AS m FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority IN ('5-LOW', '1-URGENT') GROUP BY c_mktsegment")
def agg_enum_max(t):
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).where(F.col("o_orderpriority").isin("5-LOW", "1-URGENT"))
    return rows.groupBy("c_mktsegment").agg(A.max_enum("o_orderpriority", ["5-LOW", "1-URGENT"]).alias("m"))


@P.add("agg_approx_distinct")
def agg_approx(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll"))


# Windows -----------------------------------------------------------------------------
P.same("window_ranking", """SELECT p_partkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, ntile(4) OVER w AS nt
FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)""",
       """SELECT p_partkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER v AS INT) AS rk, CAST(dense_rank() OVER v AS INT) AS dr, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd, CAST(ntile(4) OVER w AS INT) AS nt
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)""")
P.same("window_offset", "SELECT event_id, lag(value, 1) OVER w AS prev, lead(value, 2, -1.0D) OVER w AS nxt, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
       "SELECT event_id, lag(value, 1) OVER w AS prev, lead(value, 2, -1.0) OVER w AS nxt, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
P.same("window_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s FROM {events}")
P.same("window_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM {part}")
P.same("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events}")
P.same("window_whole", "SELECT n_nationkey, count(*) OVER () AS n FROM {nation}")


@P.add("window_groups_frame", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_type ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS s FROM part")
def window_groups(t):
    return V.groups_frame(t.part, F.sum("p_size"), ["p_type"], [F.col("p_size")], -1, 1, "s").select("p_partkey", "s")


def _exclusion(name: str, word: str):
    sql = f"SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {word})::BIGINT AS s FROM part"

    @P.add(f"window_exclude_{name}", sql)
    def query(t):
        frame = lambda w: w.rangeBetween(W.unboundedPreceding, W.currentRow)
        return V.excluding(t.part, "p_size", ["p_brand"], [F.col("p_size")], frame, word.lower(), "s").select("p_partkey", "s")


for _name, _word in (("current_row", "CURRENT ROW"), ("group", "GROUP"), ("ties", "TIES")):
    _exclusion(_name, _word)


@P.add("window_count_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS n FROM events")
def window_count_distinct(t):
    return t.events.select("event_id", V.count_distinct_over("event_type", "user_id").alias("n"))


@P.add("window_filter", "SELECT event_id, sum(value) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) IS NULL AS none, count(value) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM events")
def window_filter(t):
    w = W.partitionBy("user_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return t.events.select("event_id", V.filtered(F.sum, F.col("event_type") == "click", F.col("value"), w).isNull().alias("none"), V.filtered(F.count, F.col("event_type") == "click", F.col("value"), w).alias("n"))


# Sorting, limits, distinct -------------------------------------------------------------
P.same("sort_top_n", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
P.same("sort_limit_offset", "SELECT c_custkey FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 30")
P.same("sort_nulls", "SELECT x, row_number() OVER (ORDER BY x ASC NULLS LAST) AS up, row_number() OVER (ORDER BY x DESC NULLS FIRST) AS down FROM (VALUES (3), (NULL), (1), (2)) AS v(x)",
       "SELECT x, CAST(row_number() OVER (ORDER BY x ASC NULLS LAST) AS INT) AS up, CAST(row_number() OVER (ORDER BY x DESC NULLS FIRST) AS INT) AS down FROM (VALUES (3), (NULL), (1), (2)) AS v(x)")
P.same("distinct_rows", "SELECT DISTINCT p_type, p_brand FROM {part}")


@P.add("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    return R.distinct_on(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@P.add("fetch_with_ties", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def fetch_with_ties(t):
    return R.with_ties(t.part.select("p_partkey", "p_size"), ["p_size"], 10, ascending=False)


# Set operations ------------------------------------------------------------------------
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    P.same(f"set_{_name}", f"SELECT c_nationkey AS k FROM {{customer}} WHERE c_acctbal > 5000 {_op} SELECT s_nationkey FROM {{supplier}}")
P.same("set_nulls_equal", "SELECT * FROM (VALUES (1), (1), (2), (NULL), (NULL)) AS a(x) INTERSECT ALL SELECT * FROM (VALUES (1), (2), (2), (NULL)) AS b(x)")
P.same("set_mixed_types", "SELECT CAST(n_nationkey AS DOUBLE) AS x FROM {nation} UNION SELECT s_acctbal FROM {supplier}")

# Recursion ------------------------------------------------------------------------------
P.same("recursive_union_all", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT sum(n) AS s, count(*) AS c FROM t",
       "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT CAST(sum(n) AS BIGINT) AS s, count(*) AS c FROM t")


@P.add("recursive_union_distinct", """
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, (c_nationkey * 7 + 3) % 25 AS b FROM customer), t(n) AS (SELECT 0 UNION SELECT e.b FROM t JOIN e ON e.a = t.n) SELECT n FROM t""")
def recursive_union_distinct(t):
    edges = t.customer.select(F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") * 7 + 3) % 25).alias("b")).distinct()
    seed = t.spark.range(1).select(F.lit(0).alias("n"))
    return recursion.recursive_union(seed, lambda w: w.join(edges, w["n"] == edges["a"]).select(F.col("b").alias("n")))


@P.add("recursive_connectby", """
WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, CAST(n_nationkey // 3 AS VARCHAR) AS p FROM nation WHERE n_nationkey > 0),
t AS (SELECT '1' AS id, CAST(NULL AS VARCHAR) AS parent, 0 AS level, '1' AS branch UNION ALL SELECT k, p, level + 1, branch || '~' || k FROM t JOIN e ON p = id)
SELECT * FROM t""")
def recursive_connectby(t):
    tree = t.nation.where("n_nationkey > 0").select(F.col("n_nationkey").alias("id"), F.expr("n_nationkey div 3").alias("parent"))
    return recursion.connectby(tree, "id", "parent", 1)


@P.add("crosstab_by_position", """
SELECT n_regionkey, max(CASE WHEN r = 1 THEN n_name END) AS first, max(CASE WHEN r = 2 THEN n_name END) AS second
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) GROUP BY n_regionkey""")
def crosstab(t):
    return R.crosstab(t.nation, "n_regionkey", "n_nationkey", "n_name", ["first", "second"])


@P.add("crosstab_by_category", "SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'click'), 2) AS click, round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS view FROM events GROUP BY user_id")
def crosstab_category(t):
    rows = t.events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("v"))
    return R.crosstab_by(rows, "user_id", "event_type", "v", ["click", "view"])


QUERIES, ORACLE_SQL = P.queries, P.oracle

"""The decision-support family of 22 queries, fitted to the columns that the tables have.

There is no part-supplier table; where one is needed it is derived from the line items:
supply cost is the average unit price, available quantity the quantity sold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.pairs import Pairs

P = Pairs()


@P.add("tpch_q01", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-03' GROUP BY l_returnflag, l_linestatus""")
def q01(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("2001-08-03").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, round(avg(l_extendedprice / l_quantity), 6) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM {lineitem} GROUP BY l_partkey, l_suppkey)"

P.same("tpch_q02", f"""
WITH ps AS {PARTSUPP}, priced AS (
  SELECT s_acctbal, s_name, n_name, p_partkey, ps_supplycost, min(ps_supplycost) OVER (PARTITION BY p_partkey) AS least
  FROM ps JOIN {{part}} ON p_partkey = ps_partkey JOIN {{supplier}} ON s_suppkey = ps_suppkey
    JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('STANDARD', 'PROMO') AND r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey FROM priced WHERE ps_supplycost = least ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
P.same("tpch_q03", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
P.same("tpch_q04", """
SELECT o_orderpriority, count(*) AS order_count FROM {orders}
WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
  AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority""")
P.same("tpch_q05", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
  JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' + INTERVAL '1' YEAR
GROUP BY n_name""")
P.same("tpch_q06", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""")
P.same("tpch_q07", """
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {supplier} JOIN {lineitem} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
  JOIN {nation} n1 ON s_nationkey = n1.n_nationkey JOIN {nation} n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3'))
  AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'
GROUP BY n1.n_name, n2.n_name, CAST(year(l_shipdate) AS INT)""")
P.same("tpch_q08", """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_8' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM {part} JOIN {lineitem} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON l_orderkey = o_orderkey
    JOIN {customer} ON o_custkey = c_custkey JOIN {nation} n1 ON c_nationkey = n1.n_nationkey JOIN {region} ON n1.n_regionkey = r_regionkey
    JOIN {nation} n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') AS all_nations GROUP BY o_year""")
P.same("tpch_q09", f"""
WITH ps AS {PARTSUPP}
SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 1) AS sum_profit
FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey
  JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{nation}} ON s_nationkey = n_nationkey
WHERE p_name LIKE '%e%' GROUP BY n_name, CAST(year(o_orderdate) AS INT)""")
P.same("tpch_q10", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
P.same("tpch_q11", f"""
WITH ps AS {PARTSUPP}, v AS (
  SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS value FROM ps JOIN {{supplier}} ON ps_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey
  WHERE n_name IN ('NATION_7', 'NATION_3') GROUP BY ps_partkey)
SELECT ps_partkey, round(value, 1) AS value FROM v WHERE value > (SELECT sum(value) * 0.002 FROM v)""")
P.same("tpch_q12", """
SELECT l_returnflag, sum(CASE WHEN o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' THEN 1 ELSE 0 END) AS high_line_count,
  sum(CASE WHEN o_orderpriority NOT LIKE '1-%' AND o_orderpriority NOT LIKE '2-%' THEN 1 ELSE 0 END) AS low_line_count
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
GROUP BY l_returnflag""")
P.oracle["tpch_q12"] = P.oracle["tpch_q12"].replace("sum(CASE", "CAST(sum(CASE").replace("END) AS", "END) AS BIGINT) AS")
P.same("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT' GROUP BY c_custkey) AS c_orders
GROUP BY c_count""")
P.same("tpch_q14", """
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01' AND l_shipdate < TIMESTAMP '1997-10-01'""")
P.same("tpch_q15", """
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM {lineitem}
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {supplier} JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""")
P.same("tpch_q16", f"""
WITH ps AS {PARTSUPP}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN {{part}} ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MED%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""")
P.same("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
  JOIN (SELECT l_partkey AS k, 0.4 * avg(l_quantity) AS few FROM {lineitem} GROUP BY l_partkey) AS a ON k = p_partkey
WHERE p_brand = 'Brand#2' AND l_quantity < few""")
P.same("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
P.same("tpch_q19", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {part} ON
  (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
  OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
  OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""")
P.same("tpch_q20", f"""
WITH ps AS {PARTSUPP}
SELECT s_name, s_suppkey FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_4', 'NATION_5') AND s_suppkey IN (
  SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_type = 'SMALL')
    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM {{lineitem}} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate < TIMESTAMP '1999-01-01'))""")
P.same("tpch_q21", """
SELECT s_name, count(*) AS numwait FROM {supplier} JOIN {lineitem} l1 ON s_suppkey = l1.l_suppkey JOIN {orders} ON o_orderkey = l1.l_orderkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3')
  AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate)
GROUP BY s_name""")
P.same("tpch_q22", """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM {customer}
WHERE c_nationkey IN (13, 21, 23, 4, 5, 18, 17) AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00 AND c_nationkey IN (13, 21, 23, 4, 5, 18, 17))
  AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '2000-06-01')
GROUP BY c_nationkey""")

QUERIES, ORACLE_SQL = P.queries, P.oracle

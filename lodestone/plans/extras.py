"""Prepared statements, sequences, JSON aggregates, maps, nearest texts, exclusion checks and more."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import arrays as AR
from lodestone.functions import documents as D
from lodestone.functions import search as TS
from lodestone.functions import space as SP
from lodestone.functions import strings as S
from lodestone.functions import temporal as T
from lodestone.operators import aggregates as A
from lodestone.plans.pairs import Pairs

P = Pairs()


@P.add("prepare_execute", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def prepare_execute(t):
    return t.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :customer AND o_totalprice > :least", customer=7, least=1000)


@P.add("sequence_nextval", "SELECT r_name, 100 + 10 * (row_number() OVER (ORDER BY r_regionkey) - 1) AS id FROM region")
def sequence_nextval(t):
    return t.region.select("r_name", (F.lit(90).cast("long") + 10 * F.row_number().over(W.orderBy("r_regionkey"))).alias("id"))


@P.add("json_agg", "SELECT n_regionkey, CAST(to_json(array_agg(n_name ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
def json_agg(t):
    return t.nation.groupBy("n_regionkey").agg(F.to_json(A.ordered_array("n_name", "n_nationkey")).alias("j"))


@P.add("json_set_and_keys", "SELECT event_id, array_to_string(list_sort(json_keys(json_merge_patch(props::JSON, '{\"z\": 1}'))), ',') AS keys FROM events")
def json_set_and_keys(t):
    return t.events.select("event_id", F.array_join(F.array_sort(F.json_object_keys(D.json_set(F.col("props"), "z", F.lit("1")))), ",").alias("keys"))


@P.add("json_records", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS k2 FROM events")
def json_records(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").alias("r")).select("event_id", (F.col("r.k") * 2).alias("k2"))


@P.add("hstore_access", "SELECT c_custkey, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nation, true AS has FROM customer")
def hstore_access(t):
    m = AR.hstore(F.format_string("seg=>%s, nation=>%d, none=>NULL", F.col("c_mktsegment"), F.col("c_nationkey")))
    return t.customer.select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")["seg"].alias("seg"), F.col("m")["nation"].alias("nation"), F.map_contains_key("m", "none").alias("has"))


@P.add("trigram_nearest", """
WITH g AS (SELECT DISTINCT p_name, list_distinct(flatten(list_transform(string_split(lower(p_name), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', CAST(i AS INT), 3))))) AS x FROM part),
q AS (SELECT list_distinct(flatten(list_transform(string_split('red rings', ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', CAST(i AS INT), 3))))) AS y)
SELECT p_name FROM g, q ORDER BY len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) DESC, p_name LIMIT 1""")
def trigram_nearest(t):
    names = t.part.select("p_name").distinct()
    return names.orderBy(F.desc(S.similarity(F.col("p_name"), F.lit("red rings"))), "p_name").limit(1)


@P.add("text_overlay_initcap", "SELECT p_partkey, substring(p_name, 1, 1) || 'XX' || substring(p_name, 4) AS o, upper(substring(p_name, 1, 1)) || substring(split_part(p_name, ' ', 1), 2) || ' ' || upper(substring(split_part(p_name, ' ', 2), 1, 1)) || substring(split_part(p_name, ' ', 2), 2) AS i, lower(to_hex(p_size)) AS h FROM part")
def text_overlay(t):
    x = F.col("p_name")
    return t.part.select("p_partkey", F.overlay(x, F.lit("XX"), F.lit(2)).alias("o"), S.initcap(x).alias("i"), S.to_hex(F.col("p_size")).alias("h"))


@P.add("interval_justify", "SELECT p_partkey, CAST(p_size // 30 AS INT) AS months, CAST(p_size % 30 AS INT) AS days FROM part")
def interval_justify(t):
    j = T.justify_days(T.interval(days=F.col("p_size")))
    return t.part.select("p_partkey", j["months"].alias("months"), j["days"].alias("days"))


@P.add("make_dates", "SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), 1) AS first FROM orders")
def make_dates(t):
    return t.orders.select("o_orderkey", F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)).alias("first"))


@P.add("range_exclusion_violations", """
SELECT event_id FROM (SELECT event_id, ts, max(ts + INTERVAL '2 hours') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM events) WHERE busy > ts""")
def range_exclusion(t):
    """An exclusion constraint on [ts, ts + 2 h) for each user: the rows that overlap an earlier one."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    busy = F.max(F.col("ts") + F.expr("INTERVAL '2' HOUR")).over(w)
    return t.events.withColumn("busy", busy).where(F.col("busy") > F.col("ts")).select("event_id")


@P.add("fts_rank_headline")
def fts_rank(t):
    docs = t.documents.select("doc_id", "text", TS.to_tsvector(F.col("text"), only=("ring", "from")).alias("v"))
    return docs.select("doc_id", F.round(TS.rank(F.col("v"), "ring", "from"), 6).alias("rank"), TS.headline(F.col("text"), "from").alias("headline"))


@P.add("xml_table")
def xml_table(t):
    rows = t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("<r>"), F.array_join(A.ordered_array("n_name", "n_nationkey"), ""), F.lit("</r>")).alias("plain"))
    made = rows.select("n_regionkey", F.regexp_replace("plain", r"(NATION_\d+)", "<n><name>$1</name></n>").alias("x"))
    return D.xml_table(made, "x", "/r/n", {"name": ("name", "string")}, "place").select("n_regionkey", "place", "name")


P.oracle["xml_table"] = "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS place, n_name AS name FROM nation"


@P.add("isn_check_digits", """
SELECT p_partkey, list_sum(list_transform(generate_series(1, 13), lambda i: CAST(substring(s, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS good
FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 12, '9') || p_size % 10 AS s FROM part)""")
def isn(t):
    """Numbers of thirteen digits whose last one is any: about one in ten is right."""
    text = F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, "9"), (F.col("p_size") % 10).cast("string"))
    return t.part.select("p_partkey", SP.check_digit_ean13(text).alias("good"))


@P.add("array_quantifiers", "SELECT vec_id, list_max(embedding) > 0.3 AS some, list_min(embedding) > -0.9 AS every FROM embeddings")
def quantifiers(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", AR.any_of(F.lit(0.3), e, lambda x, v: v > x).alias("some"), AR.all_of(F.lit(-0.9), e, lambda x, v: v > x).alias("every"))


@P.add("digest_of_group", "SELECT n_regionkey, md5(string_agg(n_name, ',' ORDER BY n_name)) AS d FROM nation GROUP BY n_regionkey")
def digest(t):
    return t.nation.groupBy("n_regionkey").agg(F.md5(A.ordered_string("n_name", ",", "n_name")).alias("d"))


QUERIES, ORACLE_SQL = P.queries, P.oracle

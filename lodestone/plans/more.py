"""Time zones, identifiers, digests, JSON and XML building, segments, tokens, routines, files and views."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import documents as D
from lodestone.functions import numbers as N
from lodestone.functions import ranges as RG
from lodestone.functions import search as TS
from lodestone.functions import strings as S
from lodestone.functions import temporal as T
from lodestone.functions import user
from lodestone.operators import aggregates as A
from lodestone.operators import relational as R
from lodestone.plans.pairs import Pairs
from lodestone.sources import files
from lodestone.sources.scratch import new_folder

P = Pairs()

# Subqueries, grouping, order -----------------------------------------------------------
P.same("pred_array_subquery", "SELECT r_regionkey, array_join(transform(array_sort(a), x -> CAST(x AS STRING)), ',') AS nations FROM (SELECT r_regionkey, (SELECT collect_list(n_nationkey) FROM {nation} WHERE n_regionkey = r_regionkey) AS a FROM {region})",
       "SELECT r_regionkey, array_to_string(ARRAY(SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey), ',') AS nations FROM region")
P.same("sort_expression_positional", "SELECT c_custkey, floor(c_acctbal / 1000) AS thousands FROM {customer} ORDER BY 2 DESC, c_custkey % 7, 1 LIMIT 40",
       "SELECT c_custkey, CAST(floor(c_acctbal / 1000) AS BIGINT) AS thousands FROM customer ORDER BY 2 DESC, c_custkey % 7, 1 LIMIT 40")


@P.add("agg_functional_dependency", "SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_mktsegment) AS c_mktsegment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def functional_dependency(t):
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return A.by_key(rows, ["c_custkey"], ["c_name", "c_mktsegment"], F.count("o_orderkey").alias("orders"))


@P.add("join_interval_full", """
SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0) c
FULL JOIN (SELECT s_suppkey, s_acctbal - 40 AS lo, s_acctbal + 40 AS hi FROM supplier) s ON c_acctbal BETWEEN lo AND hi""")
def interval_full(t):
    s = t.supplier.select("s_suppkey", (F.col("s_acctbal") - 40).alias("lo"), (F.col("s_acctbal") + 40).alias("hi"))
    c = t.customer.where("c_custkey % 3 = 0").select("c_custkey", "c_acctbal")
    return R.interval_join(c, s, "c_acctbal", "lo", "hi", 20.0, "full").select("c_custkey", "s_suppkey")


# Time ----------------------------------------------------------------------------------
P.same("time_current", "SELECT event_id, ts < current_timestamp() AS past, CAST(ts AS DATE) < current_date() AS earlier, ts < localtimestamp() AS local FROM {events}",
       "SELECT event_id, ts < CAST(now() AS TIMESTAMP) AS past, CAST(ts AS DATE) < current_date AS earlier, ts < localtimestamp AS local FROM events")


@P.add("time_zones", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS there, CAST((ts AT TIME ZONE 'Asia/Kolkata') AT TIME ZONE 'UTC' AS TIMESTAMP) AS instant FROM events")
def time_zones(t):
    return t.events.select("event_id", T.at_time_zone(F.col("ts"), "America/New_York").alias("there"), T.from_time_zone(F.col("ts"), "Asia/Kolkata").alias("instant"))


@P.add("fn_isfinite", "SELECT event_id, isfinite(CASE event_id % 4 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN value END) AS finite FROM events")
def fn_isfinite(t):
    x = F.when(F.col("event_id") % 4 == 0, float("inf")).when(F.col("event_id") % 4 == 1, float("nan")).when(F.col("event_id") % 4 == 2, F.col("value"))
    return t.events.select("event_id", N.isfinite(x).alias("finite"))


@P.add("fn_normal_rand")
def fn_normal_rand(t):
    return N.normal_rand(t.spark, 1000, 5.0, 2.0, 7)


# Text, digests, identifiers ------------------------------------------------------------
_SPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
_V = "substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-{v}' || substr(d, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(d, 17, 1)) AS INT) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12)"


@P.add("fn_uuid", f"""
SELECT n_nationkey, a.u AS v3, b.u AS v5 FROM (SELECT n_nationkey, {_V.format(v=3)} AS u FROM (SELECT n_nationkey, md5(unhex('{_SPACE.replace('-', '')}') || encode(n_name)) AS d FROM nation)) a
JOIN (SELECT n_nationkey, {_V.format(v=5)} AS u FROM (SELECT n_nationkey, sha1(unhex('{_SPACE.replace('-', '')}') || encode(n_name)) AS d FROM nation)) b USING (n_nationkey)""")
def fn_uuid(t):
    return t.nation.select("n_nationkey", S.uuid_v3(_SPACE, F.col("n_name")).alias("v3"), S.uuid_v5(_SPACE, F.col("n_name")).alias("v5"))


@P.add("fn_hmac", f"""
SELECT c_custkey, sha256(unhex('{bytes(c ^ 0x5C for c in b"key".ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(c ^ 0x36 for c in b"key".ljust(64, bytes(1))).hex()}') || encode(c_name)))) AS mac, sha1(c_name) AS sha1 FROM customer""")
def fn_hmac(t):
    return t.customer.select("c_custkey", S.hmac(F.col("c_name"), b"key").alias("mac"), F.sha1(F.col("c_name").cast("binary")).alias("sha1"))


@P.add("fn_normalize", "SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS nfc FROM documents")
def fn_normalize(t):
    return t.documents.select("doc_id", F.md5(user.normalised(F.replace("text", F.lit("é"), F.lit("é")))).alias("nfc"))


_GRAMS = "flatten(list_transform(string_split({x}, ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', CAST(i AS INT), 3))))"


@P.add("fn_word_similarity", f"""
WITH q AS (SELECT list_distinct({_GRAMS.format(x="'wid'")}) AS x), p AS (SELECT p_partkey, {_GRAMS.format(x='lower(p_name)')} AS y FROM part),
s AS (SELECT p_partkey, x, list_distinct(list_slice(y, i, j)) AS z FROM p, q, generate_series(1, 40) AS a(i), generate_series(1, 40) AS b(j) WHERE i <= j AND j <= len(y))
SELECT p_partkey, round(max(len(list_intersect(x, z)) / (len(x) + len(z) - len(list_intersect(x, z)))), 6) AS s FROM s GROUP BY p_partkey""")
def fn_word_similarity(t):
    return t.part.select("p_partkey", F.round(S.word_similarity(F.lit("wid"), F.col("p_name")), 6).alias("s"))


@P.add("fn_quote_ident", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[a-z_][a-z0-9_$]*$') THEN p_name ELSE '\"' || p_name || '\"' END AS q, '''' || p_type || '''' AS l, lower(p_brand) || '.' || p_name AS parts FROM part")
def fn_quote_ident(t):
    parts = S.parse_ident(F.concat(F.col("p_brand"), F.lit('."'), F.col("p_name"), F.lit('"')))
    return t.part.select("p_partkey", S.quote_ident(F.col("p_name")).alias("q"), S.quote_literal(F.col("p_type")).alias("l"), F.array_join(parts, ".").alias("parts"))


@P.add("fn_bytes", "SELECT p_partkey, ascii(substring(p_brand, 2, 1)) AS b, 'X' || substring(p_brand, 2) AS s, (ascii(substring(p_brand, 1, 1)) >> 3) & 1 AS bit FROM part")
def fn_bytes(t):
    data = F.col("p_brand").cast("binary")
    return t.part.select("p_partkey", S.get_byte(data, 1).alias("b"), S.set_byte(data, 0, 0x58).cast("string").alias("s"), S.get_bit(data, 3).alias("bit"))


# JSON and XML --------------------------------------------------------------------------
@P.add("json_object_agg", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def json_object_agg(t):
    return t.nation.groupBy("n_regionkey").agg(D.object_agg("n_name", "n_nationkey").alias("j"))


@P.add("json_equal", "SELECT event_id, '{\"a\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS c, CAST(json_extract(props, '$.k') AS INT) = 5 AS five FROM events")
def json_equal(t):
    k = F.get_json_object("props", "$.k")
    loose = F.concat(F.lit('{ "k" : '), k, F.lit(', "a" : "'), F.col("event_type"), F.lit('"}'))
    return t.events.select("event_id", D.canonical(loose).alias("c"), D.json_equal(F.col("props"), F.lit('{"k":5}')).alias("five"))


@P.add("xml_build", "SELECT c_nationkey, string_agg('<c key=\"' || c_custkey || '\"><name>' || c_name || '</name><seg>' || c_mktsegment || '</seg></c>', '' ORDER BY c_custkey) AS x FROM customer GROUP BY c_nationkey")
def xml_build(t):
    row = D.xml_element("c", D.xml_forest(name=F.col("c_name"), seg=F.col("c_mktsegment"), none=F.lit(None).cast("string")), key=F.col("c_custkey"))
    return t.customer.withColumn("row", row).groupBy("c_nationkey").agg(A.ordered_string("row", "", "c_custkey").alias("x"))


@P.add("xml_of_table", "SELECT r_regionkey, '<row><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || r_name || '</r_name></row>' AS \"table\" FROM region")
def xml_of_table(t):
    return D.table_to_xml(t.region.select("r_regionkey", "r_name"), ["r_regionkey"])


@P.add("xml_table_missing", "SELECT n_nationkey, i AS place, CASE WHEN i = 2 THEN n_name END AS b, i * 10 AS a FROM nation, generate_series(1, 2) AS g(i)")
def xml_table_missing(t):
    """A first node without <b> does not take the second one's."""
    x = F.concat(F.lit("<r><n><a>10</a></n><n><a>20</a><b>"), F.col("n_name"), F.lit("</b></n></r>"))
    return D.xml_table(t.nation.select("n_nationkey", x.alias("x")), "x", "/r/n", {"a": ("a", "bigint"), "b": ("b", "string")}, "place").select("n_nationkey", F.col("place").cast("long").alias("place"), "b", "a")


# Segments, tokens, weights -------------------------------------------------------------
@P.add("seg_operators", "SELECT p_partkey, p_size <= 20 AND p_size + 5 >= 10 AS o, p_size <= 10 AND p_size + 5 >= 12 AS c, p_size + 5 < 10 AS l, greatest(p_size + 5.0, 12)::DOUBLE AS u FROM part")
def seg_operators(t):
    s = RG.seg(F.concat(F.lit("~"), F.col("p_size"), F.lit(" .. "), F.col("p_size") + 5))
    return t.part.select("p_partkey", RG.seg_overlaps(s, RG.seg(F.lit("15(+-)5"))).alias("o"), RG.seg_contains(s, RG.seg(F.lit("10..12"))).alias("c"), RG.seg_left(s, RG.seg(F.lit("10.."))).alias("l"), RG.seg_union(s, RG.seg(F.lit("12")))["high"].alias("u"))


@P.add("fts_parse", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\pL+')) AS INT) AS words FROM documents")
def fts_parse(t):
    kinds = F.filter(TS.parse_tokens(F.regexp_replace("text", r"[^\p{L}]+", " ")), lambda x: x["kind"].isin("word", "asciiword"))
    return t.documents.select("doc_id", F.size(kinds).alias("words"))


@P.add("fts_lexize", "SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN 'scarlet' ELSE lower(split_part(p_name, ' ', 1)) END AS lexeme FROM part")
def fts_lexize(t):
    return t.part.select("p_partkey", TS.lexize(F.split_part("p_name", F.lit(" "), F.lit(1)), {"red": "scarlet"})[0].alias("lexeme"))


@P.add("fts_json", "SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(c_name || ' ' || c_mktsegment), '[^\\pL\\pN]+'), lambda w: w <> ''))), ',') AS v FROM customer")
def fts_json(t):
    j = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")))
    return t.customer.select("c_custkey", F.array_join(TS.json_lexemes(j), ",").alias("v"))


@P.add("fts_weights", "SELECT p_partkey, split_part(p_name, ' ', 1) AS kept, CAST(length(p_brand) > 0 AS INT) AS n FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def fts_weights(t):
    first = TS.set_weight(TS.to_tsvector(F.split_part("p_name", F.lit(" "), F.lit(1))), "A")
    second = TS.set_weight(TS.to_tsvector(F.split_part("p_name", F.lit(" "), F.lit(2))), "D")
    kept = TS.filter_weights(F.concat(first, second), "A")
    rows = t.part.where(F.split_part("p_name", F.lit(" "), F.lit(1)) != F.split_part("p_name", F.lit(" "), F.lit(2)))
    return rows.select("p_partkey", kept[0]["lexeme"].alias("kept"), F.size(TS.delete(kept, "none")).alias("n"))


# Routines, windows of users, views, files ----------------------------------------------
@P.add("udf_named_arguments", "SELECT p_partkey, round(p_retailprice * 1.2, 4) AS gross, least(p_size, 10, p_partkey) AS l, p_name AS f FROM part")
def udf_named_arguments(t):
    user.create_functions(t.spark)
    return t.part.select(
        "p_partkey", F.round(F.expr("price_with_tax(tax => 0.2, price => p_retailprice)"), 4).alias("gross"),
        user.least_of(F.col("p_size"), F.lit(10), F.col("p_partkey")).alias("l"), user.first_given(F.lit(None).cast("string"), F.col("p_name"), F.lit("x")).alias("f"),
    )


@P.add("window_user_function", "SELECT p_partkey, round(exp(avg(ln(p_retailprice)) OVER (PARTITION BY p_brand)), 4) AS g FROM part")
def window_user_function(t):
    return t.part.select("p_partkey", F.round(user.geometric_mean("p_retailprice").over(W.partitionBy("p_brand")), 4).alias("g"))


@P.add("script_loop", "SELECT CAST(55 AS INT) AS total")
def script_loop(t):
    return t.spark.range(1).select(F.lit(user.sum_to(t.spark, 10)).cast("int").alias("total"))


@P.add("view_over_join", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def view_over_join(t):
    name = f"customers_{uuid.uuid4().hex[:8]}"
    t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).createTempView(name)
    out = t.spark.sql(f"SELECT n_name, count(*) AS customers FROM {name} GROUP BY n_name")
    t.spark.catalog.dropTempView(name)
    return out


@P.add("copy_round_trip", "SELECT c_custkey, c_name || ',\"q\"' AS c_name, nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal FROM customer WHERE c_acctbal > 0")
def copy_round_trip(t):
    path = f"{new_folder(t.spark, 'copy')}/rows"
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit(',"q"')).alias("c_name"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_acctbal")
    files.copy_to(rows, path, header=True)
    return files.copy_from(t.spark, path, "c_custkey BIGINT, c_name STRING, seg STRING, c_acctbal DOUBLE", header=True, where=F.col("c_acctbal") > 0)


@P.add("cursor_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
def cursor_fetch(t):
    cursor = files.Cursor(t.orders.select("o_orderkey").orderBy("o_orderkey"))
    cursor.move(10)
    return t.spark.createDataFrame([(r.o_orderkey,) for r in cursor.fetch(5)], "o_orderkey long")


QUERIES, ORACLE_SQL = P.queries, P.oracle

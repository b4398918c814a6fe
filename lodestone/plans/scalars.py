"""Scalar functions, ranges, search, geometry and documents over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import arrays as AR
from lodestone.functions import documents as D
from lodestone.functions import numbers as N
from lodestone.functions import ranges as RG
from lodestone.functions import search as TS
from lodestone.functions import space as SP
from lodestone.functions import strings as S
from lodestone.functions import temporal as T
from lodestone.plans.pairs import Pairs

P = Pairs()

# Text ----------------------------------------------------------------------------------
P.same("fn_lengths", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(text) AS BIGINT) AS bytes, CAST(bit_length(text) AS BIGINT) AS bits FROM {documents}",
       "SELECT doc_id, length(text) AS chars, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, bit_length(text) AS bits FROM documents")
P.same("fn_case", "SELECT lower(p_name) AS l, upper(p_name) AS u, p_partkey FROM {part}")
P.same("fn_substring", "SELECT p_partkey, substring(p_name, 2, 4) AS s, position('e' IN p_name) AS p, replace(p_name, 'red', 'blue') AS r, translate(p_name, 'aeiou', '12345') AS t, split_part(p_name, ' ', 2) AS f, reverse(p_name) AS v, repeat(p_brand, 2) AS d FROM {part}",
       "SELECT p_partkey, substring(p_name, 2, 4) AS s, CAST(position('e' IN p_name) AS INT) AS p, replace(p_name, 'red', 'blue') AS r, translate(p_name, 'aeiou', '12345') AS t, split_part(p_name, ' ', 2) AS f, reverse(p_name) AS v, repeat(p_brand, 2) AS d FROM part")
P.same("fn_pad_trim", "SELECT p_partkey, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 12, '-') AS r, trim(BOTH 'B' FROM p_brand) AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, ascii(p_name) AS a, chr(65) AS c FROM {part}",
       "SELECT p_partkey, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 12, '-') AS r, trim(p_brand, 'B') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, ascii(p_name) AS a, chr(65) AS c FROM part")
P.same("fn_digests", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
P.same("fn_encode", "SELECT c_custkey, base64(encode(c_name, 'UTF-8')) AS b, lower(hex(c_name)) AS h FROM {customer}", "SELECT c_custkey, base64(encode(c_name)) AS b, lower(hex(c_name)) AS h FROM customer")
P.same("fn_levenshtein", "SELECT p_partkey, levenshtein(p_name, 'red ring') AS d FROM {part}", "SELECT p_partkey, CAST(levenshtein(p_name, 'red ring') AS INT) AS d FROM part")
P.same("fn_format_name", "SELECT typeof(p_size) = 'int' AS a, p_partkey FROM {part}", "SELECT typeof(p_size) = 'INTEGER' AS a, p_partkey FROM part")


@P.add("fn_concat_nulls", "SELECT o_orderkey, concat(o_orderkey, nullif(o_orderstatus, 'F'), o_orderpriority) AS c, concat_ws('-', o_orderkey, nullif(o_orderstatus, 'F'), o_orderpriority) AS w FROM orders")
def fn_concat(t):
    s = F.nullif("o_orderstatus", F.lit("F"))
    return t.orders.select("o_orderkey", S.concat(F.col("o_orderkey").cast("string"), s, F.col("o_orderpriority")).alias("c"), F.concat_ws("-", F.col("o_orderkey").cast("string"), s, "o_orderpriority").alias("w"))


@P.add("fn_left_right", "SELECT p_partkey, left(p_name, 3) AS a, left(p_name, -3) AS b, right(p_name, 3) AS c, right(p_name, -3) AS d FROM part")
def fn_left_right(t):
    x = F.col("p_name")
    return t.part.select("p_partkey", S.left(x, 3).alias("a"), S.left(x, -3).alias("b"), S.right(x, 3).alias("c"), S.right(x, -3).alias("d"))


@P.add("fn_regexp", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS first, regexp_replace(p_name, '[aeiou]', '*', 'g') AS every, regexp_extract(p_name, '^(\\w+) ', 1) AS word FROM part")
def fn_regexp(t):
    x = F.col("p_name")
    return t.part.select("p_partkey", S.regexp_replace(x, "[aeiou]", "*").alias("first"), S.regexp_replace(x, "[aeiou]", "*", "g").alias("every"), S.regexp_match(x, r"^(\w+) ")[0].alias("word"))


@P.add("fn_regexp_split", "SELECT doc_id, CAST(len(string_split_regex(text, '\\s+')) AS INT) AS n FROM documents")
def fn_regexp_split(t):
    return t.documents.select("doc_id", F.size(F.split("text", r"\s+")).alias("n"))


@P.add("fn_similar_to", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(red|blue) .*(g|t)')")
def fn_similar(t):
    return t.part.where(S.similar_to(F.col("p_name"), "(red|blue) %(g|t)")).select("p_partkey")


@P.add("fn_quote_format", "SELECT n_nationkey, 'n=' || n_name || ' q=''' || n_name || '''' AS s FROM nation")
def fn_format(t):
    return t.nation.select("n_nationkey", S.format_text("n=%s q=%L", F.col("n_name"), F.col("n_name")).alias("s"))


@P.add("fn_phonetic")
def fn_phonetic(t):
    return t.part.select("p_partkey", F.soundex("p_name").alias("s"), S.difference(F.col("p_name"), F.lit("red ring")).alias("d"), S.bounded_levenshtein(F.col("p_name"), F.lit("red ring"), 3).alias("l"))


@P.add("fn_trigram_similarity", """
WITH g AS (SELECT p_partkey, list_distinct(flatten(list_transform(string_split(lower(p_name), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', CAST(i AS INT), 3))))) AS x FROM part),
q AS (SELECT list_distinct(flatten(list_transform(string_split('red ring', ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', CAST(i AS INT), 3))))) AS y)
SELECT p_partkey, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS s FROM g, q""")
def fn_trigram(t):
    return t.part.select("p_partkey", F.round(S.similarity(F.col("p_name"), F.lit("red ring")), 6).alias("s"))


@P.add("fn_unaccent", "SELECT doc_id, md5(replace(strip_accents(text), 'ß', 'ss')) AS plain FROM documents")
def fn_unaccent(t):
    return t.documents.select("doc_id", F.md5(S.unaccent(F.col("text"))).alias("plain"))


# Numbers ---------------------------------------------------------------------------------
P.same("fn_math", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_size), 6) AS s, round(cbrt(p_size), 6) AS c, round(exp(p_size / 50.0D), 6) AS e, round(ln(p_size), 6) AS l, round(power(p_size, 1.5D), 4) AS p, sign(p_size - 25) AS g, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS h FROM {part}",
       "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_size), 6) AS s, round(cbrt(p_size), 6) AS c, round(exp(p_size / 50.0::DOUBLE), 6) AS e, round(ln(p_size), 6) AS l, round(power(p_size, 1.5), 4) AS p, CAST(sign(p_size - 25) AS DOUBLE) AS g, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS h FROM part")
P.same("fn_trig", "SELECT p_size, round(sin(p_size), 6) AS a, round(cos(p_size), 6) AS b, round(tan(p_size), 6) AS c, round(atan2(p_size, 3), 6) AS d, round(sinh(p_size / 10.0D), 6) AS e, round(degrees(p_size), 4) AS f, round(radians(p_size), 6) AS g FROM {part}",
       "SELECT p_size, round(sin(p_size), 6) AS a, round(cos(p_size), 6) AS b, round(tan(p_size), 6) AS c, round(atan2(p_size, 3), 6) AS d, round(sinh(p_size / 10.0::DOUBLE), 6) AS e, round(degrees(p_size), 4) AS f, round(radians(p_size), 6) AS g FROM part")
P.same("fn_integer_division", "SELECT l_orderkey, l_orderkey div 7 AS q, l_orderkey % 7 AS r FROM {lineitem}", "SELECT l_orderkey, l_orderkey // 7 AS q, l_orderkey % 7 AS r FROM lineitem")
P.same("fn_bits", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, p_size ^ 5 AS x, shiftleft(p_size, 2) AS l, shiftright(p_size, 1) AS r, bit_count(p_size) AS c FROM {part}",
       "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, p_size << 2 AS l, p_size >> 1 AS r, CAST(bit_count(p_size) AS INT) AS c FROM part")


@P.add("fn_gcd_lcm", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l FROM part")
def fn_gcd(t):
    a, b = F.col("p_partkey"), F.col("p_size")
    return t.part.select("p_partkey", N.gcd(a, b).alias("g"), N.lcm(a, b).alias("l"))


@P.add("fn_num_nulls", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + CASE WHEN o_custkey = 3 THEN 1 ELSE 0 END AS n FROM orders")
def fn_num_nulls(t):
    return t.orders.select("o_orderkey", N.num_nulls(F.nullif("o_orderstatus", F.lit("F")), F.nullif("o_custkey", F.lit(3))).alias("n"))


@P.add("fn_degrees_exact", "SELECT x, CASE x WHEN 0 THEN 0.0 WHEN 30 THEN 0.5 WHEN 90 THEN 1.0 WHEN 150 THEN 0.5 WHEN 180 THEN 0.0 END::DOUBLE AS s FROM (VALUES (0), (30), (90), (150), (180)) AS v(x)")
def fn_degrees(t):
    return t.sql("SELECT * FROM (VALUES (0), (30), (90), (150), (180)) AS v(x)").select("x", N.sind(F.col("x").cast("double")).alias("s"))


@P.add("fn_width_bucket", "SELECT p_partkey, CAST(len(list_filter([10, 20, 35], lambda t: t <= p_size)) AS INT) AS b FROM part")
def fn_width_bucket(t):
    return t.part.select("p_partkey", N.width_bucket_of(F.col("p_size"), F.array(F.lit(10), F.lit(20), F.lit(35))).alias("b"))


# Dates -------------------------------------------------------------------------------------
_FIELDS = ("century", "decade", "year", "isoyear", "quarter", "month", "week", "day", "dow", "isodow", "doy", "hour", "minute", "epoch")


@P.add("fn_date_part", "SELECT event_id, " + ", ".join(f"CAST(date_part('{f}', ts) AS DOUBLE) AS {f}" for f in _FIELDS) + " FROM events")
def fn_date_part(t):
    return t.events.select("event_id", *[T.date_part(f, F.col("ts")).alias(f) for f in _FIELDS])


@P.add("fn_date_trunc", "SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{f}', o_orderdate) AS TIMESTAMP) AS {f}" for f in ("day", "week", "month", "quarter", "year", "decade")) + " FROM orders")
def fn_date_trunc(t):
    return t.orders.select("o_orderkey", *[T.date_trunc(f, F.col("o_orderdate")).alias(f) for f in ("day", "week", "month", "quarter", "year", "decade")])


P.same("fn_date_arithmetic", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS d, o_orderdate + INTERVAL '1' MONTH AS m, datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS n FROM {orders}",
       "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS d, o_orderdate + INTERVAL '1' MONTH AS m, CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INT) AS n FROM orders")


@P.add("fn_age", "SELECT o_orderkey, CAST(date_part('year', age(TIMESTAMP '2002-03-15', o_orderdate)) * 12 + date_part('month', age(TIMESTAMP '2002-03-15', o_orderdate)) AS INT) AS months FROM orders")
def fn_age(t):
    return t.orders.select("o_orderkey", T.age(F.lit("2002-03-15").cast("timestamp"), F.col("o_orderdate"))["months"].alias("months"))


@P.add("fn_to_char", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS s FROM events")
def fn_to_char(t):
    return t.events.select("event_id", T.to_char(F.col("ts"), "YYYY-MM-DD HH24:MI").alias("s"))


@P.add("fn_overlaps", "SELECT l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-01-01' < l_shipdate + INTERVAL 30 DAY AS o FROM lineitem")
def fn_overlaps(t):
    s = F.col("l_shipdate")
    return t.lineitem.select("l_orderkey", "l_linenumber", T.overlaps(s, s + F.expr("INTERVAL '30' DAY"), F.lit("1998-01-01").cast("timestamp"), F.lit("1998-06-01").cast("timestamp")).alias("o"))


# Ranges --------------------------------------------------------------------------------------
@P.add("range_operators", """
WITH r AS (SELECT p_partkey, p_size AS lo, p_size + 10 AS hi FROM part)
SELECT p_partkey, lo <= 20 AND 20 < hi AS has, lo < 30 AND 25 < hi AS over, hi <= 25 AS bef, lo = 30 OR hi = 25 AS adj, '[' || lo || ',' || hi || ')' AS txt FROM r""")
def range_operators(t):
    r, q = RG.make_range(F.col("p_size"), F.col("p_size") + 9, "[]", discrete=True), RG.make_range(F.lit(25), F.lit(30), "[)", discrete=True)
    return t.part.select("p_partkey", RG.contains_element(r, F.lit(20)).alias("has"), RG.overlaps(r, q).alias("over"), RG.before(r, q).alias("bef"), RG.adjacent(r, q).alias("adj"), RG.range_text(r).alias("txt"))


# Arrays, enums, maps, paths ---------------------------------------------------------------------
@P.add("array_functions", "SELECT n_regionkey, CAST(len(a) AS INT) AS n, list_position(a, 'NATION_7') AS p, a[2] AS second, array_to_string(a[1:2], '+') AS part FROM (SELECT n_regionkey, array_agg(n_name ORDER BY n_nationkey) AS a FROM nation GROUP BY n_regionkey)")
def array_functions(t):
    from lodestone.operators.aggregates import ordered_array

    a = F.col("a")
    rows = t.nation.groupBy("n_regionkey").agg(ordered_array("n_name", "n_nationkey").alias("a"))
    return rows.select("n_regionkey", AR.array_length(a).alias("n"), AR.array_position(a, F.lit("NATION_7")).cast("int").alias("p"), AR.subscript(a, F.lit(2)).alias("second"), AR.array_to_string(AR.array_slice(a, 1, 2), "+").alias("part"))


@P.add("array_unnest", "SELECT doc_id, unnest(string_split(lang || ',' || source, ',')) AS x FROM documents")
def array_unnest(t):
    return t.documents.select("doc_id", F.explode(F.split(F.concat_ws(",", "lang", "source"), ",")).alias("x"))


@P.add("intarray_query", "SELECT vec_id FROM embeddings WHERE label IN (1, 2) AND NOT label = 3")
def intarray(t):
    return t.embeddings.where(AR.query_int(F.array("label"), "(1|2)&!3")).select("vec_id")


@P.add("ltree_paths", "SELECT doc_id, path, path = 'top.en' OR starts_with(path, 'top.en.') AS below, split_part(path, '.', 2) AS sub FROM (SELECT doc_id, 'top.' || lang || '.' || source AS path FROM documents)")
def ltree(t):
    path = F.concat_ws(".", F.lit("top"), "lang", "source")
    return t.documents.select("doc_id", path.alias("path"), AR.is_ancestor(F.lit("top.en"), path).alias("below"), AR.subpath(path, 1, 1).alias("sub"))


# JSON --------------------------------------------------------------------------------------------
@P.add("json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_type(props) = 'OBJECT' AS is_object, json_exists(props, '$.k') AS has FROM events")
def json_access(t):
    return t.events.select("event_id", D.path(F.col("props"), "$.k", "int").alias("k"), (D.json_typeof(F.col("props")) == "object").alias("is_object"), D.exists_key(F.col("props"), "k").alias("has"))


@P.add("json_each", "SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value FROM events)")
def json_each(t):
    return D.each(t.events.select("event_id", "props"), "props").select("event_id", "key", "value")


P.same("json_build", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS j FROM {nation}", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS j FROM nation")

# Full-text search ----------------------------------------------------------------------------------
@P.add("fts_match", "SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\pL\\pN]+'), 'the') AND NOT list_contains(string_split_regex(lower(text), '[^\\pL\\pN]+'), 'of')")
def fts_match(t):
    return t.documents.where(TS.matches_words(F.col("text"), "the & !of", stop=False)).select("doc_id")


@P.add("fts_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN])of[^\\pL\\pN]+the([^\\pL\\pN]|$)')")
def fts_phrase(t):
    return t.documents.where(TS.has_phrase(F.col("text"), "of <-> the", stop=False)).select("doc_id")


# Space -----------------------------------------------------------------------------------------------
@P.add("cube_distances", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS y FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round(list_distance(x, y), 6) AS euclid, round(list_sum(list_transform(generate_series(1, 64), lambda i: abs(x[i] - y[i]))), 6) AS taxi, round(list_max(list_transform(generate_series(1, 64), lambda i: abs(x[i] - y[i]))), 6) AS cheb FROM e, q""")
def cube_distances(t):
    q = t.embeddings.where("vec_id = 0").agg(F.first("embedding").alias("y"))  # one row
    rows = t.embeddings.join(F.broadcast(q))
    x, y = F.col("embedding"), F.col("y")
    return rows.select("vec_id", F.round(SP.euclidean(x, y), 6).alias("euclid"), F.round(SP.taxicab(x, y), 6).alias("taxi"), F.round(SP.chebyshev(x, y), 6).alias("cheb"))


@P.add("geo_points", "SELECT p_partkey, round(sqrt(power(p_size - 10, 2) + power(p_retailprice / 100 - 9, 2)), 6) AS d, p_size BETWEEN 5 AND 20 AND p_retailprice / 100 BETWEEN 9 AND 12 AS inside FROM part")
def geo_points(t):
    p = SP.point(F.col("p_size"), F.col("p_retailprice") / 100)
    b = SP.box(SP.point(F.lit(20), F.lit(12)), SP.point(F.lit(5), F.lit(9)))
    return t.part.select("p_partkey", F.round(SP.distance(p, SP.point(F.lit(10), F.lit(9))), 6).alias("d"), SP.in_box(p, b).alias("inside"))


@P.add("geo_great_circle", "SELECT c_custkey, round(2 * 6378168.0 * asin(least(1.0, sqrt(power(sin(radians(c_nationkey - 0) / 2), 2) + cos(0) * cos(radians(c_nationkey)) * power(sin(radians(10) / 2), 2)))), 2) AS d FROM customer")
def geo_circle(t):
    return t.customer.select("c_custkey", F.round(SP.great_circle(F.lit(0), F.lit(0), F.col("c_nationkey"), F.lit(10)), 2).alias("d"))


@P.add("net_subnets", "SELECT s_suppkey, '10.0.' || (s_suppkey // 16 * 16) || '.0/20' AS net, (s_suppkey // 64) = 0 AS inside FROM supplier")
def net_subnets(t):
    a = F.concat(F.lit("10.0."), F.col("s_suppkey").cast("string"), F.lit(".7/20"))
    return t.supplier.select("s_suppkey", SP.network(a).alias("net"), SP.subnet_contains(F.lit("10.0.0.0/18"), a).alias("inside"))


QUERIES, ORACLE_SQL = P.queries, P.oracle

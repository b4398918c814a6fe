"""Functions and operators on literal rows, with results that the reference records."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import documents as D
from lodestone.functions import numbers as N
from lodestone.functions import ranges as R
from lodestone.functions import search as S
from lodestone.functions import space as P
from lodestone.functions import strings as T
from lodestone.functions import temporal as M
from lodestone.functions import user as U


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("n, want_left, want_right", [(-5, "", ""), (-4, "", ""), (-3, "a", "j"), (-1, "aho", "hoj"), (0, "", ""), (1, "a", "j"), (5, "ahoj", "ahoj")])
def test_left_right(value, n, want_left, want_right):
    assert value(T.left(F.lit("ahoj"), n)) == want_left and value(T.right(F.lit("ahoj"), n)) == want_right


def test_concat_skips_nulls(value):
    assert value(T.concat(F.lit(1), F.lit(None), F.lit("hello"), T.bool_text(F.lit(True)), T.bool_text(F.lit(False)))) == "1hellotf"
    assert value(F.concat_ws(",", F.lit(10), F.lit(20), F.lit(None), F.lit(30))) == "10,20,30"


def test_regular_expressions(value):
    assert value(T.regexp_match(F.lit("abc"), "")) == [""] and value(T.regexp_match(F.lit("abc"), "d")) is None
    assert value(T.regexp_match(F.lit("foobarbequebaz"), "(bar)(beque)")) == ["bar", "beque"]
    assert value(T.regexp_replace(F.lit("foobarbaz"), "b..", "X")) == "fooXbaz" and value(T.regexp_replace(F.lit("foobarbaz"), "b..", "X", "g")) == "fooXX"
    assert value(T.regexp_replace(F.lit("foobarbaz"), "b(..)", "X\\1Y", "g")) == "fooXarYXazY"
    assert value(T.similar_to(F.lit("abc"), "a%")) and not value(T.similar_to(F.lit("abc"), "b%")) and value(T.similar_to(F.lit("a.c"), "a.(b|c)"))


def test_levenshtein_and_sounds(value):
    assert value(F.levenshtein(F.lit("GUMBO"), F.lit("GAMBOL"))) == 2
    assert value(T.bounded_levenshtein(F.lit("extensive"), F.lit("exhaustive"), 2)) == 3
    assert value(T.difference(F.lit("Anne"), F.lit("Andrew"))) == 2


def test_quoting(value):
    assert value(T.quote_ident(F.lit("Foo bar"))) == '"Foo bar"' and value(T.quote_ident(F.lit("foo"))) == "foo"
    assert value(T.quote_literal(F.lit("it's"))) == "'it''s'" and value(T.quote_nullable(F.lit(None).cast("string"))) == "NULL"
    assert value(T.format_text("%s %% %L %I", F.lit("a"), F.lit("b"), F.lit("c d"))) == "a % 'b' \"c d\"" and value(T.format_text("%2$s-%1$s", F.lit("a"), F.lit("b"))) == "b-a"
    assert value(T.parse_ident(F.lit('"SomeSchema".sometable'))) == ["SomeSchema", "sometable"]


def test_trigrams(value):
    assert value(T.trigrams(F.lit("cat"))) == ["  c", " ca", "at ", "cat"]
    assert value(T.similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert value(T.unaccent(F.lit("Hôtel Straße œuvre"))) == "Hotel Strasse oeuvre" and value(T.initcap(F.lit("hi THOMAS"))) == "Hi Thomas"


def test_rounding(spark):
    rows = spark.createDataFrame([(v,) for v in (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5)], "x double")
    assert [r[0] for r in rows.select(N.to_int(F.col("x"))).collect()] == [-2, -2, 0, 0, 2, 2]
    assert [r[0] for r in rows.select(N.decimal_to_int(F.col("x").cast("decimal(5,1)"))).collect()] == [-3, -2, -1, 1, 2, 3]


def test_numbers(value):
    assert value(N.gcd(F.lit(330), F.lit(462))) == 66 and value(N.lcm(F.lit(330), F.lit(462))) == 2310 and value(N.gcd(F.lit(0), F.lit(0))) == 0
    assert value(N.num_nulls(F.lit(None), F.lit(1), F.lit(None))) == 2 and value(N.num_nonnulls(F.lit(None))) == 0
    assert value(N.cosd(F.lit(60.0))) == 0.5 and value(N.tand(F.lit(45.0))) == 1.0 and value(N.asind(F.lit(0.5))) == 30.0 and value(N.acosd(F.lit(0.5))) == 60.0
    assert value(N.trunc(F.lit(-42.8))) == -42.0 and value(N.width_bucket_of(F.lit(7), F.array(F.lit(1), F.lit(5), F.lit(10)))) == 2
    for bad in (N.sqrt(F.lit(-1.0)), N.ln(F.lit(0.0)), N.power(F.lit(0.0), F.lit(-1.0))):
        with pytest.raises(Exception, match="cannot|undefined"):
            value(bad)


def test_dates(value):
    t = F.lit("2001-02-16 20:38:40.12").cast("timestamp")
    assert value(M.date_part("century", t)) == 21 and value(M.date_part("dow", t)) == 5 and value(M.date_part("isodow", t)) == 5 and value(M.date_part("milliseconds", t)) == 40120
    assert value(M.date_trunc("century", t)) == datetime.datetime(2001, 1, 1) and value(M.date_trunc("decade", t)) == datetime.datetime(2000, 1, 1)
    a = value(M.age(F.lit("2001-04-10").cast("timestamp"), F.lit("1957-06-13").cast("timestamp")))
    assert (a.months, a.days, a.micros) == (43 * 12 + 9, 28, 0)
    j = value(M.justify_days(M.interval(days=65)))
    assert (j.months, j.days) == (2, 5)
    assert value(M.to_char(t, "YYYY-MM-DD HH24:MI:SS")) == "2001-02-16 20:38:40"
    d = lambda x: F.lit(x).cast("date")
    assert value(M.overlaps(d("2001-02-16"), d("2001-12-21"), d("2001-10-30"), d("2002-10-30"))) and not value(M.overlaps(d("2001-02-16"), d("2001-10-30"), d("2001-10-30"), d("2002-10-30")))


def test_ranges(value):
    r = lambda a, b, bounds="[)": R.make_range(F.lit(a).cast("int"), F.lit(b).cast("int"), bounds, discrete=True)
    assert value(R.range_text(r(1, 3, "[]"))) == "[1,4)" and value(R.range_text(r(1, 1))) == "empty" and value(R.range_text(r(None, 5, "(]"))) == "(,6)"
    assert value(R.contains_element(r(1, 10), F.lit(1))) and not value(R.contains_element(r(1, 10), F.lit(10)))
    assert value(R.overlaps(r(1, 5), r(4, 9))) and not value(R.overlaps(r(1, 4), r(4, 9)))
    assert value(R.adjacent(r(1, 4), r(4, 9))) and value(R.before(r(1, 4), r(4, 9))) and value(R.contains_range(r(1, 10), r(2, 10)))
    assert value(R.range_text(R.intersection(r(1, 6), r(4, 9)))) == "[4,6)" and value(R.range_text(R.merge(r(1, 2), r(8, 9)))) == "[1,9)"
    assert value(R.isempty(R.intersection(r(1, 2), r(8, 9)))) and value(R.overleft(r(1, 5), r(2, 5))) and value(R.overright(r(3, 5), r(2, 9)))
    with pytest.raises(Exception, match="lower bound"):
        value(r(5, 1))


def test_arrays(value):
    a = F.array(F.lit(1), F.lit(2), F.lit(2), F.lit(3))
    assert value(A.array_length(F.array().cast("array<int>"))) is None and value(A.array_position(a, F.lit(9))) is None and value(A.subscript(a, F.lit(0))) is None and value(A.subscript(a, F.lit(9))) is None
    assert value(A.uniq(a)) == [1, 2, 3] and value(A.query_int(a, "1&(9|3)&!7")) and value(A.int_contains(a, F.array(F.lit(3), F.lit(1))))
    colours = ["red", "orange", "yellow", "green"]
    assert value(A.enum_range(colours, F.lit("orange"), F.lit("green"))) == ["orange", "yellow", "green"] and value(A.enum_ordinal(F.lit("yellow"), colours)) == 3
    assert value(A.string_to_array(F.lit("a,b,,c"), ",", "")) == ["a", "b", None, "c"] and value(A.array_to_string(F.array(F.lit("a"), F.lit(None), F.lit("b")), "-", "*")) == "a-*-b"
    assert value(A.any_of(F.lit(2), a, lambda x, v: x == v)) and not value(A.all_of(F.lit(2), a, lambda x, v: x >= v))


def test_maps_and_paths(value):
    h = A.hstore(F.lit('a=>1, b=>NULL, "c d"=>"x y", a=>9'))
    assert value(h) == {"a": "1", "b": None, "c d": "x y"}
    assert value(A.map_contains(h, A.hstore(F.lit("a=>1")))) and not value(A.map_contains(h, A.hstore(F.lit("a=>2"))))
    assert value(A.map_update(h, A.hstore(F.lit("a=>5")))) == {"b": None, "c d": "x y", "a": "5"}
    assert value(A.is_ancestor(F.lit("Top.Science"), F.lit("Top.Science.Astronomy"))) and value(A.lca(F.lit("1.2.3.4"), F.lit("1.2.5"))) == "1.2"
    assert value(A.subpath(F.lit("a.b.c"), 1)) == "b.c" and value(A.lquery(F.lit("Top.Science.Astronomy"), "*.Sci*.*{1}")) and not value(A.lquery(F.lit("Top.Science"), "*.!Science"))


def test_documents(value, spark):
    j = F.lit('{"a": 1, "b": {"c": "x"}, "d": null}')
    assert value(D.exists_key(j, "a")) and not value(D.exists_key(j, "z")) and value(D.exists_any(j, ["z", "b"])) and not value(D.exists_all(j, ["a", "z"]))
    assert value(D.path(j, "$.b.c")) == "x" and value(D.path(j, "$.b.z")) is None and value(D.json_typeof(F.lit("[1]"))) == "array"
    assert value(D.flat_contains(F.lit('{"a":1,"b":2}'), F.lit('{"b":2}'))) and value(D.strip_nulls(F.lit('{"a":1,"b":null}'))) == '{"a":"1"}'
    assert value(D.path_filter(F.lit('{"v":[1,5,9]}'), "$.v", lambda x: x > 3, "int")) == [5, 9]
    df = spark.createDataFrame([("<r><i><n>a</n><q>1</q></i><i><n>b</n><q>2</q></i></r>",)], "x string")
    assert [tuple(r)[1:] for r in D.xml_table(df, "x", "/r/i", {"n": ("n", "string"), "q": ("q", "int")}, "o").collect()] == [(1, "a", 1), (2, "b", 2)]


def test_search(value):
    v = S.to_tsvector(F.lit("The fat cat sat on a mat and ate a fat rat"))
    assert [s.lexeme for s in value(v)] == ["ate", "cat", "fat", "mat", "rat", "sat"] and value(S.positions(v, "fat")) == [2, 11]
    assert value(S.matches(v, "fat & (rat | dog) & !cow")) and value(S.matches(v, "fat <-> cat")) and not value(S.matches(v, "cat <-> fat")) and value(S.matches(v, "ma:*"))
    assert S.phrase_query("the cat is on a mat") == "cat <4> mat" and S.web_query('"fat rat" or cat -dog') == "fat <-> rat | cat & !dog"
    assert value(S.headline(F.lit("a fat rat"), "fat")) == "a <b>fat</b> rat" and value(S.rank(v, "fat")) > value(S.rank(v, "cat"))


def test_space(value):
    a, b = P.point(F.lit(0), F.lit(0)), P.point(F.lit(3), F.lit(4))
    assert value(P.distance(a, b)) == 5.0 and value(P.box_area(P.box(a, b))) == 12.0 and value(P.in_box(P.point(F.lit(1), F.lit(1)), P.box(a, b)))
    assert value(P.polygon_area(F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0))))) == 12.0
    assert value(P.great_circle(F.lit(0), F.lit(0), F.lit(0), F.lit(180))) == pytest.approx(20037605.73, abs=0.01)
    x, y = F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))
    assert (value(P.euclidean(x, y)), value(P.taxicab(x, y)), value(P.chebyshev(x, y))) == (5.0, 7.0, 4.0)
    n = F.lit("192.168.1.226/24")
    assert value(P.network(n)) == "192.168.1.0/24" and value(P.broadcast(n)) == "192.168.1.255/24" and value(P.netmask(n)) == "255.255.255.0" and value(P.subnet_contains(F.lit("192.168.0.0/16"), n))
    assert value(P.macaddr_trunc(F.lit("12:34:56:78:90:ab"))) == "12:34:56:00:00:00" and value(P.check_digit_ean13(F.lit("978-0-393-04002-9"))) and value(P.check_digit_issn(F.lit("0317-8471")))


def test_user_functions(value, spark):
    assert value(U.strict(lambda a, b: a + b)(F.lit(1), F.lit(None).cast("int"))) is None and U.sum_to(spark, 10) == 55
    U.create_functions(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM squares(3)").collect()] == [(1, 1), (2, 4), (3, 9)]
    with pytest.raises(Exception, match="violates"):
        value(U.domain(F.lit(-1), F.lit(-1) > 0, "positive"))
    assert value(U.normalised(F.lit("é"))) == "é"


def test_octets_over_255_carry_nothing(value):
    n = F.lit("10.0.300.7/20")
    assert value(P.network(n)) == "10.0.288.0/20" and value(P.broadcast(n)) == "10.0.303.255/20" and not value(P.subnet_contains(F.lit("10.0.0.0/18"), n))
    for address, net in (("172.16.5.9/0", "0.0.0.0/0"), ("172.16.5.9/12", "172.16.0.0/12"), ("172.16.5.9/25", "172.16.5.0/25"), ("172.16.5.9", "172.16.5.9/32")):
        assert value(P.network(F.lit(address))) == net and value(P.subnet_contains(F.lit(net), F.lit(address)))
    assert value(P.network(F.lit(None).cast("string"))) is None


def test_phrases_without_a_vector(spark):
    texts = ["of the", "OF, THE!", "often the", "of then", "of a the", "xof the of  the", "the of", "", "Éof the", "of the2", "of9 of\nthe", None, "of of the", "the cat on the mat", "the cat is on the mat"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for phrase in ("of <-> the", "cat <3> mat", "of", "cat <1> on", "of <2> the", "é <-> of"):
        rows = df.where("t is not null").select(S.has_phrase(F.col("t"), phrase, stop=False).alias("a"), S.matches(S.to_tsvector(F.col("t"), stop=False), phrase).alias("b"), S.has_phrase(F.col("t"), phrase).alias("c"), S.matches(S.to_tsvector(F.col("t")), phrase).alias("d")).collect()
        assert [(r.a, r.c) for r in rows] == [(r.b, r.d) for r in rows], phrase
    assert df.where("t is null").select(S.has_phrase(F.col("t"), "of <-> the", stop=False)).first()[0] is None


def test_fts_phrase_makes_no_vector(spark, data):
    from lodestone.plans import registry

    plan = registry.QUERIES["fts_phrase"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "array_sort" not in plan and "transform(" not in plan


def test_a_vector_of_some_lexemes_keeps_their_places(value):
    text = F.lit("The fat cat sat on a mat and ate a fat rat")
    assert [tuple(s) for s in value(S.to_tsvector(text, only=("rat", "fat", "the")))] == [("fat", [2, 11]), ("rat", [12])]

"""Operators on small frames: ties, NULLs, cycles, frames, changes, files, streams, slow views."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import aggregates, recursion, relational, slow_views, windows
from lodestone.sources import files
from lodestone.sources.series import Series
from lodestone.streaming import feeds


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_with_ties(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 7), (5, None), (6, 9)], "id int, x int")
    assert [r.id for r in relational.with_ties(df, ["x"], 1).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in relational.with_ties(df, ["x"], 1, ascending=False).orderBy("id").collect()] == [1, 5]
    assert relational.with_ties(df, ["x"], 0).count() == 0 and relational.with_ties(df, ["x"], 99).count() == 6


def test_distinct_on_and_series(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 9)], "k string, x int")
    assert rows(relational.distinct_on(df, ["k"], [F.col("x")])) == rows(spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int"))
    assert [r.n for r in relational.generate_series(spark, 5, 1, -2).orderBy("n").collect()] == [1, 3, 5]
    one = spark.range(1).select(F.lit(1).alias("one"))
    got = relational.lockstep(one, a=F.expr("sequence(1, 2)"), b=F.expr("sequence(1, 4)")).select("a", "b").collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 2), (None, 3), (None, 4)]


def test_crosstab_by_position(spark):
    df = spark.createDataFrame([("test1", f"att{k}", f"val{k}") for k in range(1, 5)] + [(None, "att1", "val9")], "rowid string, attribute string, value string")
    got = {r.rowid: (r.c1, r.c2) for r in relational.crosstab(df, "rowid", "attribute", "value", ["c1", "c2"]).collect()}
    assert got == {"test1": ("val1", "val2"), None: ("val9", None)}


def test_samples_repeat(spark):
    df = spark.range(20000)
    a, b = (relational.bernoulli_sample(df, ["id"], 10, s) for s in (1, 2))
    assert rows(a) == rows(relational.bernoulli_sample(df.repartition(7), ["id"], 10, 1)) and rows(a) != rows(b)
    assert 1700 < a.count() < 2300 and relational.sample_rows(df, ["id"], 30).count() == 30


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 5, "z")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("b", 9, 30)], "k string, t int, w int")
    assert rows(relational.asof_join(left, right, "t", ["k"]), "v", "w") == [("x", None), ("y", 20), ("z", None)]


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    assert rows(relational.update_rows(t, F.col("v") == "a", v=F.lit("z"))) == [(1, "z"), (2, "b"), (3, None)]
    stay, gone = relational.delete_rows(t, F.col("v") == "a")
    assert rows(stay) == [(2, "b"), (3, None)] and rows(gone) == [(1, "a")]
    new = spark.createDataFrame([(2, "B"), (4, "D")], "id int, v string")
    assert rows(relational.upsert(t, new, ["id"])) == [(1, "a"), (2, "B"), (3, None), (4, "D")]
    assert rows(relational.upsert(t, new, ["id"], update=False)) == [(1, "a"), (2, "b"), (3, None), (4, "D")]


def test_recursion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "n int")
    out = recursion.recursive_union(seed, lambda w: w.join(edges, w["n"] == edges["a"]).select(F.col("b").alias("n")))
    assert rows(out) == [(1,), (2,), (3,)]
    tree = spark.createDataFrame([("row1", None), ("row2", "row1"), ("row3", "row1"), ("row4", "row2"), ("row5", "row2"), ("row6", "row4"), ("row7", "row3"), ("row8", "row6"), ("row9", "row5")], "keyid string, parent string")
    got = recursion.connectby(tree, "keyid", "parent", "row2").orderBy("branch").collect()
    assert [(r.keyid, r.level, r.branch) for r in got] == [("row2", 0, "row2"), ("row4", 1, "row2~row4"), ("row6", 2, "row2~row4~row6"), ("row8", 3, "row2~row4~row6~row8"), ("row5", 1, "row2~row5"), ("row9", 2, "row2~row5~row9")]
    with pytest.raises(Exception, match="infinite recursion"):
        recursion.connectby(edges, "b", "a", 1).collect()


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "b"), (1, None), (1, "a"), (2, None)], "k int, x string")
    got = {r.k: (r.a, r.s) for r in df.groupBy("k").agg(aggregates.ordered_array("x", "x").alias("a"), aggregates.ordered_string("x", ",", "x").alias("s")).collect()}
    assert got == {1: (["a", "b", None], "a,b"), 2: ([None], None)}
    empty = spark.createDataFrame([], "a int, v int")
    out = aggregates.grouping_sets(empty, [["a"], [], []], [F.count(F.lit(1)).alias("n")])
    assert rows(out) == [(None, 1, 0), (None, 1, 0)]


def test_frames(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 4), (5, 4)], "id int, x int")
    got = windows.groups_frame(df, F.sum("id"), [], [F.col("x")], -1, 0, "s")
    assert rows(got, "id", "s") == [(1, 3), (2, 3), (3, 6), (4, 12), (5, 12)]
    whole = lambda w: w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    assert rows(windows.excluding(df, "id", [], [F.col("x")], whole, "ties", "s"), "id", "s") == [(1, 13), (2, 14), (3, 15), (4, 10), (5, 11)]


def test_copy_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "plain"), (2, 'quo"ted, text'), (3, None), (4, "")], "id int, v string")
    files.copy_to(df, f"file://{tmp_path}/csv", header=True)
    back = files.copy_from(spark, f"file://{tmp_path}/csv", "id int, v string", header=True)
    assert rows(back) == rows(df)
    files.copy_to(df.where("id < 4"), f"file://{tmp_path}/text", form="text")
    assert rows(files.copy_from(spark, f"file://{tmp_path}/text", "id int, v string", form="text", where=F.col("id") > 1)) == rows(df.where("id in (2, 3)"))
    filled = files.copy_from(spark, f"file://{tmp_path}/csv", "id int, v string", header=True, force_not_null=["v"])
    assert {r.v for r in filled.where("id = 3").collect()} == {""}


def test_stored_results_and_cursors(spark):
    spark.sql("DROP TABLE IF EXISTS mv")
    files.create_table_as(spark.range(5), "mv")
    assert files.refresh(spark, "mv", spark.range(5), concurrently=True) == 0
    assert files.refresh(spark, "mv", spark.range(7), concurrently=True) == 2 and spark.table("mv").count() == 7
    spark.sql("DROP TABLE mv")
    cursor = files.Cursor(spark.range(10).orderBy("id"))
    assert [r.id for r in cursor.fetch(3)] == [0, 1, 2] and cursor.move(2) == 2 and cursor.fetch()[0].id == 5


def test_foreign_table(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Series)
    df = spark.read.format("series").option("stop", 1000).load()
    assert df.count() == 1000 and [r.n for r in df.where("n >= 10 AND n < 13").orderBy("n").collect()] == [10, 11, 12]


def test_change_feed(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(1, "update", 1, "x"), (2, "delete", 2, None), (3, "insert", 3, "c"), (4, "update", 3, "d")], "lsn int, op string, id int, v string")
    assert rows(feeds.apply_changes(table, changes, ["id"])) == [(1, "x"), (3, "d")]
    cut = changes.unionByName(spark.createDataFrame([(3, "truncate", None, None)], changes.schema))
    assert rows(feeds.apply_changes(table, cut, ["id"])) == [(3, "d")]


def test_subscription(spark, tmp_path):
    (tmp_path / "in").mkdir()
    changes = spark.createDataFrame([(1, "insert", 1, "a"), (2, "insert", 2, "b")], "lsn int, op string, id int, v string")
    changes.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    state = {"table": spark.createDataFrame([], "id int, v string")}

    def store(df, _):
        state["table"] = spark.createDataFrame(df.collect(), "id int, v string")

    for k in range(2):
        stream = spark.readStream.schema(changes.schema).parquet(f"file://{tmp_path}/in")
        feeds.replicate(stream, ["id"], lambda: state["table"], store, f"file://{tmp_path}/checkpoint").awaitTermination()
        if not k:
            spark.createDataFrame([(3, "delete", 1, None)], changes.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert rows(state["table"]) == [(2, "b")]


def test_slow_views(spark):
    orders = spark.range(100).select(F.col("id").alias("o"), (F.col("id") % 7).alias("x"))
    lines = spark.range(300).select((F.col("id") % 100).alias("l"), F.col("id").alias("q"))

    def query(low, high, how="inner"):
        return lines.where(F.col("q").between(low, high)).join(orders, F.col("l") == F.col("o"), how).groupBy("x").count()

    slow = slow_views.summarise(slow_views.capture(query(5, 10), "slow"))
    store = slow_views.excavate(slow, slow.select("query_id", "node_id", F.lit(900.0).alias("sub_cost")), 500.0)
    assert slow_views.excavate(slow, slow.select("query_id", "node_id", F.lit(100.0).alias("sub_cost")), 500.0).count() == 0
    for low, high, how, hit in ((4, 12, "inner", True), (5, 10, "inner", True), (6, 9, "inner", False), (20, 30, "inner", False), (5, 10, "left_semi", False)):
        nodes = slow_views.capture(query(low, high, how) if how != "left_semi" else lines.where(F.col("q").between(low, high)).join(orders, F.col("l") == F.col("o"), how).groupBy("l").count(), "new")
        assert (slow_views.match(slow_views.summarise(nodes), store).where("node_id = 0").count() > 0) == hit, (low, high, how)
    assert slow_views.explain_slow(query(5, 10), store).where("slow_query = 'slow'").count() > 0


def test_interval_join_keeps_each_unmatched_row_once(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "id int, x double")
    spans = spark.createDataFrame([(7, 0.0, 40.0), (8, 60.0, 90.0), (9, 9.0, 1.0)], "s int, lo double, hi double")
    by = lambda rows: sorted(rows, key=str)
    for how, want in (("inner", [(1, 7)]), ("left", [(1, 7), (2, None), (3, None)]), ("right", [(1, 7), (None, 8), (None, 9)]), ("full", [(1, 7), (2, None), (3, None), (None, 8), (None, 9)])):
        rows = [(r.id, r.s) for r in relational.interval_join(points, spans, "x", "lo", "hi", 5.0, how).collect()]
        assert by(rows) == by(want), how


def test_distinct_counts_over_a_partition(spark):
    from lodestone.operators import windows

    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (2, None)], "g int, v string")
    got = sorted((r.g, r.n) for r in df.select("g", windows.count_distinct_over("v", "g").alias("n")).collect())
    assert got == [(1, 2), (1, 2), (1, 2), (1, 2), (2, 0)]


def test_predicates_of_plans():
    p = slow_views._predicates
    assert p("Filter ((isnotnull(a#1L) AND (a#1L > 5)) AND (a#1L > 3))") == ([("a", 5.0, False, None, False)], [])
    assert p("Filter ((a#1L >= 5) AND (a#1L > 5) AND (a#1L <= 9) AND (a#1L < 9))") == ([("a", 5.0, False, 9.0, False)], [])
    for text in ("((a#1L > 5) OR (a#1L < 3))", "NOT (a#1L = 3)"):
        bounds, rest = p(f"Filter {text}")
        assert bounds == [] and rest == [text.replace("#1L", "")]


def test_slow_view_nodes_are_never_broadcast(spark):
    from lodestone.operators import slow_views

    nodes = spark.createDataFrame([("q", 0, None, "Aggregate", None, None, [], [], [["a"]], []), ("q", 1, 0, "Scan", None, "t", [], [], [], [])], slow_views.NODE)
    subplans = slow_views.summarise(nodes)
    costs = subplans.select("query_id", "node_id", F.lit(900.0).alias("sub_cost"))
    store = slow_views.excavate(subplans, costs, 500.0)
    assert "BroadcastHashJoin" not in store._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in slow_views.match(subplans, store).collect()] == [("q", 0, "q", 0, 900.0)]


def test_overlapping_ranges_are_dealt_to_all_partitions_and_each_pair_comes_once(spark, data):
    from lodestone.plans import registry

    rows = [(k, lo, hi) for k, (lo, hi) in enumerate([(0.0, 9.0), (1.0, 2.0), (1.0, 2.0), (2.0, 3.0), (5.0, 5.0), (7.0, 6.5), (-3.0, -0.5), (8.9, 9.1), (0.0, 0.1), (1.5, None), (None, 4.0), (-40.0, 40.0)])]
    rows += [(3, 1.0, 1.5), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, lo double, hi double")
    meet = [(a, b) for a, al, ah in rows for b, bl, bh in rows if None not in (a, b, al, ah, bl, bh) and al < bh and bl < ah]
    assert sorted(map(tuple, relational.overlap_pairs(df, "id", "lo", "hi", 2.0).collect())) == sorted((a, b) for a, b in meet if a < b)
    both = relational.overlap_join(df.toDF("a", "al", "ah"), df.toDF("b", "bl", "bh"), "al", "ah", "bl", "bh", 2.0)
    assert sorted(map(tuple, both.where("a is not null and b is not null").select("a", "b").collect())) == sorted(meet)
    query = registry.QUERIES["join_range_overlap"](spark, data)
    assert query.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and "Broadcast" not in query._jdf.queryExecution().executedPlan().toString()

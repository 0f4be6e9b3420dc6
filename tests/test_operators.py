"""Golden rows of the relational operators, on one, two and seven partitions."""

import pytest
from pyspark.sql import functions as F

from skeinwork import functions as fn
from skeinwork import operators as op
from skeinwork import sources
from skeinwork.errors import EngineError, ReturnCode
from skeinwork.plans import serde
from skeinwork.types import INT32, INT64, STRING, Attribute, Schema, schema_of

a = fn.NamedAttribute


@pytest.fixture(params=[1, 2, 7])
def frame(spark, request):
    def make(rows, ddl):
        return spark.createDataFrame(rows, ddl).repartition(request.param)

    return make


def got(df):
    return [tuple(r) for r in df.collect()]


def bag(df):
    return sorted(got(df), key=lambda r: tuple((x is None, str(x)) for x in r))


def spec(*parts):
    out = op.AggregationSpecification()
    for f, i, o in parts:
        out.add(f, i, o)
    return out


def code_of(f):
    with pytest.raises(EngineError) as x:
        f()
    return x.value.code


def test_group_with_limited_keys(frame):
    rows = [(i, k, v) for i, (k, v) in enumerate([(1, 3), (3, -3), (1, 4), (3, -5), (4, 3), (1, -2), (5, 1), (3, -1), (4, 5)])]
    df = frame(rows, "i int, k int, v int")
    limited = op.group_aggregate(df, ["k"], spec((op.SUM, "v", "s")), [F.col("i")], max_unique_keys=2)
    assert bag(limited) == [(1, 5), (3, -9), (4, 9)]


def test_group_null_key_and_empty(frame):
    df = frame([(3, -3), (None, 4), (3, -5), (None, 1)], "k int, v int")
    assert bag(op.group_aggregate(df, ["k"], spec((op.SUM, "v", "s")))) == [(3, -8), (None, 5)]
    none = df.filter("v > 100")
    assert got(op.group_aggregate(none, [], spec((op.COUNT, "", "n")))) == []
    assert got(op.scalar_aggregate(none, spec((op.COUNT, "", "n"), (op.SUM, "v", "s")))) == [(0, None)]
    assert bag(op.group_aggregate(df, ["k"], op.AggregationSpecification())) == [(3,), (None,)]


def test_every_aggregate(frame):
    df = frame([(0, "a"), (1, None), (2, "b"), (3, "a")], "i int, s string")
    s = spec((op.FIRST, "s", "f"), (op.LAST, "s", "l"), (op.CONCAT, "s", "c"), (op.COUNT, "s", "n"), (op.MIN, "s", "lo"), (op.MAX, "s", "hi"))
    s.add_distinct(op.CONCAT, "s", "dc").add_distinct(op.COUNT, "s", "dn")
    assert got(op.scalar_aggregate(df, s, [F.col("i")])) == [("a", "a", "a,b,a", 3, "a", "b", "a,b", 2)]


def test_sum_keeps_and_wraps_its_type(frame):
    df = frame([(2**31 - 1,), (1,)], "v int")
    assert got(op.scalar_aggregate(df, spec((op.SUM, "v", "s")))) == [(-(2**31),)]
    wide = op.AggregationSpecification().add(op.SUM, "v", "s", INT64)
    assert got(op.scalar_aggregate(df, wide)) == [(2**31,)]
    big = frame([(2**63 - 1,), (1,)], "v bigint")
    assert got(op.scalar_aggregate(big, spec((op.SUM, "v", "s")))) == [(-(2**63),)]


def test_aggregate_errors(frame):
    df = frame([(1, "x")], "v int, s string")
    assert code_of(lambda: op.scalar_aggregate(df, spec((op.SUM, "zz", "s")))) == ReturnCode.ERROR_ATTRIBUTE_MISSING
    assert code_of(lambda: op.scalar_aggregate(df, spec((op.SUM, "s", "s")))) == ReturnCode.ERROR_INVALID_ARGUMENT_TYPE
    assert code_of(lambda: op.scalar_aggregate(df, spec((op.SUM, "v", "x"), (op.MIN, "v", "x")))) == ReturnCode.ERROR_ATTRIBUTE_EXISTS
    assert code_of(lambda: op.scalar_aggregate(df, spec((op.FIRST, "v", "x")))) == ReturnCode.ERROR_INVALID_ARGUMENT_VALUE


def test_clusters(frame):
    rows = [(i, k, v) for i, (k, v) in enumerate([(0, 13), (2, 4), (2, 5), (2, -4), (2, -6), (1, 3), (1, 4), (1, -3), (2, 1), (None, 2), (None, 3)])]
    df = frame(rows, "i int, k int, v int")
    assert bag(op.aggregate_clusters(df, ["k"], spec((op.SUM, "v", "s")), [F.col("i")])) == [(0, 13), (1, 4), (2, -1), (2, 1), (None, 5)]
    assert got(op.aggregate_clusters(df.filter("i < 0"), [], spec((op.SUM, "v", "s")), [F.col("i")])) == []
    assert got(op.aggregate_clusters(df.filter("i < 0"), ["k"], spec((op.SUM, "v", "s")), [F.col("i")])) == []


def sides(left, right):
    return op.CompoundMultiSourceProjector().add(0, fn.ProjectNamedAttributes(left)).add(1, fn.ProjectNamedAttributes(right))


def test_join_nulls_and_duplicates(frame):
    l = frame([(1, "a"), (1, None), (None, "a"), (None, None), (2, "b")], "k bigint, s string")
    r = frame([(1, "a", "x"), (None, "a", "y"), (2, "b", "p"), (2, "b", "q")], "k bigint, t string, v string")
    keys = (fn.ProjectNamedAttributes(["k", "s"]), fn.ProjectNamedAttributes(["k", "t"]))
    assert bag(op.hash_join(l, r, op.INNER, *keys, sides(["k", "s"], ["v"]))) == [(1, "a", "x"), (2, "b", "p"), (2, "b", "q")]
    left = op.hash_join(l, r, op.LEFT_OUTER, *keys, sides(["s"], ["v"]))
    assert len(got(left)) == 6 and schema_of(left)["v"].nullable
    assert bag(op.hash_join(l, r, op.INNER, *keys, sides(["k"], ["v"]), op.UNIQUE, [F.col("v")])) == [(1, "x"), (2, "p")]
    assert bag(op.hash_join(l, l, op.INNER, a("k"), a("k"), op.CompoundMultiSourceProjector().add(0, a("s")).add(1, fn.Alias("s2", a("s"))))) == [("a", "a"), ("a", None), ("b", "b"), (None, "a"), (None, None)]


def test_join_errors(frame):
    l, r = frame([(1,)], "k bigint"), frame([(1,)], "k int")
    assert code_of(lambda: op.hash_join(l, r, op.RIGHT_OUTER, a("k"), a("k"), sides(["k"], []))) == ReturnCode.ERROR_NOT_IMPLEMENTED
    assert code_of(lambda: op.hash_join(l, r, op.INNER, a("k"), a("k"), sides(["k"], []))) == ReturnCode.ERROR_ATTRIBUTE_TYPE_MISMATCH


def test_rowid_join(frame):
    r = frame([(i, c * 2) for i, c in enumerate("ABC")], "o int, name string")
    l = frame([(0, "x"), (2, "y"), (2, "z")], "k bigint, s string")
    assert bag(op.rowid_merge_join(l, "k", r, [F.col("o")], sides(["s"], ["name"]))) == [("x", "AA"), ("y", "CC"), ("z", "CC")]
    with pytest.raises(Exception, match="ERROR_FOREIGN_KEY_INVALID"):
        got(op.rowid_merge_join(frame([(5, "x")], "k bigint, s string"), "k", r, [F.col("o")], sides(["s"], ["name"])))


def test_foreign_filter(frame):
    keys = frame([(k,) for k in (1, 3, 5, 7, 9)], "k bigint")
    rows = frame([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (9, "e"), (10, "f")], "fk bigint, s string")
    assert bag(op.foreign_filter(keys, "k", "fk", rows)) == [(0, "a"), (1, "c"), (1, "d"), (4, "e")]


def test_sort_limit_and_case(frame):
    df = frame([(7, "b"), (None, "a"), (3, "A"), (7, "a")], "n int, s string")
    order = op.SortOrder().add(a("n"))
    assert [r[0] for r in got(op.sort(df, order))] == [None, 3, 7, 7]
    assert [r[0] for r in got(op.sort(df, op.SortOrder().add(a("n"), op.DESCENDING)))] == [7, 7, 3, None]
    ci = op.ExtendedSortSpecification().add("s", case_sensitive=False).add("n").set_limit(3)
    assert got(op.extended_sort(df, ci)) == [(None, "a"), (3, "A"), (7, "a")]
    assert code_of(lambda: op.extended_sort(df, op.ExtendedSortSpecification().add("s").add("s"))) == ReturnCode.ERROR_ATTRIBUTE_EXISTS
    assert got(op.limit(df, 1, 2, [F.col("n"), F.col("s")])) == [(3, "A"), (7, "a")]


def test_sort_permutation(frame):
    df = frame([(0, 30), (1, 10), (2, 20)], "i int, v int")
    assert bag(op.sort_permutation(df, op.SortOrder().add(a("v")), [F.col("i")])) == [(0, 1), (1, 2), (2, 0)]


def test_unions_and_zips(frame):
    x, y = frame([(1, "a"), (4, "d")], "n int, s string"), frame([(2, "b"), (4, "e"), (9, "z")], "m int, t string")
    assert [r[0] for r in got(op.merge_union_all([x, y], op.SortOrder().add(a("n"))))] == [1, 2, 4, 4, 9]
    assert bag(op.coalesce([(x, [F.col("n")]), (y, [F.col("m")])])) == [(1, "a", 2, "b"), (4, "d", 4, "e")]
    assert code_of(lambda: op.coalesce([(x, [F.col("n")]), (x, [F.col("n")])])) == ReturnCode.ERROR_ATTRIBUTE_EXISTS
    assert code_of(lambda: op.merge_union_all([x, x.select("s", "n")], op.SortOrder())) == ReturnCode.ERROR_ATTRIBUTE_TYPE_MISMATCH


def test_scan_with_selection(frame):
    df = frame([(i, i * 10) for i in range(5)], "i int, v int")
    ids = frame([(0, 3), (1, 3), (2, 0), (3, 99)], "position int, row_id bigint")
    assert got(op.scan_with_selection(df, [F.col("i")], ids)) == [(3, 30), (3, 30), (0, 0)]


def test_running_functions(frame):
    rows = [(0, None, False), (1, 5, False), (2, None, True), (3, 2, False), (4, 9, True), (5, 7, False), (6, 8, True)]
    df = frame(rows, "i int, v int, f boolean")
    order = [F.col("i")]
    by_i = lambda d: [r[1] for r in sorted(got(d.select("i", "r")))]
    assert by_i(op.sequence(df, order, "r")) == list(range(7))
    assert by_i(op.running_sum(df, "v", order, "r")) == [None, 5, 5, 7, 16, 23, 31]
    assert by_i(op.smudge(df, "v", order, "r")) == [None, 5, 5, 2, 9, 7, 8]
    assert by_i(op.running_min_with_flush(df, "f", "v", order, "r")) == [None, 5, 5, 2, 2, 7, 7]
    assert by_i(op.smudge_if(df, "v", "f", order, "r")) == [None, 5, 5, 2, 2, 7, 7]
    flags = frame([(0, 1), (1, 1), (2, 2), (3, 1)], "i int, v int")
    assert by_i(op.changed(flags, "v", order, "r")) == [True, False, True, True]
    assert got(op.running_sum(df.filter("i < 0"), "v", order, "r")) == []


def test_filter_and_compute(frame):
    df = frame([(1, True), (2, None), (3, False)], "n int, p boolean")
    assert got(op.filter_rows(df, a("p"), a("n"))) == [(1,)]
    assert code_of(lambda: op.filter_rows(df, a("n"))) == ReturnCode.ERROR_ATTRIBUTE_TYPE_MISMATCH
    assert op.compute(df, fn.Alias("x", fn.Plus(a("n"), a("n")))).columns == ["x"]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(str(tmp_path / "t"))
    df = op.filter_rows(sources.file_input(spark, str(tmp_path / "t")), fn.Greater(a("b"), fn.ConstInt64(100)), a("id"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(b), GreaterThan(b,100)]" in plan and "ReadSchema: struct<id:bigint,b:bigint>" in plan


def test_sources_and_sinks(spark, tmp_path):
    assert sources.generate(spark, 5).count() == 5
    schema = Schema([Attribute("n", INT32, False), Attribute("s", STRING)])
    t = sources.Table(spark, schema).append(1, "x").append(2, None)
    assert got(t.scan()) == [(1, "x"), (2, None)]
    assert code_of(lambda: t.append(1)) == ReturnCode.ERROR_ATTRIBUTE_COUNT_MISMATCH
    assert code_of(lambda: t.append(None, "x")) == ReturnCode.ERROR_INVALID_ARGUMENT_VALUE
    path = str(tmp_path / "out")
    sources.Writer(t.scan()).write_all(sources.FileSink(path))
    assert bag(sources.file_input(spark, path, schema)) == [(1, "x"), (2, None)]
    assert [tuple(r) for r in sources.Writer(t.scan()).rows()] == [(1, "x"), (2, None)]
    assert "1, x" in sources.printed(t.scan())
    assert [r[0] for r in got(sources.repeating_block(t.scan().select("n"), 5, [F.col("n")]))] == [1, 2, 1, 2, 1]
    assert code_of(lambda: sources.generate(spark, -1)) == ReturnCode.ERROR_INVALID_ARGUMENT_VALUE


def test_streams(spark, tmp_path):
    from skeinwork import streaming

    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string").write.parquet(folder)
    schema = Schema([Attribute("n", INT32), Attribute("s", STRING)])
    stream = op.filter_rows(streaming.stream_input(spark, folder, schema), fn.Greater(a("n"), fn.ConstInt32(1)))
    out = str(tmp_path / "out")
    streaming.stream_output(stream, sources.FileSink(out), str(tmp_path / "ck")).awaitTermination(60)
    assert got(spark.read.parquet(out)) == [(2, "b")]


def test_windowed_stream(spark, tmp_path):
    from datetime import datetime

    from skeinwork import streaming
    from skeinwork.types import DATETIME

    folder = str(tmp_path / "in")
    rows = [(datetime(2024, 1, 1, 0, m), "k", m) for m in (1, 2, 7)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k string, v int").write.parquet(folder)
    schema = Schema([Attribute("ts", DATETIME), Attribute("k", STRING), Attribute("v", INT32)])
    windows = streaming.windowed_aggregate(streaming.stream_input(spark, folder, schema), "ts", "5 minutes", "1 minute", ["k"], spec((op.COUNT, "", "n")))
    seen = []
    streaming.stream_output(windows, sources.CallbackSink(lambda df: seen.extend(r["n"] for r in df.collect())), str(tmp_path / "ck"), "complete").awaitTermination(60)
    assert sorted(seen) == [1, 2]


def test_serialized_expressions(spark):
    df = spark.createDataFrame([(5, "x")], "n int, s string")
    v, c = lambda n: {"variable": n}, lambda x, t: {"constant": x, "type": t}
    tree = {"operation": "ADD", "arguments": [v("n"), c(2, "INT32")], "alias": "y"}
    assert got(op.compute(df, serde.build(tree))) == [(7,)]
    assert got(op.compute(df, serde.build('{"operation": "REGEXP_FULL", "arguments": [{"variable": "s"}, {"constant": "x|y", "type": "STRING"}]}'))) == [(True,)]
    assert got(op.compute(df, serde.build({"operation": "CAST", "arguments": [c("DOUBLE", "STRING"), v("n")]}))) == [(5.0,)]
    for name in ("COPY", "ADD_WEEK", "TRUNC_TO_DAY"):
        assert code_of(lambda: serde.build({"operation": name, "arguments": [v("n")]})) == ReturnCode.ERROR_NOT_IMPLEMENTED
    for bad in ({"operation": "NOPE"}, {}, {"operation": "ADD", "arguments": [v("n")]}):
        assert code_of(lambda: serde.build(bad)) == ReturnCode.ERROR_BAD_PROTO


def test_ordinals_need_no_single_task(spark):
    df = spark.range(0, 1000, 1, 4).withColumn("k", F.expr("id * 7919 % 1000"))
    out = op.with_ordinal(df, [F.col("k")], "o")
    assert got(out.filter("o <> k")) == []
    assert "SinglePartition" not in op.with_ordinal(df, [F.col("k")], "o").select("k")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_reserved_names_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "i int, __skeinwork_range int")
    order = [F.col("i")]
    for make in (lambda: op.sequence(df, order), lambda: op.running_sum(df, "i", order, "r"), lambda: op.aggregate_clusters(df, ["i"], spec((op.COUNT, "", "n")), order)):
        assert code_of(make) == ReturnCode.ERROR_ATTRIBUTE_EXISTS
    plain = spark.createDataFrame([(1, 2), (1, 5), (3, 4)], "i int, __range int")
    assert code_of(lambda: op.sequence(plain, order, "__skeinwork_n")) == ReturnCode.ERROR_ATTRIBUTE_EXISTS
    assert code_of(lambda: op.aggregate_clusters(plain, ["i"], spec((op.SUM, "__range", "__skeinwork_cluster")), order)) == ReturnCode.ERROR_ATTRIBUTE_EXISTS
    # Names that only look like helpers are carried.
    assert bag(op.running_sum(plain, "__range", [F.col("i"), F.col("__range")], "r")) == [(1, 2, 2), (1, 5, 7), (3, 4, 11)]
    assert bag(op.aggregate_clusters(plain, ["i"], spec((op.SUM, "__range", "__cluster")), order)) == [(1, 7), (3, 4)]


def test_running_sums_wrap(frame):
    rows = [(i, 2**31 - 1, 2**63 - 1, 0.5) for i in range(5)]
    df = frame(rows, "i int, a int, b bigint, c double")
    by_i = lambda d: [r["r"] for r in d.orderBy("i").collect()]
    wrapped = lambda v, bits: [(v * (k + 1) + 2 ** (bits - 1)) % 2**bits - 2 ** (bits - 1) for k in range(5)]
    order = [F.col("i")]
    assert by_i(op.running_sum(df, "a", order, "r")) == wrapped(2**31 - 1, 32)
    assert by_i(op.running_sum(df, "b", order, "r")) == wrapped(2**63 - 1, 64)
    assert by_i(op.running_sum(df, "c", order, "r")) == [0.5, 1.0, 1.5, 2.0, 2.5]
    assert dict(op.running_sum(df, "b", order, "r").dtypes)["r"] == "bigint"


def test_best_effort_and_hybrid_groups(frame):
    df = frame([(i, i % 3, i) for i in range(30)], "i int, k int, v bigint")
    one = spec((op.COUNT, "", "n"), (op.SUM, "v", "s"))
    whole = [(k, 10, sum(range(k, 30, 3))) for k in range(3)]
    assert bag(op.hybrid_group_aggregate(df, ["k"], one)) == whole
    parts = op.best_effort_group_aggregate(df, ["k"], one)
    assert parts.columns == ["k", "n", "s"] and parts.count() <= 3 * df.rdd.getNumPartitions()
    assert bag(op.group_aggregate(parts, ["k"], spec((op.SUM, "n", "n"), (op.SUM, "s", "s")))) == whole
    assert bag(op.best_effort_group_aggregate(df, [], one)) == [(30, 435)]
    assert {r[0] for r in got(op.best_effort_group_aggregate(df, ["k"], op.AggregationSpecification()))} == {0, 1, 2}


def test_spy_and_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    watched, seen = op.spy(df, "rows")
    assert bag(op.filter_rows(watched, fn.Greater(a("k"), fn.ConstInt32(1)))) == [(2, None), (3, "c")]
    assert seen.get == {"rows": 3, "rows_with_nulls": 1}
    found = op.profile(op.group_aggregate(df, ["v"], spec((op.COUNT, "", "n"))))
    names = [name for _, name, _ in found]
    assert "Exchange" in names and any("Aggregate" in n for n in names) and found[0][0] == 0
    assert any(m.get("numOutputRows") == 3 for _, _, m in found)


def test_interrupt(spark):
    import threading
    import time

    stop = op.Interrupt(spark)
    slow = spark.range(4, numPartitions=4).selectExpr("java_method('java.lang.Thread', 'sleep', 60000L + id)")
    threading.Timer(3, stop.interrupt).start()
    began = time.time()

    def run():
        with op.interruptible(stop):
            slow.collect()

    assert code_of(run) == ReturnCode.INTERRUPTED and time.time() - began < 50
    assert code_of(run) == ReturnCode.INTERRUPTED
    assert spark.range(3).count() == 3

"""Small literal inputs: nulls, NaN, infinities, empty tables, order, errors, files."""

import datetime
import json
import math
import random
from dataclasses import dataclass

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.agg import count, count_non_null, max_, mean, min_, sum_
from millrace.functions.expr import compare, ieee_div, int_div
from millrace.operators import aggregate as A
from millrace.operators import inspect as M
from millrace.operators import joins as J
from millrace.operators import order as O
from millrace.operators import rows as R
from millrace.schema import ColumnDef, Schema
from millrace.sources import csv as C
from millrace.sources import tables as S
from millrace.streaming import iterate as I


def values(df):
    return [tuple(r) for r in df.collect()]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Berlin"), (2, "Munich"), (3, "Berlin")], "Id int, City string")
    assert values(R.where_value(df, "City", "==", "Berlin").select("Id")) == [(1,), (3,)]
    assert values(R.where(df, lambda r: r["Id"] > 2, ["Id"])) == [(3, "Berlin")]
    nulls = spark.createDataFrame([(10,), (None,), (20,)], "Id int")
    assert values(R.where_value(nulls, "Id", "!=", 5)) == [(10,), (20,)]
    with pytest.raises(KeyError):
        R.where_value(df, "city", "==", "x")


@pytest.mark.parametrize("op", ["==", "!=", ">", ">=", "<", "<="])
def test_nan_compares_as_ieee(spark, op):
    numbers = [1.0, math.nan, -math.inf, math.inf, None, 0.0]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    import operator

    ops = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
    for limit in (0.0, math.inf, math.nan):
        got = values(df.filter(compare(F.col("v"), op, limit, True)))
        want = [(v,) for v in numbers if v is not None and ops[op](v, limit)]
        assert repr(got) == repr(want)


def test_filter_reaches_the_scan(spark, tmp_path):
    S.write_parquet(spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string"), str(tmp_path / "t"))
    df = R.where_value(S.read_parquet(spark, str(tmp_path / "t")), "b", ">", 1.0).select("a")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,1.0)" in plan and "c#" not in plan


def test_division(spark):
    df = spark.createDataFrame([(10.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (9.0, 2.0)], "a double, b double")
    assert repr([r[0] for r in values(df.select(ieee_div(F.col("a"), F.col("b"))))]) == repr([math.inf, -math.inf, math.nan, None, None, 4.5])
    ints = spark.createDataFrame([(7, 2), (-7, 2)], "a int, b int")
    assert values(ints.select(int_div(F.col("a"), F.col("b")))) == [(3,), (-3,)]
    with pytest.raises(Exception, match="(?i)zero"):
        ints.select(int_div(F.col("a"), 0)).collect()


def test_arithmetic_nulls_and_price(spark):
    df = spark.createDataFrame([(10.0, 2.0), (10.0, None), (None, 5.0)], "p double, q double")
    assert [r[0] for r in values(df.select(F.col("p") * F.col("q")))] == [20.0, None, None]
    prices = spark.createDataFrame([(100.0, 0.1, 0.19), (50.0, 0.0, 0.07)], "p double, d double, t double")
    assert [round(r[0], 6) for r in values(prices.select(F.col("p") * (1 - F.col("d")) * (1 + F.col("t"))))] == [107.1, 53.5]


def test_columns(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert R.add_column(df, "z", F.col("x") + 1).columns == ["x", "y", "z"]
    assert values(R.add_column(df, "z", lambda r: r["y"] * 2, T.StringType(), ["y"])) == [(1, "a", "aa")]
    with pytest.raises(ValueError):
        R.add_column(df, "x", F.lit(1))
    with pytest.raises(ValueError):
        R.rename(df, "x", "y")
    dotted = spark.createDataFrame([(1, None)], "`a.b` int, `c d` string")
    assert values(R.drop_nulls(dotted)) == [] and values(R.select(dotted, "a.b")) == [(1,)]


def test_joins(spark):
    left = spark.createDataFrame([(1, 100), (2, 200), (3, 100), (4, None)], "EmpId int, DeptId int")
    right = spark.createDataFrame([(100, "IT"), (300, "HR"), (None, "none")], "DeptId int, DeptName string")
    assert sorted(values(J.join(left, right, "DeptId"))) == [(1, 100, "IT"), (3, 100, "IT")]
    assert sorted(values(J.join(left, right, "DeptId", "left"))) == [(1, 100, "IT"), (2, 200, None), (3, 100, "IT"), (4, None, None)]
    many = spark.createDataFrame([(100, "M1"), (100, "M2")], "DeptId int, V string")
    assert J.join(left, many, "DeptId").count() == 4
    with pytest.raises(ValueError):
        J.join(left, left, "DeptId")
    with pytest.raises(ValueError):
        J.join(left, right, "DeptId", "full")
    nan = spark.createDataFrame([(math.nan, 1)], "k double, v int")
    assert J.join(nan, nan.withColumnRenamed("v", "w"), "k").count() == 1


def test_whole_table_aggregates(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (None,), (5.0,)], "v double")
    assert (A.total(df, "v"), A.least(df, "v"), A.largest(df, "v")) == (35.0, 5.0, 20.0) and abs(A.average(df, "v") - 35 / 3) < 1e-12
    nothing = df.filter("v > 100")
    assert [f(nothing, "v") for f in (A.total, A.least, A.largest, A.average)] == [0.0] * 4
    nan = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "v double")
    assert math.isnan(A.total(nan, "v")) and A.largest(nan, "v") == 2.0 and A.least(nan, "v") == 1.0
    with pytest.raises(TypeError):
        A.total(spark.createDataFrame([("a",)], "v string"), "v")


@pytest.mark.parametrize(("items", "any_", "all_"), [([False, False], False, False), ([True, None], True, True), ([True, None, False], True, False), ([], False, True), ([None], False, True)])
def test_booleans(spark, items, any_, all_):
    df = spark.createDataFrame([(v,) for v in items], "b boolean")
    assert A.any_true(df, "b").first()[0] is any_ and A.all_true(df, "b").first()[0] is all_


def test_groups(spark):
    df = spark.createDataFrame([("A", 10), (None, 1), ("A", None), ("A", 5), (None, 2)], "g string, v int")
    out = {r[0]: tuple(r)[1:] for r in A.group_by(df, "g").aggregate(sum_("v"), min_("v"), max_("v"), mean("v"), count(), count_non_null("v")).collect()}
    assert out == {"A": (15.0, 5, 10, 7.5, 3, 2), None: (3.0, 1, 2, 1.5, 2, 2)}
    empty = spark.createDataFrame([(1, None), (1, None)], "g int, v int")
    assert values(A.group_by(empty, "g").aggregate(sum_("v"), min_("v"), count())) == [(1, 0.0, None, 2)]
    assert A.group_by(df, "g").aggregate(sum_("v"), count()).columns == ["g", "sum_v", "count"]
    nan = spark.createDataFrame([(math.nan,), (math.nan,), (1.0,)], "v double")
    assert A.group_by(nan, "v").group_count() == 2
    two = spark.createDataFrame([("A", None), ("A", None), ("A", 0), ("B", 1)], "c string, s int")
    assert sorted(values(A.group_by(two, "c", "s").count()), key=repr) == [("A", 0, 1), ("A", None, 2), ("B", 1, 1)]
    assert values(A.group_by(df.filter("false"), "g").count()) == []
    with pytest.raises(ValueError):
        A.group_by(df)


def test_groups_against_python(spark):
    random.seed(3)
    rows = [(random.choice([None, *range(-20, 20), 2_000_000]), random.choice([None, *range(50)])) for _ in range(5000)]
    want: dict = {}
    for g, v in rows:
        s = want.setdefault(g, [0.0, 0])
        s[0] += v or 0
        s[1] += 1
    got = {r[0]: [r[1], r[2]] for r in A.group_by(spark.createDataFrame(rows, "g int, v int"), "g").aggregate(sum_("v"), count()).collect()}
    assert got == want


def test_order(spark):
    df = spark.createDataFrame([(10,), (None,), (5,)], "v int")
    assert [r[0] for r in values(O.order_by(df, "v"))] == [None, 5, 10]
    assert [r[0] for r in values(O.order_by(df, "v", ascending=False))] == [10, 5, None]
    doubles = spark.createDataFrame([(1.0,), (math.nan,), (None,), (-math.inf,)], "v double")
    assert repr([r[0] for r in values(O.order_by(doubles, "v"))]) == repr([None, math.nan, -math.inf, 1.0])
    assert repr([r[0] for r in values(O.order_by(doubles, "v", ascending=False))]) == repr([1.0, -math.inf, math.nan, None])
    mixed = spark.createDataFrame([("IT", 1000), ("IT", 5000), ("HR", 2000)], "d string, s int")
    assert values(O.order_by(mixed, "d", "s", ascending=[True, False])) == [("HR", 2000), ("IT", 5000), ("IT", 1000)]
    strings = spark.createDataFrame([("B",), ("a",), (None,), ("AA",), ("A",)], "s string")
    assert [r[0] for r in values(O.order_by(strings, "s"))] == [None, "A", "AA", "B", "a"]
    with pytest.raises(ValueError):
        O.order_by(mixed, "d", "s", ascending=[True])


def test_top_and_slices(spark):
    df = O.with_row_id(spark.createDataFrame([(50,), (10,), (None,), (100,), (5,), (20,)], "v int"))
    assert [r[0] for r in values(O.smallest(df, 3, "v"))] == [5, 10, 20]
    assert [r[0] for r in values(O.largest_rows(df, 2, "v"))] == [100, 50]
    assert values(O.smallest(df, 0, "v")) == [] and len(values(O.smallest(df, 99, "v"))) == 5
    numbers = spark.createDataFrame([(i, 10 * i) for i in range(5)], "row_id long, n int")
    assert [r[1] for r in values(O.slice_rows(numbers, 1, 2, "row_id"))] == [10, 20]
    assert values(O.slice_rows(numbers, 9, 2, "row_id")) == [] and len(values(O.slice_rows(numbers, 3, 9, "row_id"))) == 2
    assert [r[1] for r in values(O.head(numbers, 2, "row_id"))] == [0, 10] and [r[1] for r in values(O.tail(numbers, 2, "row_id"))] == [30, 40]
    with pytest.raises(ValueError):
        O.slice_rows(numbers, -1, 2, "row_id")


def test_distinct_and_cleaning(spark):
    df = spark.createDataFrame([(0, "X", 10), (1, "X", 99), (2, "Y", None), (3, "Y", 1), (4, None, 2)], "row_id long, g string, v int")
    assert sorted(values(O.distinct(df, "g", row_id="row_id").select("g", "v")), key=repr) == [("X", 10), ("Y", None), (None, 2)]
    assert O.distinct(df.select("g")).count() == 3
    assert O.distinct(spark.createDataFrame([(math.nan,), (math.nan,), (None,), (None,)], "v double")).count() == 2
    nulls = spark.createDataFrame([(1, "a", math.nan), (None, "b", 1.0), (2, None, 1.0)], "a int, b string, c double")
    assert [r[0] for r in values(R.drop_nulls(nulls))] == [1]
    floats = spark.createDataFrame([(1.5,), (None,), (math.nan,)], "v double")
    assert repr([r[0] for r in values(R.fill_null(floats, "v", 0.0))]) == repr([1.5, 0.0, math.nan])
    with pytest.raises(TypeError):
        R.fill_null(floats, "v", "x")


def test_categories(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["B", "A", None, "B", "C"])], "row_id long, s string")
    assert sorted(values(O.category_codes(df, "s", "row_id"))) == [(0, "B", 1), (1, "A", 2), (2, None, 0), (3, "B", 1), (4, "C", 3)]


def test_schema():
    schema = Schema([ColumnDef("Count", "int"), ColumnDef("IsActive", "bool", True, 3)])
    back = Schema.from_json(schema.to_json())
    assert [(c.name, c.type, c.nullable, c.source_index) for c in back.columns] == [("Count", "int", False, None), ("IsActive", "bool", True, None)]
    assert json.loads(schema.to_json())[0]["name"] == "Count" and "count" not in schema and schema.index("IsActive") == 1
    with pytest.raises(ValueError):
        Schema([ColumnDef("a", "int"), ColumnDef("a", "int")])
    with pytest.raises(KeyError):
        schema["nope"]
    with pytest.raises(TypeError):
        Schema([ColumnDef("a", "decimal")]).struct()


@dataclass
class Person:
    Id: int
    Name: str
    Score: float | None
    Created: datetime.datetime
    IsActive: bool
    Tags: list[str]


def people():
    when = datetime.datetime(2023, 10, 5, 12, 30)
    return [Person(1, "Alice", 99.5, when, True, []), Person(2, "Bob", None, when, False, [])]


def test_objects(spark):
    df = S.from_objects(spark, people())
    assert df.columns == ["Id", "Name", "Score", "Created", "IsActive"] and values(df)[1][2] is None
    assert [b.count() for b in S.object_batches(spark, people() * 5, 3)] == [3, 3, 3, 1]
    assert list(S.object_batches(spark, [], 3)) == []
    with pytest.raises(ValueError):
        S.object_batches(spark, people(), 0)
    assert S.empty(spark, Schema.from_class(Person)).count() == 0


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    simple = write(tmp_path / "a.csv", 'Id,Name,Score\n1, Alice ,99.5\n2,"Bob, ""B""",\n')
    schema = Schema([ColumnDef("Id", "int"), ColumnDef("Name", "string", True), ColumnDef("Score", "double", True)])
    assert values(C.read_csv(spark, simple, schema)) == [(1, "Alice", 99.5), (2, 'Bob, "B"', None)]
    moved = Schema([ColumnDef("Score", "double", True, 2), ColumnDef("Id", "int", False, 0)])
    assert values(C.read_csv(spark, simple, moved)) == [(99.5, 1), (None, 2)]
    strict = Schema([ColumnDef("Id", "int"), ColumnDef("Name", "string"), ColumnDef("Score", "double")])
    with pytest.raises(Exception, match="not nullable"):
        C.read_csv(spark, simple, strict).collect()
    blank = write(tmp_path / "b.csv", "Val\n100\n\n200\n")
    one = Schema([ColumnDef("Val", "int", True)])
    assert values(C.read_csv(spark, blank, one, C.CsvRead(keep_blank_lines=True))) == [(100,), (None,), (200,)]
    assert values(C.read_csv(spark, blank, one)) == [(100,), (200,)]
    loose = write(tmp_path / "c.csv", "a,b\n1,x\n\nbad,y\n3\n4,z\n")
    assert values(C.read_csv_lenient(spark, loose, Schema([ColumnDef("a", "int"), ColumnDef("b", "string")]))) == [(1, "x"), (0, "y"), (4, "z")]
    ten = write(tmp_path / "d.csv", "Id,Val\n" + "".join(f"{i},{i * i}\n" for i in range(10)))
    assert [b.count() for b in C.read_csv_batches(spark, ten, Schema([ColumnDef("Id", "int"), ColumnDef("Val", "int")]), 3)] == [3, 3, 3, 1]


def test_csv_inference(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Age,Weight,Name,Mixed,When,Flag,Gap\n25,80.5,Alice,100,2023-01-05,true,1\n30,90,Bob,Hello,2023-01-06 10:00:00,False,\n")
    found = C.infer_schema(spark, path)
    assert [(c.name, c.type, c.nullable) for c in found.columns] == [("Age", "int", False), ("Weight", "double", False), ("Name", "string", False), ("Mixed", "string", False), ("When", "timestamp", False), ("Flag", "bool", False), ("Gap", "int", True)]
    assert [c.source_index for c in found.columns] == list(range(7))
    bare = C.infer_schema(spark, write(tmp_path / "b.csv", "1,x\n"), C.CsvRead(header=False))
    assert [c.name for c in bare.columns] == ["Column0", "Column1"]


def test_csv_round_trip(spark, tmp_path):
    when = datetime.datetime(2023, 10, 5, 12, 30, 1, 250)
    df = spark.createDataFrame([(when, 'Hello, "World"', True), (None, None, False)], "Date timestamp_ntz, Note string, Ok boolean")
    C.write_csv(df, str(tmp_path / "t"), C.CsvWrite(single_file=True))
    schema = Schema([ColumnDef("Date", "timestamp", True), ColumnDef("Note", "string", True), ColumnDef("Ok", "bool", True)])
    assert values(C.read_csv(spark, str(tmp_path / "t"), schema)) == values(df)
    text = next((tmp_path / "t").glob("*.csv")).read_text()
    assert "True" in text and '"Hello, ""World"""' in text


def test_parquet_and_arrow(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.5, "Alice"), (2, None, "Bob")], "Id int, Value double, Name string")
    S.write_parquet(df, str(tmp_path / "t"))
    assert sorted(values(S.read_parquet(spark, str(tmp_path / "t")))) == values(df)
    assert [b.count() for b in S.read_parquet_batches(spark, str(tmp_path / "t"), 1)] == [1, 1]
    data = pa.table({"Id": pa.array([1, 2], pa.int32()), "Day": pa.array([datetime.date(2024, 1, 2), None]), "Flag": [True, None], "Text": ["a", "b"]})
    back = S.from_arrow(spark, data)
    assert dict(back.dtypes)["Day"].startswith("timestamp") and values(back.select("Id", "Flag", "Text")) == [(1, True, "a"), (2, None, "b")]
    assert S.to_arrow(df).num_rows == 2


def test_iteration(spark, tmp_path):
    df = spark.createDataFrame([("X", 10), ("X", 20), ("Y", 5)], "Grp string, Val int")
    assert {r["Grp"]: r["sum_Val"] for r in I.rows(A.group_by(df, "Grp").aggregate(sum_("Val")))} == {"X": 30.0, "Y": 5.0}
    assert {r[0]: r[1] for r in A.group_by(df, "Grp").count_stream()} == {"X": 2, "Y": 1}
    S.write_parquet(df.repartition(3), str(tmp_path / "in"))
    seen = []
    I.run_to_end(I.file_stream(spark, str(tmp_path / "in"), df.schema), lambda b, _: seen.extend(map(tuple, b.collect())), str(tmp_path / "c"))
    assert sorted(seen) == sorted(values(df))


def test_inspect(spark):
    df = spark.createDataFrame([(i, None if i else "a") for i in range(3)], "Id int, Name string")
    text = M.inspect(df, 2)
    assert "<int>" in text and "null" in text and text.endswith("... (1 more rows)")
    assert M.shape(df) == (3, 2) and M.has_column(df, "Id") and not M.has_column(df, "id") and isinstance(M.column_type(df, "Id"), T.IntegerType) and M.column_names(df) == ["Id", "Name"]


def test_places_of_all_rows(spark):
    rows = [(i, None if i % 11 == 0 else float("nan") if i % 7 == 0 else float(i % 5)) for i in range(500)]
    key = lambda r: (r[1] is not None, r[1] is not None and r[1] == r[1], r[1] if r[1] is not None and r[1] == r[1] else 0.0)
    df = spark.createDataFrame(rows, "k long, v double")
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (key(r), -r[0])), 1)}
    assert {r["k"]: r["place"] for r in O.with_place(df, "v", "k", ascending=[True, False]).collect()} == want
    want = {r[0]: n for n, r in enumerate(sorted(sorted(rows, key=lambda r: r[0]), key=key, reverse=True), 1)}
    down = O.with_place(df, "v", "k", ascending=[False, True])
    assert O.with_place(df.filter("false"), "v", "k").count() == 0
    assert {r["k"]: r["place"] for r in down.collect()} == want
    assert "TakeOrdered" not in down._jdf.queryExecution().executedPlan().toString()


def test_counts_are_longs_unless_ints_are_asked_for(spark):
    grouped = A.group_by(spark.createDataFrame([(1,), (1,), (2,)], "g int"), "g")
    assert dict(grouped.count().dtypes)["Count"] == "bigint" and dict(grouped.aggregate(count()).dtypes)["count"] == "bigint"
    assert sorted(values(grouped.count(as_int=True))) == [(1, 2), (2, 1)] and dict(grouped.count(as_int=True).dtypes)["Count"] == "int"


def test_only_the_first_line_is_a_header(spark, tmp_path):
    for name, rows in (("a", "1,x\na,b\n2,y"), ("b", "a,b\n3,z")):
        (tmp_path / f"{name}.csv").write_text(f"a,b\n{rows}\n")
    schema = Schema([ColumnDef("a", "string", True), ColumnDef("b", "string", True)])
    want = sorted([("1", "x"), ("a", "b"), ("2", "y"), ("a", "b"), ("3", "z")])
    assert sorted(values(C.read_csv_lenient(spark, str(tmp_path), schema))) == want
    assert sorted(values(C.read_csv(spark, str(tmp_path), schema, C.CsvRead(keep_blank_lines=True)))) == want


def test_quoted_line_ends_need_multi_line(spark, tmp_path):
    df = spark.createDataFrame([(1, "x\ny"), (2, "z")], "a int, b string")
    C.write_csv(df, str(tmp_path / "out"))
    schema = Schema([ColumnDef("a", "int", True), ColumnDef("b", "string", True)])
    assert sorted(values(C.read_csv(spark, str(tmp_path / "out"), schema, C.CsvRead(multi_line=True)))) == [(1, "x\ny"), (2, "z")]

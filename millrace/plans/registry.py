"""The registered queries of the library's own operators, with their DuckDB twins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.agg import count, max_, mean, min_, sum_
from ..functions.expr import ieee_div, int_div, lit
from ..operators import aggregate as A
from ..operators import inspect as M
from ..operators import joins as J
from ..operators import order as O
from ..operators import rows as R
from ..schema import ColumnDef, Schema
from ..sources import csv as C
from ..sources import json as N
from ..sources import tables as S
from ..streaming import iterate as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLE_SQL[key] = sql
        return function

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession) -> str:
    """A new path in the folder that executors share (spark.checkpoint.dir); where it is unset, a local one on one machine (tests), else an error."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder and not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{folder or 'file://' + tempfile.mkdtemp(prefix='millrace-')}/{uuid.uuid4().hex}"


# Whole queries


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc,
       CAST(count(*) AS INT) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
""")
def tpch_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = R.where_value(t(spark, sf_dir, "lineitem"), "l_shipdate", "<=", lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    priced = items.select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", disc.alias("disc_price"), (disc * (1 + F.col("l_tax"))).alias("charge"))
    aggs = [sum_("l_quantity").alias("sum_qty"), sum_("l_extendedprice").alias("sum_base_price"), sum_("disc_price").alias("sum_disc_price"), sum_("charge").alias("sum_charge"), mean("l_quantity").alias("avg_qty"), mean("l_extendedprice").alias("avg_price"), mean("l_discount").alias("avg_disc"), count(as_int=True).alias("count_order")]
    out = A.group_by(priced, "l_returnflag", "l_linestatus").aggregate(*aggs)
    digits = {"sum_qty": 2, "sum_base_price": 2, "sum_disc_price": 2, "sum_charge": 2, "avg_qty": 4, "avg_price": 4, "avg_disc": 4}
    return O.order_by(out.withColumns({c: F.round(c, n) for c, n in digits.items()}), "l_returnflag", "l_linestatus")


@query("""
SELECT p_type, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity > 25 GROUP BY p_type ORDER BY revenue DESC
""")
def join_group_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = R.where_value(t(spark, sf_dir, "lineitem"), "l_quantity", ">", 25.0).select(F.col("l_partkey").alias("partkey"), "l_extendedprice")
    joined = J.join(items, t(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_type"), "partkey")
    out = A.group_by(joined, "p_type").sum("l_extendedprice", "revenue").withColumn("revenue", F.round("revenue", 2))
    return O.order_by(out, "revenue", ascending=False)


# Sources and sinks


@query("SELECT * FROM region")
def scan_parquet(spark, sf_dir):
    return S.read_parquet(spark, f"{sf_dir}/region.parquet")


NATION = Schema([ColumnDef("n_nationkey", "int"), ColumnDef("n_name", "string"), ColumnDef("n_regionkey", "int")])


def nation_csv(spark, sf_dir) -> str:
    path = place(spark)
    C.write_csv(t(spark, sf_dir, "nation"), path)
    return path


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf_dir):
    return C.read_csv(spark, nation_csv(spark, sf_dir), NATION)


@query("SELECT n_name, n_nationkey FROM nation")
def csv_projection_reorder(spark, sf_dir):
    return C.read_csv(spark, nation_csv(spark, sf_dir), Schema([ColumnDef("n_name", "string", source_index=1), ColumnDef("n_nationkey", "int", source_index=0)]))


class Nation:
    n_nationkey: int
    n_name: str
    n_regionkey: int


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_typed(spark, sf_dir):
    return C.read_csv(spark, nation_csv(spark, sf_dir), Nation)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_infer(spark, sf_dir):
    path = nation_csv(spark, sf_dir)
    return C.read_csv(spark, path, C.infer_schema(spark, path))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_lenient(spark, sf_dir):
    return C.read_csv_lenient(spark, nation_csv(spark, sf_dir), NATION)


@query("SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_types_roundtrip(spark, sf_dir):
    path = place(spark)
    C.write_csv(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"), path, C.CsvWrite(separator="|"))
    schema = Schema([ColumnDef("o_orderkey", "long", True), ColumnDef("o_totalprice", "double", True), ColumnDef("o_orderdate", "timestamp", True), ColumnDef("o_orderpriority", "string", True)])
    return C.read_csv(spark, path, schema, C.CsvRead(separator="|"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def json_roundtrip(spark, sf_dir):
    """An extension: JSON lines."""
    path = place(spark)
    N.write_json(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"), path)
    return N.read_json(spark, path, Schema([ColumnDef("o_orderkey", "long", True), ColumnDef("o_totalprice", "double", True), ColumnDef("o_orderdate", "timestamp", True), ColumnDef("o_orderpriority", "string", True)]))


def batch_sizes(spark, batches) -> DataFrame:
    return spark.createDataFrame([(i, b.count()) for i, b in enumerate(batches)], "batch int, n long")


SIZES_SQL = "SELECT CAST(i AS INT) AS batch, CAST(least(10, n - 10 * i) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM nation), range(100) r(i) WHERE 10 * i < n"


@query(SIZES_SQL)
def csv_batches(spark, sf_dir):
    return batch_sizes(spark, C.read_csv_batches(spark, nation_csv(spark, sf_dir), NATION, 10))


@query(SIZES_SQL)
def parquet_batches(spark, sf_dir):
    return batch_sizes(spark, S.read_parquet_batches(spark, f"{sf_dir}/nation.parquet", 10))


@query(SIZES_SQL)
def object_batches(spark, sf_dir):
    return batch_sizes(spark, S.object_batches(spark, I.rows(t(spark, sf_dir, "nation")), 10, NATION))


@query("SELECT * FROM supplier")
def parquet_roundtrip(spark, sf_dir):
    path = place(spark)
    S.write_parquet(t(spark, sf_dir, "supplier"), path)
    return S.read_parquet(spark, path)


@query("SELECT * FROM nation")
def arrow_roundtrip(spark, sf_dir):
    return S.from_arrow(spark, S.to_arrow(t(spark, sf_dir, "nation")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def from_objects(spark, sf_dir):
    return S.from_objects(spark, I.rows(t(spark, sf_dir, "nation")), NATION)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE false")
def empty_frame(spark, sf_dir):
    return S.empty(spark, NATION)


# Projection and expressions


@query("SELECT c_name, c_custkey FROM customer")
def select_cols(spark, sf_dir):
    return R.select(t(spark, sf_dir, "customer"), "c_name", "c_custkey")


@query("SELECT o_orderkey AS key, o_totalprice + 1 AS price FROM orders")
def select_exprs(spark, sf_dir):
    return R.select(t(spark, sf_dir, "orders"), F.col("o_orderkey").alias("key"), (F.col("o_totalprice") + 1).alias("price"))


@query("SELECT r_name, 99 AS constant, 'x' AS letter, true AS yes, CAST(NULL AS INT) AS nothing FROM region")
def literal_col(spark, sf_dir):
    return t(spark, sf_dir, "region").select("r_name", lit(99).alias("constant"), lit("x").alias("letter"), lit(True).alias("yes"), lit(None).alias("nothing"))


@query("SELECT o_orderkey, o_totalprice * 1.5::DOUBLE AS x FROM orders")
def arith_double(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 1.5).alias("x"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_extendedprice AS a, l_extendedprice - l_tax AS b, l_quantity * l_discount AS c FROM lineitem")
def arith_columns(spark, sf_dir):
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q + e).alias("a"), (e - F.col("l_tax")).alias("b"), (q * F.col("l_discount")).alias("c"))


@query("SELECT p_partkey, CAST(p_size // 7 AS INT) AS q FROM part")
def arith_int_div(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", int_div(F.col("p_size"), 7).alias("q"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Infinity'::DOUBLE ELSE p_retailprice END AS q FROM part")
def ieee_division(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", ieee_div(F.col("p_retailprice"), F.col("p_size") % 2).alias("q"))


@query("SELECT p_partkey, 100 - p_size AS r FROM part")
def scalar_left_sub(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", (100 - F.col("p_size")).alias("r"))


@query("SELECT p_partkey, NULLIF(p_size, 10) + 1 AS a FROM part")
def arith_null(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", (F.nullif("p_size", F.lit(10)) + 1).alias("a"))


@query("SELECT p_partkey, p_size > 25 AS large FROM part")
def compare_project(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).alias("large"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS price FROM lineitem")
def price_formula(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("price"))


@query("SELECT c_custkey, c_nationkey * 2 AS twice FROM customer")
def add_column(spark, sf_dir):
    return R.add_column(t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "twice", F.col("c_nationkey") * 2).drop("c_nationkey")


@query("SELECT c_custkey, c_mktsegment || '_' || c_name AS tag FROM customer")
def add_column_udf(spark, sf_dir):
    return R.add_column(t(spark, sf_dir, "customer"), "tag", lambda r: f"{r['c_mktsegment']}_{r['c_name']}", T.StringType(), ["c_mktsegment", "c_name"]).select("c_custkey", "tag")


@query("SELECT c_custkey, c_mktsegment || '_' || c_name AS tag FROM customer")
def str_concat(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("_", "c_mktsegment", "c_name").alias("tag"))


@query("SELECT r_regionkey, r_name AS region_name FROM region")
def rename(spark, sf_dir):
    return R.rename(t(spark, sf_dir, "region"), "r_name", "region_name")


# Filters


def filter_query(name: str, op: str, sql: str) -> None:
    @query(f"SELECT p_partkey, p_size FROM part WHERE p_size {sql} 25", f"filter_{name}")
    def run(spark, sf_dir):
        return R.where_value(t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", op, 25)


for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("gt", ">", ">"), ("ge", ">=", ">="), ("lt", "<", "<"), ("le", "<=", "<=")):
    filter_query(_name, _op, _sql)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000.5")
def filter_double(spark, sf_dir):
    return R.where_value(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ">=", 150000.5)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1998-09-02'")
def filter_date(spark, sf_dir):
    return R.where_value(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "<=", lit("1998-09-02").cast("timestamp_ntz"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_string(spark, sf_dir):
    return R.where_value(t(spark, sf_dir, "customer"), "c_mktsegment", "==", "BUILDING").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE (p_size > 10 AND p_retailprice < 1200) OR NOT (p_size <= 45)")
def filter_compound(spark, sf_dir):
    size = F.col("p_size")
    return R.where(t(spark, sf_dir, "part"), ((size > 10) & (F.col("p_retailprice") < 1200)) | ~(size <= 45)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NULLIF(p_size, 10) <> 5")
def filter_ne_nulls(spark, sf_dir):
    df = t(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("size"))
    return R.where_value(df, "size", "!=", 5).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NULLIF(p_size, 10) IS NULL")
def filter_is_null(spark, sf_dir):
    df = t(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("size"))
    return R.where(df, F.col("size").isNull()).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice > l_quantity * 1000")
def filter_columns(spark, sf_dir):
    return R.where(t(spark, sf_dir, "lineitem"), F.col("l_extendedprice") > F.col("l_quantity") * 1000).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_mktsegment LIKE 'A%'")
def filter_udf(spark, sf_dir):
    return R.where(t(spark, sf_dir, "customer"), lambda r: r["c_acctbal"] > 1000 and r["c_mktsegment"].startswith("A"), ["c_acctbal", "c_mktsegment"]).select("c_custkey")


# Joins


@query("SELECT c_custkey AS custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(spark, sf_dir):
    left = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return J.join(left, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice"), "custkey")


@query("SELECT o_orderkey AS orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(spark, sf_dir):
    left = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderstatus")
    return J.join(left, t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_quantity"), "orderkey", "left")


@query("SELECT s_suppkey, k, n_name FROM (SELECT s_suppkey, NULLIF(s_nationkey, 3) AS k FROM supplier) LEFT JOIN (SELECT NULLIF(n_nationkey, 4) AS k2, n_name FROM nation) ON k = k2")
def join_null_keys(spark, sf_dir):
    left = t(spark, sf_dir, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("k"))
    return J.join(left, t(spark, sf_dir, "nation").select(F.nullif("n_nationkey", F.lit(4)).alias("k"), "n_name"), "k", "left")


@query("SELECT c.c_mktsegment AS seg, count(*) AS n FROM customer c JOIN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 9000) d ON c.c_mktsegment = d.c_mktsegment GROUP BY 1")
def join_string_key(spark, sf_dir):
    seg = F.col("c_mktsegment").alias("seg")
    customer = t(spark, sf_dir, "customer")
    joined = J.join(customer.select(seg, "c_custkey"), R.where_value(customer, "c_acctbal", ">", 9000.0).select(seg).distinct(), "seg")
    return joined.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))


# Whole-table aggregates


def aggregate_query(name: str, agg: Callable, sql: str) -> None:
    @query(f"SELECT round(COALESCE({sql}(o_totalprice), 0), 2) AS value FROM orders", f"agg_{name}")
    def run(spark, sf_dir):
        return A.scalar(t(spark, sf_dir, "orders"), agg("o_totalprice")).select(F.round("value", 2).alias("value"))

    @query(f"SELECT CAST(COALESCE({sql}(p_size), 0) AS DOUBLE) AS value FROM part WHERE p_size < 0", f"agg_empty_{name}")
    def run_empty(spark, sf_dir):
        return A.scalar(R.where_value(t(spark, sf_dir, "part"), "p_size", "<", 0), agg("p_size"))


for _name, _agg, _sql in (("sum", sum_, "sum"), ("min", min_, "min"), ("max", max_, "max"), ("mean", mean, "avg")):
    aggregate_query(_name, _agg, _sql)


@query("SELECT CAST(sum(p_size) AS DOUBLE) AS value FROM part")
def agg_sum_int(spark, sf_dir):
    return A.scalar(t(spark, sf_dir, "part"), sum_("p_size"))


@query("SELECT bool_or(p_size = 7) AS value FROM part")
def any_true(spark, sf_dir):
    return A.any_true(t(spark, sf_dir, "part").select((F.col("p_size") == 7).alias("b")), "b")


@query("SELECT bool_and(p_size < 51) AS value FROM part")
def all_true(spark, sf_dir):
    return A.all_true(t(spark, sf_dir, "part").select((F.col("p_size") < 51).alias("b")), "b")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


# Grouped aggregates


def grouped_query(kind: str, sql: str, name: str) -> None:
    @query(f"SELECT l_returnflag, {sql} FROM lineitem GROUP BY l_returnflag", f"group_{kind}")
    def run(spark, sf_dir):
        grouped = A.group_by(t(spark, sf_dir, "lineitem"), "l_returnflag")
        out = grouped.count(as_int=True) if kind == "count" else getattr(grouped, kind)("l_extendedprice")
        return out if kind == "count" else out.withColumn(name, F.round(name, 2))


for _kind, _sql, _name in (
    ("count", 'CAST(count(*) AS INT) AS "Count"', "Count"),
    ("sum", 'round(sum(l_extendedprice), 2) AS "Sum_l_extendedprice"', "Sum_l_extendedprice"),
    ("min", 'round(min(l_extendedprice), 2) AS "Min_l_extendedprice"', "Min_l_extendedprice"),
    ("max", 'round(max(l_extendedprice), 2) AS "Max_l_extendedprice"', "Max_l_extendedprice"),
    ("mean", 'round(avg(l_extendedprice), 2) AS "Mean_l_extendedprice"', "Mean_l_extendedprice"),
):
    grouped_query(_kind, _sql, _name)


@query("""SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum_o_totalprice, round(avg(o_totalprice), 4) AS avg_o_totalprice,
min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, CAST(count(*) AS INT) AS count FROM orders GROUP BY o_orderpriority""")
def group_multi_agg(spark, sf_dir):
    c = "o_totalprice"
    out = A.group_by(t(spark, sf_dir, "orders"), "o_orderpriority").aggregate(sum_(c), mean(c), min_(c), max_(c), count(as_int=True))
    return out.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2)).withColumn("avg_o_totalprice", F.round("avg_o_totalprice", 4))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS INT) AS \"Count\" FROM lineitem GROUP BY ALL")
def group_multi_key(spark, sf_dir):
    return A.group_by(t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").count(as_int=True)


def key_query(name: str, table: str, key: str) -> None:
    @query(f'SELECT {key}, CAST(count(*) AS INT) AS "Count" FROM {table} GROUP BY {key}', f"group_{name}")
    def run(spark, sf_dir):
        return A.group_by(t(spark, sf_dir, table), key).count(as_int=True)


for _name, _table, _key in (("dense_int", "customer", "c_nationkey"), ("sparse_int", "lineitem", "l_orderkey"), ("high_card_string", "customer", "c_name"), ("low_card_string", "customer", "c_mktsegment"), ("date", "orders", "o_orderdate"), ("double", "lineitem", "l_quantity")):
    key_query(_name, _table, _key)


@query('SELECT NULLIF(p_size, 10) AS size, CAST(count(*) AS INT) AS "Count" FROM part GROUP BY 1')
def group_null_key(spark, sf_dir):
    return A.group_by(t(spark, sf_dir, "part").select(F.nullif("p_size", F.lit(10)).alias("size")), "size").count(as_int=True)


@query("SELECT NULLIF(p_size, 10) AS size, p_brand, CAST(sum(p_size) AS DOUBLE) AS sum_p_size FROM part GROUP BY 1, 2")
def group_null_multi_key(spark, sf_dir):
    return A.group_by(t(spark, sf_dir, "part").select(F.nullif("p_size", F.lit(10)).alias("size"), "p_brand", "p_size"), "size", "p_brand").aggregate(sum_("p_size"))


@query("SELECT p_brand, CAST(COALESCE(sum(v), 0) AS DOUBLE) AS sum_v, min(v) AS min_v, avg(v) AS avg_v, CAST(count(*) AS INT) AS count FROM (SELECT p_brand, CASE WHEN p_brand < 'Brand#3' THEN NULL ELSE p_size END AS v FROM part) GROUP BY 1")
def group_all_null(spark, sf_dir):
    df = t(spark, sf_dir, "part").select("p_brand", F.when(~(F.col("p_brand") < "Brand#3"), F.col("p_size")).alias("v"))
    return A.group_by(df, "p_brand").aggregate(sum_("v"), min_("v"), mean("v"), count(as_int=True))


@query("SELECT CAST(year(o_orderdate) AS INT) AS y, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1")
def group_expression(spark, sf_dir):
    out = A.group_by(t(spark, sf_dir, "orders"), F.year("o_orderdate").alias("y")).sum("o_totalprice", "s")
    return out.withColumn("s", F.round("s", 2))


@query("SELECT o_orderstatus, round(sum(o_totalprice * 2 + 1), 2) AS s FROM orders GROUP BY 1")
def group_agg_expression(spark, sf_dir):
    out = A.group_by(t(spark, sf_dir, "orders"), "o_orderstatus").aggregate(sum_(F.col("o_totalprice") * 2 + 1).alias("s"))
    return out.withColumn("s", F.round("s", 2))


@query("SELECT DISTINCT c_nationkey FROM customer")
def group_keys(spark, sf_dir):
    return A.group_by(t(spark, sf_dir, "customer"), "c_nationkey").keys_frame()


@query("SELECT n_regionkey, list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)::VARCHAR AS ids FROM nation GROUP BY 1")
def group_row_ids(spark, sf_dir):
    out = A.group_by(t(spark, sf_dir, "nation"), "n_regionkey").row_ids("n_nationkey")
    return out.select("n_regionkey", F.concat(F.lit("["), F.array_join("row_ids", ", "), F.lit("]")).alias("ids"))


@query('SELECT c_nationkey, CAST(count(*) AS INT) AS "Count" FROM customer GROUP BY 1')
def count_stream(spark, sf_dir):
    return spark.createDataFrame([tuple(r) for r in A.group_by(t(spark, sf_dir, "customer"), "c_nationkey").count_stream()], "c_nationkey int, Count int")


# Order, top-n, slices


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def order_multi_dir(spark, sf_dir):
    """Every row with its place."""
    df = t(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return O.with_place(df, "o_orderpriority", "o_totalprice", "o_orderkey", ascending=[True, False, True]).select("o_orderkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY size ASC NULLS FIRST, p_partkey) AS place FROM (SELECT p_partkey, NULLIF(p_size, 10) AS size FROM part)")
def order_nulls(spark, sf_dir):
    df = t(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("size"))
    return O.with_place(df, "size", "p_partkey").select("p_partkey", "place")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_name DESC, c_custkey DESC) AS place FROM customer")
def order_string_desc(spark, sf_dir):
    return O.with_place(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey", ascending=False).select("c_custkey", "place")


@query("SELECT event_id, row_number() OVER (ORDER BY value NULLS FIRST, event_id) AS place FROM events")
def sorted_id_places(spark, sf_dir):
    """The sorted ids with the place of each, so that their order is compared too."""
    return O.with_place(t(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id").select("event_id", "place")


@query("SELECT event_id FROM events ORDER BY value, event_id")
def sorted_ids(spark, sf_dir):
    return O.sorted_ids(t(spark, sf_dir, "events"), "event_id", "value")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def top_n_smallest(spark, sf_dir):
    return O.smallest(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 10, "c_acctbal", "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_n_largest(spark, sf_dir):
    return O.largest_rows(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 10, "c_acctbal", "c_custkey")


@query("SELECT * FROM events ORDER BY event_id LIMIT 10")
def head(spark, sf_dir):
    return O.head(t(spark, sf_dir, "events"), 10, "event_id")


@query("SELECT * FROM events ORDER BY event_id DESC LIMIT 10")
def tail(spark, sf_dir):
    return O.tail(t(spark, sf_dir, "events"), 10, "event_id")


@query("SELECT * FROM events ORDER BY event_id LIMIT 7 OFFSET 20")
def slice_rows(spark, sf_dir):
    return O.slice_rows(t(spark, sf_dir, "events"), 20, 7, "event_id")


@query("SELECT value FROM events ORDER BY event_id LIMIT 5 OFFSET 3")
def column_slice(spark, sf_dir):
    return O.slice_rows(t(spark, sf_dir, "events").select("event_id", "value"), 3, 5, "event_id").select("value")


# Distinct and cleaning


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_all(spark, sf_dir):
    return O.distinct(t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) = 1")
def distinct_first(spark, sf_dir):
    return O.distinct(t(spark, sf_dir, "orders"), "o_orderpriority", row_id="o_orderkey")


@query("SELECT p_partkey, NULLIF(p_size, 10) AS size FROM part WHERE p_size <> 10")
def drop_nulls(spark, sf_dir):
    return R.drop_nulls(t(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("size")))


@query("SELECT p_partkey, COALESCE(NULLIF(p_size, 10), -1) AS size FROM part")
def fill_null(spark, sf_dir):
    return R.fill_null(t(spark, sf_dir, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("size")), "size", -1)


@query("SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY first) AS INT) AS code FROM (SELECT event_id, event_type, min(event_id) OVER (PARTITION BY event_type) AS first FROM events)")
def category_codes(spark, sf_dir):
    return O.category_codes(t(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


# Iteration and metadata


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1")
def collect_stream(spark, sf_dir):
    out = t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("s"))
    return spark.createDataFrame([tuple(r) for r in I.rows(out)], out.schema)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    """An extension: event-time windows, the same function over a table as over a stream."""
    return I.windowed_counts(t(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT event_type, count(*) AS n, sum(CAST(value > 50 AS BIGINT))::BIGINT AS large FROM events GROUP BY 1")
def stream_counts(spark, sf_dir):
    """An extension: counts from micro-batches of files, each batch's partial counts appended once and summed at the end."""
    events = t(spark, sf_dir, "events").select("event_id", "event_type", "value")
    files, out = place(spark), place(spark)
    events.repartition(3, "event_id").write.parquet(files)

    def add(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("large"))
        counted.write.mode("overwrite").parquet(f"{out}/batch={number}")

    I.run_to_end(I.file_stream(spark, files, events.schema), add, place(spark))
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("large").alias("large"))


@query("SELECT c_nationkey, o_orderdate, sum(n) OVER (PARTITION BY c_nationkey ORDER BY o_orderdate ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS rolling FROM (SELECT c_nationkey, o_orderdate, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)")
def window_rolling(spark, sf_dir):
    """An extension: a rolling sum within groups."""
    left = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderdate")
    joined = J.join(left, t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey"), "custkey")
    days = joined.groupBy("c_nationkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c_nationkey").orderBy("o_orderdate").rowsBetween(-6, 0)
    return days.select("c_nationkey", "o_orderdate", F.sum("n").over(w).alias("rolling"))


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS before FROM customer")
def window_rank(spark, sf_dir):
    """An extension: ranks and neighbours within groups."""
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return t(spark, sf_dir, "customer").select("c_custkey", F.rank().over(w).cast("long").alias("r"), F.lag("c_custkey").over(w).alias("before"))


@query("SELECT column_name AS name, CAST(row_number() OVER () - 1 AS INT) AS place FROM (DESCRIBE customer)")
def column_names(spark, sf_dir):
    return spark.createDataFrame([(c, i) for i, c in enumerate(t(spark, sf_dir, "customer").columns)], "name string, place int")


@query("""
WITH r AS (SELECT CAST(r_regionkey AS VARCHAR) AS a, r_name AS b FROM region ORDER BY r_regionkey LIMIT 3),
     w AS (SELECT CAST(greatest(11, max(length(a))) AS INT) AS wa, CAST(greatest(8, max(length(b))) AS INT) AS wb FROM r)
SELECT rtrim(rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ')) AS line FROM w, (SELECT * FROM r UNION ALL VALUES ('r_regionkey', 'r_name'), ('<int>', '<string>'))
UNION ALL SELECT repeat('-', wa) || '-+-' || repeat('-', wb) FROM w
UNION ALL SELECT '... (' || (count(*) - 3) || ' more rows)' FROM region
""")
def inspect_text(spark, sf_dir):
    df = t(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(x,) for x in M.inspect(df, 3).split("\n")], "line string")


@query("SELECT true AS held, false AS held_after, count(*) AS n FROM region")
def release_cached(spark, sf_dir):
    df = t(spark, sf_dir, "region").select("r_name", F.lit(1).alias("cached")).persist()
    n, held = df.count(), df.storageLevel.useMemory
    return spark.createDataFrame([(held, M.release(df).storageLevel.useMemory, n)], "held boolean, held_after boolean, n long")

"""Queries on keyed records: filters of the expression language, lookups, upserts, aggregates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import algebra, filters, fusion
from docloom.plans.catalogue import query
from docloom.session import table
from docloom.sources import tables


def _filtered(name: str, expression: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.where(table(spark, d, "orders"), expression).select("o_orderkey", "o_totalprice", "o_orderstatus")

    run.__name__ = f"structured_filter_{name}"
    query(f"SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE {sql}")(run)


for _name, _expression, _sql in (
    ("eq", 'eq("o_orderstatus", "F")', "o_orderstatus = 'F'"),
    ("ne", "ne('o_orderstatus', 'F')", "o_orderstatus <> 'F'"),
    ("gt", 'gt("o_totalprice", 250000.5)', "o_totalprice > 250000.5e0"),
    ("gte", 'gte("o_orderkey", 14000)', "o_orderkey >= 14000"),
    ("lt", 'lt("o_orderdate", 1995-03-15)', "o_orderdate < DATE '1995-03-15'"),
    ("lte", 'lte("o_orderdate", 1995-03-15T00:00:00Z)', "o_orderdate <= TIMESTAMP '1995-03-15 00:00:00'"),
    ("contain", 'contain("o_orderpriority", "URG")', "contains(o_orderpriority, 'URG')"),
    ("like", 'like("o_orderpriority", "%-HIGH")', "o_orderpriority LIKE '%-HIGH'"),
    ("in", 'in("o_orderstatus", ["F", "P"])', "o_orderstatus IN ('F', 'P')"),
    ("nin", 'nin("o_orderstatus", ["F", "P"])', "o_orderstatus NOT IN ('F', 'P')"),
    ("and", 'and(eq("o_orderstatus", "O"), gt("o_totalprice", 100000), lt("o_custkey", 700))', "o_orderstatus = 'O' AND o_totalprice > 100000 AND o_custkey < 700"),
    ("or", 'or(eq("o_orderstatus", "P"), lt("o_totalprice", 2000))', "o_orderstatus = 'P' OR o_totalprice < 2000"),
    ("not", 'not(or(eq("o_orderstatus", "P"), lt("o_totalprice", 100000)))', "NOT (o_orderstatus = 'P' OR o_totalprice < 100000)"),
):
    _filtered(_name, _expression, _sql)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 200000 OR o_custkey < 100) AND o_orderkey NOT IN (1, 2, 3)")
def dict_filter(spark: SparkSession, d: str) -> DataFrame:
    f = {"o_orderstatus": "F", "$or": [{"o_totalprice": {"$gt": 200000}}, {"o_custkey": {"$lt": 100}}], "o_orderkey": {"$nin": [1, 2, 3]}}
    return table(spark, d, "orders").where(filters.from_dict(f)).select("o_orderkey", "o_custkey")


_REQUESTS = "SELECT o_orderkey AS pos, o_custkey * 2 AS c_custkey FROM orders"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each order; half of the keys are known."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 2).alias("c_custkey"))


@query(f"SELECT pos, r.c_custkey, c_name FROM ({_REQUESTS}) r LEFT JOIN customer c ON c.c_custkey = r.c_custkey")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return fusion.in_request_order(_requests(spark, d), table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("pos", "c_custkey", "c_name")


@query(f"SELECT pos, r.c_custkey, c.c_custkey IS NOT NULL AS found FROM ({_REQUESTS}) r LEFT JOIN customer c ON c.c_custkey = r.c_custkey")
def exists_probe(spark: SparkSession, d: str) -> DataFrame:
    return fusion.exists_in(_requests(spark, d), table(spark, d, "customer"), "c_custkey").select("pos", "c_custkey", "found")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer UNION ALL SELECT 1000000, 'fresh'")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"))
    return tables.upsert(c, new.unionByName(spark.createDataFrame([(1000000, "fresh")], "c_custkey long, c_name string")), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return tables.delete(c, c.where("c_custkey % 10 = 0"), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return tables.update(c, c.where("c_custkey % 7 = 0").select("c_custkey", F.lit("x").alias("c_mktsegment")), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 10")
def collection_get(spark: SparkSession, d: str) -> DataFrame:
    return tables.get(table(spark, d, "customer"), where=F.col("c_mktsegment") == "BUILDING", key="c_custkey", columns=["c_custkey", "c_name"], limit=20, offset=10)


@query("SELECT avg(l_quantity) AS mean FROM lineitem")
def frame_mean(spark: SparkSession, d: str) -> DataFrame:
    return filters.frame_query(table(spark, d, "lineitem"), "mean:l_quantity", "l_orderkey")


@query("SELECT p_size FROM part ORDER BY p_partkey LIMIT 3 OFFSET 1")
def frame_column(spark: SparkSession, d: str) -> DataFrame:
    return filters.frame_query(table(spark, d, "part"), "column:p_size[1..3]", "p_partkey").select("p_size")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, o_totalprice + 1 AS more, upper(o_orderstatus) AS status FROM orders")
def assign_and_pick(spark: SparkSession, d: str) -> DataFrame:
    chain = algebra.assign(twice=F.col("o_totalprice") * 2, more=F.col("o_totalprice") + 1, status=F.upper("o_orderstatus")) | algebra.pick("o_orderkey", "twice", "more", "status", "absent")
    return chain(table(spark, d, "orders"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def nation_totals(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    by_customer = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    rows = by_customer.join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


@query("""SELECT n_name AS node, NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n_name) AS first, NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = n_name) AS last
FROM (SELECT source AS n_name FROM edges UNION SELECT target FROM edges)""".replace("edges", "(SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 AND b.n_regionkey = a.n_regionkey)"))
def graph_ends(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("source"), (F.col("n_nationkey") + 1).alias("k"), "n_regionkey")
    edges = a.join(n.select(F.col("n_name").alias("target"), F.col("n_nationkey").alias("k"), "n_regionkey"), ["k", "n_regionkey"])
    return fusion.nodes_like(edges.select("source", "target"))

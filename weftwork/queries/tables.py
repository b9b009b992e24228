"""Stylesheet operator patterns over the relational tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import shortest
from ..operators import rows, walks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers the function that follows under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def keep_last_event(spark, sf_dir):
    """Keep-last: the last event of each user and type."""
    return rows.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT conv_id, role, turn, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k FROM conversations) WHERE k = 1""")
def first_seen_role(spark, sf_dir):
    """First occurrence by key: each conversation's first turn of each role."""
    turns = table(spark, sf_dir, "conversations").withColumn("place", F.struct("turn", "text"))
    return rows.keep_first(turns, ["conv_id", "role"], "place").select("conv_id", "role", "turn", "text")


FLAGS = {"N": 1, "R": 2, "A": 3}


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 WHEN 'A' THEN 3 ELSE 0 END AS bucket,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 WHEN 'A' THEN 3 ELSE 0 END, l_linenumber) AS place
FROM lineitem""")
def bucket_ordered_lines(spark, sf_dir):
    """Order by bucket, then by place: an order's lines by return flag."""
    rank = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 3).otherwise(0)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rank.alias("bucket"))
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("bucket", "l_linenumber")))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3""")
def last_orders(spark, sf_dir):
    """Last N of each: three orders of each customer. The limit is applied before the shuffle too."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return orders.withColumn("k", F.row_number().over(newest)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT l_suppkey, l_linestatus, CASE WHEN l_linestatus = 'F' THEN min(l_extendedprice) ELSE max(l_extendedprice) END AS price
FROM lineitem GROUP BY l_suppkey, l_linestatus""")
def flag_extremes(spark, sf_dir):
    """The least for one flag, the greatest for any other."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey", "l_linestatus").agg(F.when(F.col("l_linestatus") == "F", F.min("l_extendedprice")).otherwise(F.max("l_extendedprice")).alias("price"))


@query("""SELECT c_custkey, coalesce(bool_and(coalesce(o_orderstatus = 'F', false)), true) AS all_done
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey""")
def all_done(spark, sf_dir):
    """Support of all: whether all of a customer's large orders are finished. Orders are
    aggregated before the join."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.every(F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))).alias("ok"), F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left")
    return customers.select("c_custkey", F.when(F.col("n").isNull(), False).otherwise(F.col("ok")).alias("all_done"))


@query("""WITH s AS (SELECT l_suppkey, list(DISTINCT l_returnflag) AS has FROM lineitem WHERE l_quantity > 49 GROUP BY l_suppkey)
SELECT l_suppkey, array_to_string(list_sort(list_filter(['A','N','R'], lambda x: list_contains(has, x))), ',') AS added,
  array_to_string(list_sort(list_filter(['A','N','R'], lambda x: NOT list_contains(has, x))), ',') AS removed FROM s""")
def add_remove_split(spark, sf_dir):
    """Add and remove: of all flags those that a supplier has, and the others."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    has = lines.groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("has"))
    every = has.withColumn("every", F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    split = rows.added_and_removed(every, "has", "every")
    return split.select("l_suppkey", F.array_join("add", ",").alias("added"), F.array_join("remove", ",").alias("removed"))


@query("""SELECT p_partkey, CASE WHEN length(a) < length(b) THEN CASE WHEN length(a) < length(c) THEN a ELSE c END
  ELSE CASE WHEN length(b) < length(c) THEN b ELSE c END END AS shortest
FROM (SELECT p_partkey, p_name AS a, p_brand AS b, p_type AS c FROM part)""")
def shortest_candidate(spark, sf_dir):
    """The shortest of several spellings; of equals the later."""
    return table(spark, sf_dir, "part").select("p_partkey", shortest(F.array("p_name", "p_brand", "p_type")).alias("shortest"))


@query("""WITH o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
r AS (SELECT *, sum(CASE WHEN role = before AND role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM o)
SELECT conv_id, min(turn) AS turn, min(role) AS role, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_rows FROM r GROUP BY conv_id, run""")
def merge_user_turns(spark, sf_dir):
    """Gaps and islands: side-by-side turns of the user as one."""
    return rows.merge_runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text", ["user"], " ")


RULES = [(1, "https://"), (2, "http://"), (3, "http")]


@query("""SELECT page_id, first(rule ORDER BY rule) AS rule FROM pages
LEFT JOIN (VALUES (1, 'https://'), (2, 'http://'), (3, 'http')) r(rule, prefix) ON starts_with(url, prefix) GROUP BY page_id""")
def first_rule_match(spark, sf_dir):
    """First match wins: the first prefix rule for each page's address."""
    rules = spark.createDataFrame(RULES, "rule int, prefix string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return rows.first_match(pages, rules, lambda r: F.col("url").startswith(r.prefix), "rule").select("page_id", "rule")


BANDS = [("small", 0.0, 50_000.0), ("middle", 50_000.0, 200_000.0), ("large", 200_000.0, 1e12)]


@query("""SELECT o_orderkey, band FROM orders JOIN (VALUES ('small', 0.0::DOUBLE, 50000.0::DOUBLE), ('middle', 50000.0, 200000.0), ('large', 200000.0, 1e12)) b(band, lo, hi)
ON o_totalprice >= lo AND o_totalprice < hi""")
def range_lookup(spark, sf_dir):
    """Range lookup: an order's band of price; the bands are three literal rows."""
    bands = F.broadcast(spark.createDataFrame(BANDS, "band string, lo double, hi double"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(bands, (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).select("o_orderkey", "band")


@query("""WITH RECURSIVE t AS (
  SELECT 'r' || r_regionkey AS id, r_name AS path, 1 AS depth FROM region
  UNION ALL
  SELECT c.id, t.path || '/' || c.name, t.depth + 1 FROM t JOIN (
    SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent, n_name AS name FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier) c ON c.parent = t.id)
SELECT id, path, CAST(depth AS INTEGER) AS depth FROM t""")
def recursive_paths(spark, sf_dir):
    """Nesting: every path from the root down, however deep."""
    region, nation, supplier = (table(spark, sf_dir, name) for name in ("region", "nation", "supplier"))
    of = lambda df, id, parent, name: df.select(id.alias("id"), parent.alias("parent"), F.col(name).cast("string").alias("name"))
    key = lambda letter, c: F.concat(F.lit(letter), c)
    inner = of(nation, key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name").union(of(supplier, key("s", "s_suppkey"), key("n", "s_nationkey"), "s_name"))

    def inwards(here):
        found = here.withColumnRenamed("id", "parent").join(inner, "parent")
        return found.select("id", F.concat("path", F.lit("/"), "name").alias("path"), (F.col("depth") + 1).alias("depth"))

    roots = region.select(key("r", "r_regionkey").alias("id"), F.col("r_name").cast("string").alias("path"))
    return walks.reached(roots, inwards, ["id"], "depth").select("id", "path", (F.col("depth") + 1).alias("depth"))


@query("""SELECT c_mktsegment, n_name, sum(o_totalprice) AS total, count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment, n_name""")
def segment_totals(spark, sf_dir):
    """Lookups of dimensions around a fact table, filtered and pruned at the scan."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("c_mktsegment", "n_name").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n_orders"))


@query("""SELECT l_suppkey, flag AS constant_of, min(l_orderkey * 10 + l_linenumber) AS first_at,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey * 10 + l_linenumber), flag) AS constant
FROM (SELECT *, l_returnflag || l_linestatus AS flag FROM lineitem) GROUP BY l_suppkey, flag""")
def hoisted_constants(spark, sf_dir):
    """One number for each distinct value, in order of first occurrence."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_at"), F.concat("l_returnflag", "l_linestatus").alias("constant_of"))
    return rows.hoisted(lines, ["l_suppkey"], "first_at", "constant_of").select("l_suppkey", "constant_of", "first_at", "constant")

"""Tables of the change-evidence model, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many tasks as there are cores, where a table has fewer splits than that: for rows that take much work each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as entities (id, kind, name, price), and the same with rows removed, changed and added."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("name"), cents("o_totalprice").alias("price"))
    kept = o.filter("id % 17 <> 0").withColumn("price", F.when(F.col("id") % 13 == 0, F.col("price") + 1).otherwise(F.col("price"))).withColumn("name", F.when(F.col("id") % 29 == 0, F.lit(None)).otherwise(F.col("name")))
    return o, kept.unionByName(o.filter("id % 19 = 0").withColumn("id", F.col("id") + 1_000_000_000))


SNAPSHOT_SQL = """
base AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_orderstatus AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
head AS (
  SELECT id, kind, CASE WHEN id % 29 = 0 THEN NULL ELSE name END AS name, CASE WHEN id % 13 = 0 THEN price + 1 ELSE price END AS price FROM base WHERE id % 17 <> 0
  UNION ALL SELECT id + 1000000000, kind, name, price FROM base WHERE id % 19 = 0)
"""


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst, kind, tier): region to nation to customer and supplier, customer to order to part (probable), part to supplier (possible)."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))

    def edges(df, src, dst, kind, tier):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"))

    line = t("lineitem")
    return (
        edges(t("nation"), name("region", "n_regionkey"), name("nation", "n_nationkey"), "contains", 0)
        .unionByName(edges(t("customer"), name("nation", "c_nationkey"), name("customer", "c_custkey"), "contains", 0))
        .unionByName(edges(t("supplier"), name("nation", "s_nationkey"), name("supplier", "s_suppkey"), "contains", 0))
        .unionByName(edges(t("orders"), name("customer", "o_custkey"), name("order", "o_orderkey"), "runs", 0))
        .unionByName(edges(line, name("order", "l_orderkey"), name("part", "l_partkey"), "uses-data", 1).distinct())
        .unionByName(edges(line, name("part", "l_partkey"), name("supplier", "l_suppkey"), "flows-to", 2).distinct())
    )


GRAPH_SQL = """
edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind, 0 AS tier FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 0 FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 0 FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'runs', 0 FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses-data', 1 FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'flows-to', 2 FROM lineitem)
"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit message for each order: (change, author, email, lines)."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    when = lambda m, r, x: F.when(k % m == r, F.array(x)).otherwise(F.array().cast("array<string>"))
    subject = F.concat(F.lit("[PAY-"), text(k % 50), F.lit("] Update rates"), F.when(k % 9 == 0, " for INC0012345").otherwise(""))
    lines = F.concat(
        F.array(subject, F.lit(""), F.lit("See OPS-1 for why.")), when(2, 0, F.lit("")),
        F.array(F.concat(F.lit("Reviewed-by: Ann <ann"), text(k % 5), F.lit("@example.org>"))),
        F.array(F.concat(F.lit("Approved-by: User "), text(k % 7), F.lit(" <U"), text(k % 7), F.lit("@Example.org>"))),
        when(3, 0, F.lit("Approved-by: deploy-bot <bot@example.org>")), when(4, 0, F.concat(F.lit("Change: CHG"), F.lpad(text(k % 1000), 7, "0"))),
    )
    return o.select(k.alias("change"), F.concat(F.lit("User "), text(F.col("o_custkey") % 7)).alias("author"), F.when(k % 6 != 0, F.concat(F.lit("u"), text(F.col("o_custkey") % 7), F.lit("@example.org"))).alias("email"), lines.alias("lines"))


COMMITS_SQL = """
commits AS (
  SELECT o_orderkey AS change, 'User ' || (o_custkey % 7) AS author, CASE WHEN o_orderkey % 6 <> 0 THEN 'u' || (o_custkey % 7) || '@example.org' END AS email,
    '[PAY-' || (o_orderkey % 50) || '] Update rates' || CASE WHEN o_orderkey % 9 = 0 THEN ' for INC0012345' ELSE '' END AS subject,
    o_orderkey % 2 = 0 AS has_trailers, 'ann' || (o_orderkey % 5) || '@example.org' AS reviewer,
    'User ' || (o_orderkey % 7) AS approver, 'U' || (o_orderkey % 7) || '@Example.org' AS approver_email,
    o_orderkey % 3 = 0 AS bot, CASE WHEN o_orderkey % 4 = 0 THEN 'CHG' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 7, '0') END AS record
  FROM orders)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit message for each order, of many forms: (change, author, email, text). Words come from the order's comment-like columns, so texts vary with the rows."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = lambda x: x.cast("string")
    line = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    subject = (
        F.when(k % 7 == 0, F.concat(F.lit("[PAY-"), t(k % 50), F.lit("] Update rates"))).when(k % 7 == 1, F.concat(F.lit("OPS-"), t(k % 90), F.lit(": use UTF-8 and SHA-256")))
        .when(k % 7 == 2, F.concat(F.lit("Use ISO-"), t(k), F.lit(" names [API2-"), t(c), F.lit("]"))).when(k % 7 == 3, F.concat(F.lit("Fix INC"), F.lpad(t(c), 7, "0"), F.lit(" and INC123")))
        .when(k % 7 == 4, F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" REQ"), F.lpad(t(k), 7, "0"))).otherwise(F.concat(F.lit("Change "), F.col("o_orderstatus"), F.lit(" rows of A-"), t(k))))
    parts = F.array_compact(F.array(
        subject, F.lit(""), F.concat(F.lit("See OPS-1 for why, ["), F.upper(F.substring("o_orderpriority", 3, 3)), F.lit("-"), t(k % 40), F.lit("] for how.")),
        line(k % 5 == 0, "Task CTASK", F.lpad(t(k % 999), 7, "0"), " and PRB", t(1_000_000 + c)), line(k % 3 > 0, ""),
        line(k % 11 > 0, "Reviewed-by: Ann B <ann", t(k % 5), "@example.org>"),
        line(k % 13 > 1, "Approved-by: User ", t(k % 7), " <U", t(k % 7), "@Example.org>"), line(k % 4 == 0, "approved-by:\tUser ", t(c % 7)), line(k % 6 == 0, "Approved-by: Deploy Bot"), line(k % 9 == 0, "Assisted-by: helper <x.bot@example.org>"),
        line(k % 4 == 1, "Change: CHG", F.lpad(t(k % 1000), 7, "0"), " for PAY-", t(k % 30)), line(k % 8 < 3, "Change-type: ", F.when(k % 8 == 0, "Emergency").when(k % 8 == 1, "normal").otherwise("Expedited ")),
        line(k % 10 < 6, "Requested-by: Lead-", t(c % 9)), line(k % 17 == 0, "not a trailer"),
    ))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).select(k.alias("change"), F.concat(F.lit("User "), t(c % 7)).alias("author"), F.when(k % 6 != 0, F.concat(F.lit("u"), t(c % 7), F.lit("@example.org"))).alias("email"), F.array_join(parts, "\n").alias("text"))


MESSAGES_SQL = r"""
m0 AS (SELECT *, o_orderkey AS k, o_custkey AS c FROM orders),
messages AS (SELECT k AS change, 'User ' || (c % 7) AS author, CASE WHEN k % 6 <> 0 THEN 'u' || (c % 7) || '@example.org' END AS email, array_to_string(list_filter([
  CASE k % 7 WHEN 0 THEN '[PAY-' || (k % 50) || '] Update rates' WHEN 1 THEN 'OPS-' || (k % 90) || ': use UTF-8 and SHA-256' WHEN 2 THEN 'Use ISO-' || k || ' names [API2-' || c || ']' WHEN 3 THEN 'Fix INC' || lpad(left(CAST(c AS VARCHAR), 7), 7, '0') || ' and INC123'
    WHEN 4 THEN 'Order ' || o_orderpriority || ' REQ' || lpad(left(CAST(k AS VARCHAR), 7), 7, '0') ELSE 'Change ' || o_orderstatus || ' rows of A-' || k END,
  '', 'See OPS-1 for why, [' || upper(substring(o_orderpriority, 3, 3)) || '-' || (k % 40) || '] for how.',
  CASE WHEN k % 5 = 0 THEN 'Task CTASK' || lpad(CAST(k % 999 AS VARCHAR), 7, '0') || ' and PRB' || (1000000 + c) END, CASE WHEN k % 3 > 0 THEN '' END,
  CASE WHEN k % 11 > 0 THEN 'Reviewed-by: Ann B <ann' || (k % 5) || '@example.org>' END,
  CASE WHEN k % 13 > 1 THEN 'Approved-by: User ' || (k % 7) || ' <U' || (k % 7) || '@Example.org>' END, CASE WHEN k % 4 = 0 THEN 'approved-by:' || chr(9) || 'User ' || (c % 7) END, CASE WHEN k % 6 = 0 THEN 'Approved-by: Deploy Bot' END, CASE WHEN k % 9 = 0 THEN 'Assisted-by: helper <x.bot@example.org>' END,
  CASE WHEN k % 4 = 1 THEN 'Change: CHG' || lpad(CAST(k % 1000 AS VARCHAR), 7, '0') || ' for PAY-' || (k % 30) END, CASE WHEN k % 8 < 3 THEN 'Change-type: ' || CASE k % 8 WHEN 0 THEN 'Emergency' WHEN 1 THEN 'normal' ELSE 'Expedited ' END END,
  CASE WHEN k % 10 < 6 THEN 'Requested-by: Lead-' || (c % 9) END, CASE WHEN k % 17 = 0 THEN 'not a trailer' END], lambda x: x IS NOT NULL), chr(10)) AS text FROM m0)
"""

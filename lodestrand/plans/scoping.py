"""Queries on names in nested scopes: types, supertypes, fields and chained calls, over a source tree that varies with the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators.scopes import Scopes
from lodestrand.plans.derive import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _div(c, n):
    return F.call_function("div", c, F.lit(n))


def tree(spark, d):
    """types, imports, wildcards, methods and fields: suppliers are types (some nested in others), parts their members; written names need every way of looking up."""
    k = F.col("s_suppkey")
    package = lambda c: _t("pk", _div(c, 5) % 6)  # noqa: E731  five suppliers in a row share a package
    outer = F.when(k % 5 == 3, _t(package(k), ".T", k - 1)).when(k % 5 == 4, _t(package(k), ".T", k - 2, ".In", k - 1))
    name = F.when(k % 5 == 3, _t(package(k), ".T", k - 1, ".In", k)).when(k % 5 == 4, _t(package(k), ".T", k - 2, ".In", k - 1, ".Deep", k)).otherwise(_t(package(k), ".T", k))
    up, side = _div(k, 3), k + 1
    supers = F.array_compact(F.array(F.when(k % 7 != 0, _t("T", up)), F.when(k % 4 == 0, _t(package(side), ".T", side)), F.when(k % 6 == 1, "In8"), F.when(k % 9 == 2, "Outside.T1"), F.when(k % 10 == 5, "T7.In8.Deep9"), F.when(k % 8 == 3, _t("T", k + 4))))
    suppliers = table(spark, d, "supplier")
    types = suppliers.select(name.alias("fqn"), outer.alias("outer"), _t("m", _div(k, 5)).alias("module"), supers.alias("supers"), k.alias("k"))
    imports = suppliers.filter(k % 3 > 0).select(_t("m", _div(k, 5)).alias("module"), _t("T", up).alias("simple"), _t(package(up), ".T", up).alias("fqn")).distinct()
    wildcards = suppliers.select(_t("m", _div(k, 5)).alias("module"), (k % 5).cast("int").alias("at"), _t("pk", k % 6).alias("package")).distinct()
    p = F.col("p_partkey")
    n = suppliers.count()
    members = table(spark, d, "part").select(p, (p % n).alias("k")).join(types.select("k", F.col("fqn").alias("owner")), "k")
    methods = members.filter(p % 3 > 0).select(
        _t("method:", p).alias("id"), "owner", p.alias("at"), F.when(p % 19 == 0, "<init>").otherwise(_t("go", p % 7)).alias("name"), (p % 3).cast("int").alias("arity"), (p % 11 == 0).alias("varargs"),
        F.when(p % 5 == 0, "int").when(p % 5 == 1, _t("T", p % n, "[]")).when(p % 5 == 2, "In8").otherwise(_t("T", (p + 3) % n)).alias("returns"))
    fields = members.filter(p % 3 == 0).select("owner", _t("f", p % 9).alias("name"), _t("field:", p).alias("field")).dropDuplicates(["owner", "name"])
    return types.drop("k"), imports, wildcards, methods, fields


def call_rows(spark, d):
    """Calls (orders): bare, on this and super, on names, on constructors, and on what another call returns, in long chains, some of which close."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    types = tree(spark, d)[0].select(F.col("fqn").alias("caller"), F.regexp_extract("fqn", "([0-9]+)$", 1).cast("long").alias("_t"))
    n = types.count()
    orders = table(spark, d, "orders").withColumn("_t", c % n).join(types, "_t")
    last = table(spark, d, "orders").select((k + 1).alias("o_orderkey"), k.alias("_before"))
    kind = k % 12
    inner = F.when(kind < 6, F.col("_before")).when(k % 120 == 6, k).when(k % 120 == 7, F.lit(-1))
    receiver_type = F.when(kind.isin(8, 9), _t("T", k % n)).when(kind == 10, "In8").when(kind == 11, "Nowhere")
    found = orders.join(last, "o_orderkey", "left")
    return found.select(
        k.alias("call"), "caller", F.when(k % 13 == 0, "<init>").otherwise(_t("go", k % 7)).alias("name"), F.when(inner.isNull() & (kind == 6), F.when(k % 24 == 6, "super").otherwise("this")).when(inner.isNull() & (kind > 7), "v").alias("receiver"),
        receiver_type.alias("receiver_type"), inner.alias("receiver_call"), F.when(k % 31 != 0, (k % 3).cast("int")).alias("args"))


def use_rows(spark, d):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    types = tree(spark, d)[0].select(F.col("fqn").alias("caller"), F.regexp_extract("fqn", "([0-9]+)$", 1).cast("long").alias("_t"))
    lines = table(spark, d, "lineitem").withColumn("_t", F.col("l_suppkey")).join(types, "_t")
    receiver = F.when(k % 4 == 0, "this").when(k % 4 == 1, _t("T", F.col("l_partkey") % 50)).when(k % 8 == 2, "T7.In8")
    return lines.select(k.alias("use"), "caller", _t("f", F.col("l_partkey") % 9).alias("name"), receiver.alias("receiver")).dropDuplicates(["use"])


@query
def type_names(spark, d):
    """Supertypes as written and the types that they mean."""
    types, imports, wildcards, _, _ = tree(spark, d)
    return Scopes(types, imports, wildcards).parents


@query
def type_supertypes(spark, d):
    """All supertypes of each type, in the order in which members are looked for."""
    types, imports, wildcards, _, _ = tree(spark, d)
    return Scopes(types, imports, wildcards).above.select("type", "ancestor", "level", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query
def field_uses(spark, d):
    """The field that each use means."""
    types, imports, wildcards, _, fields = tree(spark, d)
    uses = use_rows(spark, d)
    return Scopes(types, imports, wildcards).fields(uses, fields)


@query
def chained_calls(spark, d):
    """The methods that calls land on, however long the chains of receivers are."""
    types, imports, wildcards, methods, _ = tree(spark, d)
    return Scopes(types, imports, wildcards).calls(call_rows(spark, d), methods)

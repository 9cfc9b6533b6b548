"""Queries on facts inside programs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import behave, cover, program, rollup, storage
from lodestrand.plans.business import test_obligations
from lodestrand.plans.derive import cents, spread, table
from lodestrand.sources import lines as L

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query("""SELECT p_partkey AS file, line, level, name, parent FROM part, LATERAL (VALUES (1, 1, 'REC', CAST(NULL AS BIGINT)), (2, 5, 'G' || p_size, 1), (3, 10, 'A', 2), (4, 88, 'ON', 3), (5, 10, 'B', 2), (6, 5, 'C', 1), (7, 15, 'D', 6), (8, 77, 'ALONE', NULL)) v(line, level, name, parent)""")
def data_hierarchy(spark, d):
    text = _text("01 REC.\n05 G", F.col("p_size").cast("string"), ".\n10 A PIC X.\n88 ON VALUE 'Y'.\n10 B PIC 9.\n05 C.\n15 D PIC 9(3).\n77 ALONE PIC X.")
    items = program.data_items(L.to_lines(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t"))
    return program.parents(items, [1, 5, 10, 15, 77, 88]).select("file", F.col("line").cast("int").alias("line"), "level", "name", F.col("parent").cast("long").alias("parent"))


@query("""SELECT p_partkey AS file, place, text FROM part, LATERAL (VALUES ('1', 'START ' || p_size), ('2.1', 'BOOK A' || p_size % 3), ('2.2.1', 'BOOK C'), ('2.2.2', 'COPY A' || p_size % 3 || '.'), ('3', 'COPY NONE.'), ('4', 'END')) v(place, text)""")
def copy_expand(spark, d):
    part = table(spark, d, "part")
    three = (F.col("p_size") % 3).cast("string")
    text = _text("START ", F.col("p_size").cast("string"), "\nCOPY A", three, ".\nCOPY NONE.\nEND")
    lines = L.to_lines(part.select("p_partkey", text.alias("t")), "p_partkey", "t")
    books = part.select(_text("A", three).alias("book"), _text("BOOK A", three, "\nCOPY C", three, ".").alias("t")).union(part.select(_text("C", three), _text("BOOK C\nCOPY A", three, "."))).distinct()
    library = L.to_lines(books, "book", "t").withColumnRenamed("file", "book")
    return program.expand_copies(lines, library).select("file", F.array_join(F.col("order").cast("array<string>"), ".").alias("place"), "text")


@query("""WITH RECURSIVE m AS (SELECT DISTINCT 'F' || l_suppkey AS source, 'F' || (l_suppkey * 7 + l_linenumber) % 60 AS target FROM lineitem), l AS (SELECT DISTINCT 'F' || s_suppkey AS field, s_nationkey AS value FROM supplier),
v(field, value) AS (SELECT field, value FROM l UNION SELECT m.target, v.value FROM v JOIN m ON m.source = v.field) SELECT field, value FROM v""")
def value_closure(spark, d):
    f = lambda c: F.concat(F.lit("F"), c.cast("string"))
    moves = table(spark, d, "lineitem").select(f(F.col("l_suppkey")).alias("source"), f((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 60).alias("target")).distinct()
    return program.values(moves, table(spark, d, "supplier").select(f(F.col("s_suppkey")).alias("field"), F.col("s_nationkey").alias("value")))


@query("""SELECT p_partkey AS record, seq, start, bytes FROM part, LATERAL (VALUES (1, 0, p_size), (2, p_size, 9 * (p_size % 4 + 1)), (3, p_size + 9 * (p_size % 4 + 1), 1)) v(seq, start, bytes)""")
def record_layout(spark, d):
    part = table(spark, d, "part")
    field = lambda seq, pic, occurs: F.struct(F.lit(seq).alias("seq"), pic.alias("picture"), occurs.alias("occurs"))
    fields = part.select(F.col("p_partkey").alias("record"), F.inline(F.array(field(1, _text("X(", F.col("p_size").cast("string"), ")"), F.lit(None).cast("int")), field(2, F.lit("S9(7)V99"), F.col("p_size") % 4 + 1), field(3, F.lit("X"), F.lit(1)))))
    return program.layout(fields, T.picture(F.col("picture"))["length"]).select("record", "seq", F.col("start").cast("int").alias("start"), F.col("bytes").cast("int").alias("bytes"))


@query("""WITH RECURSIVE t AS (SELECT s_suppkey AS type, CASE WHEN s_suppkey > 0 THEN s_suppkey // 3 END AS super FROM supplier), c(type, ancestor, distance) AS (SELECT type, type, 0 FROM t UNION ALL SELECT c.type, t.super, c.distance + 1 FROM c JOIN t ON t.type = c.ancestor WHERE t.super IS NOT NULL),
m AS (SELECT s_suppkey AS owner, 'm' || s_suppkey % 4 AS name, s_suppkey % 3 AS arity, s_suppkey % 5 = 0 AS varargs FROM supplier), k AS (SELECT o_orderkey AS call, o_custkey % (SELECT count(*) FROM supplier) AS type, 'm' || o_orderkey % 4 AS name, o_orderkey % 3 AS args FROM orders),
r AS (SELECT k.call, m.owner, rank() OVER (PARTITION BY k.call ORDER BY c.distance) AS n FROM k JOIN c ON c.type = k.type JOIN m ON m.owner = c.ancestor AND m.name = k.name AND (m.arity = k.args OR m.varargs AND k.args >= m.arity - 1))
SELECT k.call, r.owner FROM k LEFT JOIN r ON r.call = k.call AND r.n = 1""")
def method_resolution(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    chain = program.chains(s.select(F.col("k").alias("type"), F.when(F.col("k") > 0, F.call_function("div", F.col("k"), F.lit(3))).alias("super")))
    name = lambda c: F.concat(F.lit("m"), (c % 4).cast("string"))
    methods = s.select(F.col("k").alias("owner"), name(F.col("k")).alias("name"), (F.col("k") % 3).alias("arity"), (F.col("k") % 5 == 0).alias("varargs"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    calls = table(spark, d, "orders").crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("call"), (F.col("o_custkey") % F.col("n")).alias("type"), name(F.col("o_orderkey")).alias("name"), (F.col("o_orderkey") % 3).alias("args"))
    return program.resolve_calls(calls, chain, methods)


@query("""WITH m AS (SELECT l_suppkey AS file, l_orderkey AS line, 'K' || l_partkey % 9 AS field, 'RSA-' || l_linenumber AS literal FROM lineitem WHERE l_linenumber <> 5), c AS (SELECT DISTINCT l_suppkey AS file, l_orderkey AS line, 'K' || l_partkey % 9 AS field FROM lineitem WHERE l_linenumber = 5),
b AS (SELECT file, line, field, max(literal) AS literal FROM m GROUP BY ALL) SELECT c.file, c.line, c.field, (SELECT arg_max(b.literal, b.line) FROM b WHERE b.file = c.file AND b.field = c.field AND b.line < c.line) AS argument FROM c""")
def call_arguments(spark, d):
    """Every fifth line of an order is a call, all others are moves."""
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), F.concat(F.lit("K"), (F.col("l_partkey") % 9).cast("string")).alias("field"), "l_linenumber")
    moves = line.filter("l_linenumber <> 5").groupBy("file", "line", "field").agg(F.max(F.concat(F.lit("RSA-"), F.col("l_linenumber").cast("string"))).alias("literal"))
    return program.arguments(line.filter("l_linenumber = 5").select("file", "line", "field").distinct(), moves)


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'A' || p_size || ',B' WHEN 1 THEN 'X,Y' || p_size WHEN 2 THEN 'ONE,TWO,TOTAL' ELSE 'TAX' END AS senders, CASE p_size % 4 WHEN 0 THEN 'SUM' || p_size WHEN 1 THEN 'Z' WHEN 2 THEN 'TOTAL' ELSE 'OUT1,OUT2' END AS receivers FROM part""")
def flow_parts(spark, d):
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, _text("COMPUTE SUM", s, " ROUNDED = A", s, " * (B + 1.5).")).when(F.col("p_size") % 4 == 1, _text("DIVIDE X BY Y", s, " GIVING Z.")).when(F.col("p_size") % 4 == 2, "ADD ONE TWO TO TOTAL.").otherwise("MOVE TAX TO OUT1 OUT2.")
    made = program.flow_parts(text)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(made["senders"], ",").alias("senders"), F.array_join(made["receivers"], ",").alias("receivers"))


@query("""SELECT p_partkey AS id, 'KEY' || p_size AS reads, CASE WHEN p_size % 2 = 0 THEN 'NAME,AGE' || p_size ELSE '' END AS writes FROM part""")
def host_variables(spark, d):
    s = F.col("p_size").cast("string")
    made = program.host_variables(_text("SELECT a ", F.when(F.col("p_size") % 2 == 0, _text("INTO :name, :AGE", s)).otherwise(""), " FROM t WHERE k = :key", s))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(made["reads"], ",").alias("reads"), F.array_join(made["writes"], ",").alias("writes"))


@query("""WITH i AS (SELECT p_partkey AS id, p_name AS name, p_brand AS a, p_type AS b FROM part), r AS (SELECT p_partkey AS ref, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS qa, CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_partkey % 31 = 0 THEN 'NOWHERE' END AS qb FROM part),
n AS (SELECT r.ref, count(i.id) AS n, min(i.id) AS t FROM r LEFT JOIN i ON i.name = r.name AND (r.qa IS NULL OR r.qa IN (i.a, i.b)) AND (r.qb IS NULL OR r.qb IN (i.a, i.b)) GROUP BY r.ref)
SELECT ref, CASE WHEN n = 1 THEN t END AS target, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'ambiguous' END AS reason FROM n""")
def qualified_names(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    items = part.select(k.alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("path"))
    refs = part.select(k.alias("ref"), F.col("p_name").alias("name"), F.array_compact(F.array(F.when(k % 3 == 0, F.col("p_brand")), F.when(k % 2 == 0, F.col("p_type")).when(k % 31 == 0, "NOWHERE"))).alias("qualifiers"))
    return program.qualified(refs, items)


@query("""WITH a AS (SELECT o_orderkey AS test, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders)
SELECT test, 'price' AS field, CAST(p AS VARCHAR) AS was, CASE WHEN test % 41 <> 0 THEN CAST(p + 1 AS VARCHAR) END AS now FROM a WHERE test % 37 = 0 OR test % 41 = 0 UNION ALL SELECT test, 'status', s, NULL FROM a WHERE test % 41 = 0""")
def replay_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("test"), "o_orderstatus", cents("o_totalprice").alias("p"))
    out = lambda p: F.create_map(F.lit("price"), p.cast("string"), F.lit("status"), F.col("o_orderstatus"))
    return program.replay(o.select("test", out(F.col("p")).alias("output")), o.filter("test % 41 <> 0").select("test", out(F.when(F.col("test") % 37 == 0, F.col("p") + 1).otherwise(F.col("p"))).alias("output")))


@query()
def test_selection(spark, d):
    """Few tests that meet all obligations, each test at cost 1."""
    needs = test_obligations(spark, d).select(F.col("test").cast("string").alias("candidate"), F.col("need").alias("element"))
    return cover.greedy_cover(needs, needs.select("candidate").distinct().withColumn("cost", F.lit(1).cast("long")))


@query("""SELECT o_orderkey AS id, '{"_type":"https://in-toto.io/Statement/v1","subject":{"name":"order-' || o_orderkey || '"},"predicateType":"change","predicate":{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}}' AS statement FROM orders""")
def statements(spark, d):
    made = rollup.statement(F.struct(_text("order-", F.col("o_orderkey").cast("string")).alias("name")), "change", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), made.alias("statement"))


@query("""SELECT CAST(ts AS DATE) AS day, CAST(user_id % 6 AS INTEGER) AS bank, count(*) AS runs, count(*) FILTER (event_type = 'purchase' AND value >= 40) AS different, count(*) FILTER (event_type = 'purchase' AND value >= 40) = 0 AS merged FROM events GROUP BY 1, 2""")
def shadow_days(spark, d):
    """Live and shadow runs of each day's rows: a change is merged where they agree."""
    e = table(spark, d, "events").withColumns({"day": F.to_date("ts"), "bank": (F.col("user_id") % 6).cast("int"), "rc": F.lit(0)})
    live = e.withColumn("output", cents("value"))
    shadow = e.withColumn("output", F.when((F.col("event_type") == "purchase") & (F.col("value") >= 40), cents("value") - 1).otherwise(cents("value")))
    result = behave.compare(live, shadow, "event_id").join(e.select("event_id", "day", "bank"), "event_id")
    return result.groupBy("day", "bank").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("result") == "different").alias("different")).withColumn("merged", F.col("different") == 0)


@query("""WITH b AS (SELECT DISTINCT sha256(p_name || p_brand) AS digest FROM part WHERE p_size % 2 = 0) SELECT p_partkey AS id, b.digest IS NOT NULL AS reused FROM part LEFT JOIN b ON b.digest = sha256(p_name || p_brand)""")
def baseline_reuse(spark, d):
    part = table(spark, d, "part").withColumn("digest", F.sha2(F.concat("p_name", "p_brand"), 256))
    kept = part.filter("p_size % 2 = 0").select(F.col("digest").alias("_kept")).distinct()
    return part.join(kept, part["digest"] == kept["_kept"], "left").select(F.col("p_partkey").alias("id"), F.col("_kept").isNotNull().alias("reused"))


def _records(spark, d):
    """Data descriptions (file, line, text) that vary with each part: tables in groups, redefinitions, packed and binary numbers."""
    part = spread(table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type"))
    k, size = F.col("p_partkey"), F.col("p_size")
    n = lambda c: c.cast("string")
    usage = F.element_at(F.array(*map(F.lit, ["", " COMP", " COMP-3", " USAGE IS BINARY", " PACKED-DECIMAL", " DISPLAY", " COMPUTATIONAL-5"])), (k % 7 + 1).cast("int"))
    some = lambda cond, *parts: F.when(cond, _text(*parts))
    lines = F.array_compact(F.array(
        _text("01 REC-", n(k), "."), _text(" 05 KEY-A PIC X(", n(size), ") VALUE 'K", n(k % 9), "'."), some(k % 2 == 0, " 05 KEY-B REDEFINES KEY-A."), some(k % 2 == 0, "  10 B-ONE PIC X(", n(size), ")."), some(k % 6 == 0, " 05 KEY-C REDEFINES KEY-B PIC 9(", n(size + k % 5), ")."),
        _text(" 05 ROWS OCCURS ", n(k % 4 + 1), " TIMES", F.when(k % 3 == 0, usage).otherwise(""), "."), _text("  10 AMT PIC S9(", n(size % 9 + 1), ")V9(", n(k % 3 + 1), ")", F.when(k % 3 == 0, "").otherwise(usage), "."), _text("  10 CELL OCCURS ", n(size % 3 + 1), "."),
        F.lit("   15 TAG PIC XX VALUE 'T'."), _text("   15 FILLER PIC X(", n(k % 2 + 1), ")."), some(k % 5 == 0, "   15 TAG-N REDEFINES TAG PIC 99."), some(k % 5 == 0, "    88 IS-T VALUE '01'."), some(k % 4 == 1, "  10 VIEW-R REDEFINES CELL."), some(k % 4 == 1, "   15 VR PIC XX."),
        some(k % 11 == 0, " 05 PTR POINTER."), some(k % 13 == 0, " 05 VAR OCCURS 1 TO 9 DEPENDING ON N PIC X."), F.lit(" 05 LAST-F PIC 9(3)."), _text("77 ALONE PIC ", F.when(k % 2 == 0, "X(4)").otherwise("S9(5)"), usage, " VALUE 7."), F.lit("01 OTHER REDEFINES NOTHING."), _text(" 03 O PIC X(", n(size), ").")))
    return L.to_lines(part.select("p_partkey", F.array_join(lines, "\n").alias("t")), "p_partkey", "t")


def _layout(spark, d):
    items = storage.described(_records(spark, d))
    return storage.record_layout(program.parents(items, [1, 3, 5, 10, 15, 77, 88]))


@query()
def storage_layout(spark, d):
    """Sizes and starts of all items of all records; a recursive layout checks them."""
    return _layout(spark, d).select("file", "line", "name", "size", "bytes", "start", "problem")


@query()
def storage_occurrences(spark, d):
    """Each elementary occurrence with its subscripts, start and bytes."""
    return storage.occurrences(_layout(spark, d)).select("file", "line", "name", F.array_join(F.col("subscripts").cast("array<string>"), ",").alias("subscripts"), "start", "bytes")


@query()
def storage_values(spark, d):
    """Values that items may hold through storage that they share with others."""
    given = storage.described(_records(spark, d)).filter("value IS NOT NULL AND level <> 88").select("file", "line", "value")
    return storage.redefined_values(_layout(spark, d), given)

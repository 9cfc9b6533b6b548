"""Queries that assemble a graph from facts and let a change spread in it, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.operators import behave, cover, graph, steps
from lodestrand.plans.business import _FORM, _PAIRS, _cover, _quadratic
from lodestrand.plans.derive import table
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


def _n(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: Programs (suppliers), their paragraphs (line numbers of their lines), data items (customers) in groups (nations, regions), files and datasets.
_SYSTEM = """
nodes AS (SELECT 'program:P' || s_suppkey AS id, 'program' AS kind FROM supplier UNION SELECT 'para:P' || l_suppkey || '.A' || l_linenumber, 'paragraph' FROM lineitem
  UNION SELECT 'data:D' || c_custkey, 'data' FROM customer UNION SELECT 'data:N' || n_nationkey, 'data' FROM nation UNION SELECT 'data:R' || r_regionkey, 'data' FROM region),
tree AS (SELECT 'data:D' || c_custkey AS id, 'data:N' || c_nationkey AS parent FROM customer UNION ALL SELECT 'data:N' || n_nationkey, 'data:R' || n_regionkey FROM nation),
edges AS (SELECT DISTINCT 'program:P' || l_suppkey AS src, 'para:P' || l_suppkey || '.A' || l_linenumber AS dst, 'contains' AS kind, true AS resolved, CAST(NULL AS VARCHAR) AS command, CAST(NULL AS VARCHAR) AS disp, false AS dynamic, CAST(NULL AS VARCHAR) AS paragraph, CAST(NULL AS VARCHAR) AS mode FROM lineitem
  UNION ALL SELECT 'program:P' || s_suppkey, 'program:P' || (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier), 'calls', true, NULL, NULL, s_suppkey % 3 = 0, NULL, NULL FROM supplier
  UNION ALL SELECT DISTINCT 'para:P' || l_suppkey || '.A' || l_linenumber, 'data:D' || o_custkey, 'uses-data', true, NULL, NULL, false, NULL, CASE WHEN l_tax > 0.04 THEN 'read' ELSE 'write' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT 'data:D' || o_custkey, 'data:D' || (o_custkey * 3 + 1) % (SELECT count(*) FROM customer), 'flows-to', o_orderpriority <> '5-LOW', NULL, NULL, false, CASE WHEN o_orderstatus = 'F' THEN 'para:P' || o_custkey % 5 || '.A1' END, NULL FROM orders
  UNION ALL SELECT DISTINCT 'para:P' || l_suppkey || '.A' || l_linenumber, 'file:F' || l_partkey % 50, 'cics-file', true, CASE l_linenumber WHEN 1 THEN 'READ' WHEN 2 THEN 'rewrite' ELSE 'UNLOCK' END, NULL, false, NULL, NULL FROM lineitem
  UNION ALL SELECT 'step:S' || p_partkey, 'dataset:X' || p_size, 'dd', true, NULL, CASE p_partkey % 4 WHEN 0 THEN 'SHR' WHEN 1 THEN 'OLD' WHEN 2 THEN 'mod' END, false, NULL, NULL FROM part
  UNION ALL SELECT 'step:S' || p_partkey, 'program:P' || p_partkey % (SELECT count(*) FROM supplier), 'runs', true, NULL, NULL, false, NULL, NULL FROM part)
"""


def _system(spark, d):
    t = lambda n: table(spark, d, n)
    line, order, part, c = t("lineitem"), t("orders"), t("part"), F.col
    programs, customers = t("supplier").count(), t("customer").count()  # two counts
    node = lambda df, id_, kind: df.select(id_.alias("id"), F.lit(kind).alias("kind"))
    para = _n("para:P", c("l_suppkey"), ".A", c("l_linenumber"))
    nodes = node(t("supplier"), _n("program:P", c("s_suppkey")), "program").unionByName(node(line, para, "paragraph"))
    for name, letter, key in (("customer", "D", "c_custkey"), ("nation", "N", "n_nationkey"), ("region", "R", "r_regionkey")):
        nodes = nodes.unionByName(node(t(name), _n(f"data:{letter}", c(key)), "data"))
    tree = t("customer").select(_n("data:D", c("c_custkey")).alias("id"), _n("data:N", c("c_nationkey")).alias("parent")).unionByName(t("nation").select(_n("data:N", c("n_nationkey")).alias("id"), _n("data:R", c("n_regionkey")).alias("parent")))

    def edge(df, src, dst, kind, resolved=None, dynamic=None, **texts):
        given = {k: texts.get(k, F.lit(None)).cast("string") for k in ("command", "disp", "paragraph", "mode")}
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), (F.lit(True) if resolved is None else resolved).alias("resolved"), (F.lit(False) if dynamic is None else dynamic).alias("dynamic"), *[x.alias(k) for k, x in given.items()])

    used = line.join(order, c("l_orderkey") == c("o_orderkey"))
    edges = (
        edge(line, _n("program:P", c("l_suppkey")), para, "contains").distinct()
        .unionByName(edge(t("supplier"), _n("program:P", c("s_suppkey")), _n("program:P", (c("s_suppkey") * 7 + 3) % programs), "calls", dynamic=c("s_suppkey") % 3 == 0))
        .unionByName(edge(used, para, _n("data:D", c("o_custkey")), "uses-data", mode=F.when(c("l_tax") > 0.04, "read").otherwise("write")).distinct())
        .unionByName(edge(order, _n("data:D", c("o_custkey")), _n("data:D", (c("o_custkey") * 3 + 1) % customers), "flows-to", resolved=c("o_orderpriority") != "5-LOW", paragraph=F.when(c("o_orderstatus") == "F", _n("para:P", c("o_custkey") % 5, ".A1"))).distinct())
        .unionByName(edge(line, para, _n("file:F", c("l_partkey") % 50), "cics-file", command=F.when(c("l_linenumber") == 1, "READ").when(c("l_linenumber") == 2, "rewrite").otherwise("UNLOCK")).distinct())
        .unionByName(edge(part, _n("step:S", c("p_partkey")), _n("dataset:X", c("p_size")), "dd", disp=F.when(c("p_partkey") % 4 == 0, "SHR").when(c("p_partkey") % 4 == 1, "OLD").when(c("p_partkey") % 4 == 2, "mod")))
        .unionByName(edge(part, _n("step:S", c("p_partkey")), _n("program:P", c("p_partkey") % programs), "runs"))
    )
    return nodes.distinct(), edges, tree


_STEPS = """kin AS (SELECT c.id AS descendant, c.parent AS ancestor FROM tree c UNION ALL SELECT a.id, b.parent FROM tree a JOIN tree b ON b.id = a.parent),
rel AS (SELECT id, id AS item FROM nodes WHERE kind = 'data' UNION SELECT ancestor, descendant FROM kin UNION SELECT descendant, ancestor FROM kin),
mv AS (SELECT src AS item, dst AS dest, 'value' AS mode FROM edges WHERE kind = 'flows-to' AND resolved UNION ALL SELECT src, paragraph, 'node' FROM edges WHERE kind = 'flows-to' AND resolved AND paragraph IS NOT NULL
  UNION ALL SELECT dst, src, 'node' FROM edges WHERE kind = 'uses-data' AND mode = 'read'),
raw AS (
  SELECT dst || '|node' AS src, src || '|node' AS dst, CASE WHEN dynamic THEN 1 ELSE 0 END AS tier FROM edges WHERE kind IN ('contains', 'calls', 'runs')
  UNION ALL SELECT dst || '|node', src || '|node', 2 FROM edges WHERE kind = 'cics-file' AND upper(command) IN ('READ', 'READNEXT', 'READPREV', 'STARTBR')
  UNION ALL SELECT dst || '|node', src || '|node', 2 FROM edges WHERE kind = 'dd' AND upper(coalesce(disp, 'NEW')) IN ('SHR', 'OLD')
  UNION ALL SELECT src || '|node', dst || '|node', 2 FROM edges WHERE kind = 'cics-file' AND upper(command) IN ('WRITE', 'REWRITE', 'DELETE') OR kind = 'dd' AND upper(coalesce(disp, 'NEW')) IN ('NEW', 'MOD', 'OLD')
  UNION ALL SELECT src || '|node', dst || '|node', 1 FROM edges WHERE kind = 'runs'
  UNION ALL SELECT src || '|node', dst || '|node', 2 FROM edges WHERE kind = 'contains' AND dst IN (SELECT src FROM edges WHERE kind = 'cics-file' AND upper(command) IN ('WRITE', 'REWRITE', 'DELETE'))
  UNION ALL SELECT descendant || '|definition', ancestor || '|definition', 0 FROM kin
  UNION ALL SELECT k || '|definition', paragraph || '|node', 0 FROM (SELECT unnest([src, dst]) AS k, paragraph FROM edges WHERE kind = 'flows-to' AND resolved AND paragraph IS NOT NULL) WHERE k IN (SELECT id FROM nodes)
  UNION ALL SELECT dst || '|definition', src || '|node', 0 FROM edges WHERE kind = 'uses-data' AND dst IN (SELECT id FROM nodes)
  UNION ALL SELECT r.id || '|' || m, mv.dest || '|' || mv.mode, 1 FROM rel r JOIN mv ON mv.item = r.item, (VALUES ('definition'), ('value'), ('node')) o(m)),
wide AS (SELECT * FROM raw UNION ALL SELECT split_part(src, '|', 1) || '|' || m, dst, tier FROM raw, (VALUES ('definition'), ('value')) o(m) WHERE ends_with(src, '|node') AND split_part(src, '|', 1) IN (SELECT id FROM nodes WHERE kind IN ('data', 'file')))"""


@query(f"WITH {_SYSTEM}, {_STEPS} SELECT src, dst, min(tier) AS tier FROM wide GROUP BY src, dst")
def impact_steps(spark, d):
    return steps.steps(*_system(spark, d)).select("src", "dst", "tier")


@query()
def impact_by_mode(spark, d):
    """What a changed data definition and a changed program reach; its test walks the same steps with a heap."""
    nodes, edges, tree = _system(spark, d)
    return steps.reached(nodes, edges, tree, spark.sql("SELECT 'data:D7' AS id, 'definition' AS mode UNION ALL SELECT 'program:P2', 'node'"))


@query("""WITH ch AS (SELECT o_orderkey AS change, CASE WHEN o_custkey % 2 = 0 THEN 'program:P' || o_custkey % 10 ELSE 'data:D' || o_custkey END AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'crypto-call' ELSE 'program' END AS kind FROM orders),
u AS (SELECT 'program:P' || s_suppkey AS id FROM supplier WHERE s_acctbal < 1000) SELECT change, bool_or(kind = 'crypto-call' OR id IN (SELECT id FROM u)) AS crypto FROM ch GROUP BY change""")
def crypto_touched(spark, d):
    uses = table(spark, d, "supplier").filter("s_acctbal < 1000").select(_n("program:P", F.col("s_suppkey")).alias("src"), F.lit("uses-crypto").alias("kind"))  # those that use it
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    changed = table(spark, d, "orders").select(k.alias("change"), F.when(c % 2 == 0, _n("program:P", c % 10)).otherwise(_n("data:D", c)).alias("id"), F.when(k % 9 == 0, "crypto-call").otherwise("program").alias("kind"))
    return steps.touches_crypto(changed, uses)


@query("""WITH c AS (SELECT 'program:C' || o_custkey AS src, CASE WHEN o_orderkey % 3 > 0 THEN 'P' || o_custkey % 14 END AS literal, 'F' || o_orderkey % 30 AS field FROM orders), v AS (SELECT DISTINCT 'F' || (p_size * 2) AS field, 'P' || p_partkey % 13 || '  ' AS value FROM part),
p AS (SELECT 'P' || s_suppkey AS name, 'program:P' || s_suppkey AS id FROM supplier), n AS (SELECT DISTINCT src, literal AS name, false AS probable FROM c WHERE literal IS NOT NULL UNION SELECT c.src, coalesce(trim(v.value), '?' || c.field), v.value IS NOT NULL FROM c LEFT JOIN v ON v.field = c.field WHERE c.literal IS NULL)
SELECT n.src, coalesce(p.id, 'unresolved:program:' || n.name) AS dst, p.id IS NOT NULL AS resolved, n.probable FROM n LEFT JOIN p ON p.name = n.name""")
def call_edges(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    calls = table(spark, d, "orders").select(_n("program:C", c).alias("src"), F.when(k % 3 > 0, _n("P", c % 14)).alias("literal"), _n("F", k % 30).alias("field"))
    values = table(spark, d, "part").select(_n("F", F.col("p_size") * 2).alias("field"), _n("P", F.col("p_partkey") % 13, "  ").alias("value")).distinct()
    programs = table(spark, d, "supplier").select(_n("P", F.col("s_suppkey")).alias("name"), _n("program:P", F.col("s_suppkey")).alias("id"))
    return graph.dynamic_calls(calls, values, programs)


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS program, 'S' || (l_linenumber % 3) AS section, l_linenumber AS seq, 'A' || (l_linenumber % 4) AS name, 'P' || l_suppkey || '.' || l_linenumber AS id FROM lineitem),
s AS (SELECT program, min(seq) AS seq, section AS name, 'section:P' || program || '.' || section AS id FROM p GROUP BY program, section),
r AS (SELECT l_orderkey * 10 + l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS k, l_suppkey AS program, 'P' || l_suppkey || '.' || l_linenumber AS src, CASE WHEN l_tax > 0.06 THEN 'goes-to' ELSE 'performs' END AS kind,
  CASE WHEN l_partkey % 9 < 7 THEN 'A' || (l_partkey % 6) ELSE 'S' || (l_partkey % 4) END AS target, CASE WHEN l_quantity > 25 THEN 'A' || (l_partkey % 5 + 1) END AS thru, 'S' || (l_linenumber % 3) AS section, CASE WHEN l_partkey % 8 = 0 THEN 'S' || (l_partkey % 3) END AS in_section FROM lineitem),
w AS (SELECT n, k, program, section, in_section, target AS name, 0 AS side FROM r UNION ALL SELECT n, k, program, section, in_section, thru, 1 FROM r WHERE thru IS NOT NULL),
c AS (SELECT w.n, w.k, w.side, p.id, row_number() OVER (PARTITION BY w.n, w.k, w.side ORDER BY CASE WHEN p.section = w.section THEN 0 ELSE 1 END, p.seq) AS best FROM w JOIN p ON p.program = w.program AND p.name = w.name AND (w.in_section IS NULL OR p.section = w.in_section)),
f AS (SELECT w.n, w.k, w.side, coalesce(c.id, s.id) AS id FROM w LEFT JOIN c ON c.n = w.n AND c.k = w.k AND c.side = w.side AND c.best = 1 LEFT JOIN s ON s.program = w.program AND s.name = w.name)
SELECT r.n || '#' || r.k AS key, r.src, coalesce(a.id, 'unresolved:paragraph:' || r.target) AS dst, r.kind, a.id IS NOT NULL AS resolved, CASE WHEN a.id IS NOT NULL THEN coalesce(b.id, r.thru) END AS thru
FROM r LEFT JOIN f a ON a.n = r.n AND a.k = r.k AND a.side = 0 LEFT JOIN f b ON b.n = r.n AND b.k = r.k AND b.side = 1""")
def perform_edges(spark, d):
    """Jumps between the paragraphs of programs: names repeat in other sections, some are sections', some nobody's."""
    c, line = F.col, table(spark, d, "lineitem")
    k, part = c("l_linenumber"), c("l_partkey")
    paragraphs = line.select(c("l_suppkey").alias("program"), _n("S", k % 3).alias("section"), k.alias("seq"), _n("A", k % 4).alias("name"), _n("P", c("l_suppkey"), ".", k).alias("id")).distinct()
    sections = paragraphs.groupBy("program", F.col("section").alias("name")).agg(F.min("seq").alias("seq")).withColumn("id", _n("section:P", c("program"), ".", c("name")))
    again = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    jumps = line.withColumn("again", again).select(
        _n(c("l_orderkey") * 10 + k, "#", c("again")).alias("key"), c("l_suppkey").alias("program"), _n("P", c("l_suppkey"), ".", k).alias("src"), F.when(c("l_tax") > 0.06, "goes-to").otherwise("performs").alias("kind"),
        F.when(part % 9 < 7, _n("A", part % 6)).otherwise(_n("S", part % 4)).alias("target"), F.when(c("l_quantity") > 25, _n("A", part % 5 + 1)).alias("thru"), _n("S", k % 3).alias("section"), F.when(part % 8 == 0, _n("S", part % 3)).alias("in_section"))
    return graph.jump_edges(jumps, paragraphs, sections)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'P' || l_suppkey AS src, 'R' || l_partkey % 700 AS dst FROM lineitem UNION SELECT DISTINCT 'R' || (p_partkey * 3 + 1) % 700, 'R' || p_partkey % 700 FROM part UNION SELECT DISTINCT 'X' || o_custkey % 90, 'R' || o_custkey % 800 FROM orders),
own AS (SELECT 'P' || s_suppkey AS id, 'C' || s_nationkey AS component FROM supplier WHERE s_nationkey < 4), r(resource, component) AS (SELECT e.dst, own.component FROM e JOIN own ON own.id = e.src WHERE e.dst LIKE 'R%' UNION SELECT e.dst, r.component FROM r JOIN e ON e.src = r.resource WHERE e.dst LIKE 'R%' AND e.src NOT IN (SELECT id FROM own))
SELECT resource, string_agg(component, ',' ORDER BY component) AS components, count(*) AS users FROM r GROUP BY resource HAVING count(*) > 1""")
def shared_through_resources(spark, d):
    """Resources (parts) that suppliers of several of the first nations (the components) reach, some of them through other resources."""
    c = F.col
    line, part, orders = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    edges = line.select(_n("P", c("l_suppkey")).alias("src"), _n("R", c("l_partkey") % 700).alias("dst")).union(
        part.select(_n("R", (c("p_partkey") * 3 + 1) % 700), _n("R", c("p_partkey") % 700))).union(orders.select(_n("X", c("o_custkey") % 90), _n("R", c("o_custkey") % 800))).distinct()
    owners = table(spark, d, "supplier").filter("s_nationkey < 4").select(_n("P", c("s_suppkey")).alias("id"), _n("C", c("s_nationkey")).alias("component"))
    found = graph.shared_through(edges, edges.filter("dst LIKE 'R%'").select(c("dst").alias("id")), owners)
    return found.select("resource", F.array_join("components", ",").alias("components"), "users")


@query()
def impact_paths(spark, d):
    """The way on which a changed definition, a changed program and a changed paragraph reach each node; its test walks the same steps with a heap."""
    spread = steps.steps(*_system(spark, d))
    anchors = spark.sql("SELECT 'data:D7' AS id, 'definition' AS mode, CAST(NULL AS STRING) AS entry UNION ALL SELECT 'program:P2', 'node', NULL UNION ALL SELECT 'para:P3.A1', 'node', 'flow:P3#9'")
    found = steps.reached_by(spread, anchors, once=True)
    return found.select("id", "tier", "length", F.array_join(F.transform("via", lambda x: F.concat_ws(" ", x["src"], x["label"], x["dst"])), " > ").alias("via"))


@query("""WITH f AS (SELECT 'C' || l_partkey % 40 AS source, 'C' || l_linenumber * 7 AS target FROM lineitem), i AS (SELECT 'C' || p_size AS name, min(p_partkey) AS id FROM part GROUP BY 1),
e AS (SELECT coalesce('data:' || a.id, 'unresolved:data:' || source) AS src, coalesce('data:' || b.id, 'unresolved:data:' || target) AS dst, a.id IS NOT NULL AND b.id IS NOT NULL AS resolved FROM f LEFT JOIN i a ON a.name = source LEFT JOIN i b ON b.name = target)
SELECT src, dst, resolved, count(*) AS statements FROM e GROUP BY ALL""")
def flow_edges(spark, d):
    c = F.col
    moves = table(spark, d, "lineitem").select(F.array(_n("C", c("l_partkey") % 40)).alias("sources"), F.array(_n("C", c("l_linenumber") * 7)).alias("targets"))
    items = table(spark, d, "part").groupBy(_n("C", c("p_size")).alias("name")).agg(_n("data:", F.min("p_partkey")).alias("id"))
    return graph.flow_edges(moves, items).groupBy("src", "dst", "resolved").agg(F.count(F.lit(1)).alias("statements"))


@query("""WITH n AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, 'supplier:' || s_suppkey AS id FROM supplier), f AS (SELECT 'order:' || l_orderkey AS src, CAST(l_suppkey + (l_partkey % 9) // 8 * 1000000 AS VARCHAR) AS target, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS key, l_partkey * 1000000 + l_suppkey AS rank FROM lineitem),
r AS (SELECT key, arg_max(src, (rank, src, target, kind)) AS src, arg_max(target, (rank, src, target, kind)) AS target, arg_max(kind, (rank, src, target, kind)) AS kind FROM f GROUP BY key)
SELECT r.key, r.src, coalesce(n.id, 'unresolved:supplier:' || r.target) AS dst, r.kind, n.id IS NOT NULL AS resolved FROM r LEFT JOIN n ON n.name = r.target""")
def assembled_edges(spark, d):
    c = F.col
    known = table(spark, d, "supplier").select(_n("supplier:", c("s_suppkey")).alias("id"), F.lit("supplier").alias("kind"), c("s_suppkey").cast("string").alias("name"), F.lit(0).alias("rank"))
    target = (c("l_suppkey") + F.call_function("div", c("l_partkey") % 9, F.lit(8)) * 1_000_000).cast("string")
    refs = table(spark, d, "lineitem").select(_n("order:", c("l_orderkey")).alias("src"), c("l_returnflag").alias("kind"), F.lit("supplier").alias("target_kind"), target.alias("target"), c("l_linenumber").alias("where"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("key"), F.struct(c("l_partkey") * 1_000_000 + c("l_suppkey"), _n("order:", c("l_orderkey")), target, c("l_returnflag")).alias("rank"))
    return graph.assemble(known, refs)[1].select("key", "src", "dst", "kind", "resolved")


@query("""WITH s AS (SELECT DISTINCT 'step:S' || l_orderkey AS step, 'P' || l_suppkey AS program, 'DD' || l_linenumber AS dd, 'X.Y' || l_partkey AS dataset FROM lineitem), f AS (SELECT 'P' || s_suppkey AS program, CASE s_suppkey % 3 WHEN 0 THEN 'UT-S-DD' WHEN 1 THEN 'S-DD' ELSE 'DD' END || (s_suppkey % 7 + 1) AS assigned, 'file:P' || s_suppkey || '.F' AS id FROM supplier)
SELECT DISTINCT f.id AS src, 'dataset:' || s.dataset AS dst, s.step FROM s JOIN f ON f.program = s.program AND regexp_replace(f.assigned, '^([A-Z]{2}-)*(S-)?', '') = s.dd""")
def file_bindings(spark, d):
    c = F.col
    dds = table(spark, d, "lineitem").select(_n("step:S", c("l_orderkey")).alias("step"), _n("P", c("l_suppkey")).alias("program"), _n("DD", c("l_linenumber")).alias("dd"), _n("X.Y", c("l_partkey")).alias("dataset"))
    k = c("s_suppkey")
    files = table(spark, d, "supplier").select(_n("P", k).alias("program"), F.concat(F.when(k % 3 == 0, "UT-S-DD").when(k % 3 == 1, "S-DD").otherwise("DD"), (k % 7 + 1).cast("string")).alias("assigned"), _n("file:P", k, ".F").alias("id"))
    return graph.bindings(dds, files)


@query(r"""WITH l AS (SELECT doc_id, CAST(k AS INTEGER) AS line, regexp_replace(text, '([aeiou])([,;])', '\1 "q, \2" \2 ''x; ', 'g') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, line, regexp_extract_all(text, '''[^'']*''|"[^"]*"|[^''"]+|[''"]') AS parts FROM l)
SELECT doc_id, line, array_to_string(list_transform(parts, lambda p: CASE WHEN regexp_matches(p, '^[''"]') THEN p ELSE regexp_replace(p, '[,;](\s|$)', ' \1', 'g') END), '') AS text FROM p""")
def separators_dropped(spark, d):
    """All lines, with literals put into many of them, some of which stay open."""
    lines = L.to_lines(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text")
    return lines.select(F.col("file").alias("doc_id"), "line", L.without_separators(F.regexp_replace("text", "([aeiou])([,;])", "$1 \"q, $2\" $2 'x; ")).alias("text"))


@query(f"""WITH {_PAIRS}, n AS (SELECT element, count(*) - 1 AS room FROM pairs GROUP BY element), b AS (SELECT element, room, CAST(ceil(log2(room + 1)) AS INTEGER) AS bits FROM n WHERE room > 0), k AS (SELECT element, room, bits, unnest(range(bits)) AS bit FROM b),
t AS (SELECT element, candidate AS x, 1 AS w FROM pairs UNION ALL SELECT element, 'slack/' || element || '/' || bit, -CASE WHEN bit < bits - 1 THEN 1 << bit ELSE room - (1 << (bits - 1)) + 1 END FROM k), p AS (SELECT sum(cost) + 1 AS p FROM costs),
q AS (SELECT a.x AS a, b.x AS b, CASE WHEN a.x = b.x THEN p * (a.w * a.w - 2 * a.w) ELSE 2 * p * a.w * b.w END AS v FROM t a JOIN t b ON a.element = b.element AND a.x <= b.x, p UNION ALL SELECT candidate, candidate, cost FROM costs)
SELECT a, b, CAST(sum(v) AS BIGINT) AS v FROM q GROUP BY a, b HAVING sum(v) <> 0""")
def cover_slack_penalties(spark, d):
    return cover.cover_slack_qubo(*_cover(spark, d))


@query(f"""WITH {_FORM}, x AS (SELECT range AS a FROM range(1024)), t AS (SELECT a, ((a >> (9 - i)) & 1) * v AS v FROM x, lin UNION ALL SELECT a, ((a >> (9 - i)) & 1) * ((a >> (9 - j)) & 1) * v FROM x, quad), e AS (SELECT a AS assignment, CAST(sum(v) AS BIGINT) AS energy FROM t GROUP BY a)
SELECT assignment, energy FROM e ORDER BY energy, assignment LIMIT 1""")
def qubo_minimum(spark, d):
    return cover.qubo_minimum(spark, *_quadratic(spark, d), 10)


@query("""WITH s AS (SELECT CAST(s_nationkey AS INTEGER) AS i, CAST(sum(CAST(floor(s_acctbal) AS BIGINT)) AS BIGINT) AS score FROM supplier GROUP BY 1) SELECT i, i AS j, 100000 * (1 - 2 * 3) - score AS v FROM s UNION ALL SELECT a.i, b.i, 200000 FROM s a JOIN s b ON a.i < b.i""")
def top_penalties(spark, d):
    scores = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("i")).agg(F.sum(F.floor("s_acctbal").cast("long")).alias("score"))
    return cover.top_qubo(scores, 3, 100_000)


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS test, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty, CAST(l_linenumber AS VARCHAR) AS ln, l_discount > 0.05 AS c2 FROM lineitem)
SELECT DISTINCT test, 'qty' AS field, qty AS value FROM r WHERE qty = '25' UNION SELECT test, 'ln', ln FROM r WHERE ln = '4' AND c2""")
def boundary_points(spark, d):
    c = F.col
    runs = table(spark, d, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("test"), F.create_map(F.lit("qty"), c("l_quantity").cast("int").cast("string"), F.lit("ln"), c("l_linenumber").cast("string")).alias("inputs"),
        F.array_compact(F.array(F.when(c("l_tax") > 0.04, "c1:T").otherwise("c1:F"), F.when(c("l_discount") > 0.05, "c2:T"))).alias("covers"))
    bounds = spark.sql("SELECT * FROM VALUES ('c1', 'qty', '25'), ('c2', 'ln', '4') AS t(condition, field, literal)")
    return behave.on_points(runs, bounds)


@query("""WITH c AS (SELECT 'flow:P' || s_suppkey || '.X#' || s_nationkey AS id FROM supplier WHERE s_acctbal > 5000) SELECT o_orderkey AS test, 'program:P' || o_custkey % 12 AS entity FROM orders WHERE 'P' || o_custkey % 12 IN (SELECT regexp_extract(id, '^[^:]*:([^.#]*)', 1) FROM c)""")
def tests_in_set(spark, d):
    changed = table(spark, d, "supplier").filter("s_acctbal > 5000").select(_n("flow:P", F.col("s_suppkey"), ".X#", F.col("s_nationkey")).alias("id"))  # what the change touched
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("test"), _n("program:P", F.col("o_custkey") % 12).alias("entity"))
    return behave.in_set(rows, "entity", changed)


@query("""WITH l AS (SELECT 'F' || p_size AS field, p_brand AS literal, CAST(p_size % 12 + 3 AS INTEGER) AS length FROM part), f AS (SELECT field, max(length) AS length FROM l GROUP BY field)
SELECT field, rpad(left(value, length), length, ' ') AS value FROM (SELECT field, length, '' AS value FROM f UNION SELECT field, length, repeat('Z', length) FROM f UNION SELECT f.field, f.length, literal FROM f JOIN l ON l.field = f.field) GROUP BY 1, 2""")
def text_field_values(spark, d):
    rows = table(spark, d, "part").select(_n("F", F.col("p_size")).alias("field"), F.col("p_brand").alias("literal"), (F.col("p_size") % 12 + 3).cast("int").alias("length"))
    return behave.text_candidates(rows.groupBy("field").agg(F.max("length").alias("length")), rows.select("field", "literal").distinct())


@query()
def edit_lines(spark, d):
    """Lines that an edit touches, for documents whose third line goes and whose fifth is doubled; tested against known edits."""
    none = F.array().cast("array<string>")
    head = F.array_join(F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 2, none).when(i == 4, F.array(x, x)).otherwise(F.array(x)))), "\n")
    return table(spark, d, "documents").select("doc_id", behave.touched_lines(F.col("text"), head).alias("lines"))

"""Queries on snapshots, graphs, walks, commits and rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import diff, gate, graph, rollup, walk
from lodestrand.plans.derive import COMMITS_SQL, GRAPH_SQL, SNAPSHOT_SQL, commits, snapshots, supply_graph, table
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


@query(f"""WITH {SNAPSHOT_SQL}
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change, a.price AS old_price, b.price AS new_price
FROM base a FULL JOIN head b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR (a.kind, a.name, a.price) IS DISTINCT FROM (b.kind, b.name, b.price)""")
def snapshot_diff(spark, d):
    base, head = snapshots(spark, d)
    return diff.diff(base, head, "id", ["kind", "name", "price"]).select("id", "change", F.col("before.price").alias("old_price"), F.col("after.price").alias("new_price"))


@query(f"""WITH {SNAPSHOT_SQL},
gone AS (SELECT id FROM base WHERE id % 17 = 0)
SELECT g.id, CASE WHEN g.id % 34 = 0 THEN 'order:' || g.id WHEN c.c_custkey IS NOT NULL THEN 'customer:' || c.c_custkey ELSE 'removed:order:' || g.id END AS anchor
FROM gone g JOIN orders o ON o.o_orderkey = g.id LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_custkey % 3 <> 0""")
def change_anchors(spark, d):
    o = table(spark, d, "orders")
    changed = o.filter("o_orderkey % 17 = 0").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.concat(F.lit("customer:"), "o_custkey").alias("parent"))
    nodes = changed.filter("key % 34 = 0").select("id").unionByName(table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("id")))
    return diff.anchors(changed, nodes).select(F.col("key").alias("id"), "anchor")


@query(f"""WITH RECURSIVE {GRAPH_SQL},
a(id, hops) AS (SELECT 'nation:3', 0 UNION ALL SELECT e.dst, a.hops + 1 FROM a JOIN edges e ON e.src = a.id AND e.tier = 0),
s0 AS (SELECT id, 0 AS tier, min(hops) AS hops FROM a GROUP BY id),
s1 AS (SELECT e.dst AS id, 1 AS tier, min(s.hops) + 1 AS hops FROM s0 s JOIN edges e ON e.src = s.id AND e.tier = 1 WHERE e.dst NOT IN (SELECT id FROM s0) GROUP BY e.dst),
u1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
s2 AS (SELECT e.dst AS id, 2 AS tier, min(s.hops) + 1 AS hops FROM u1 s JOIN edges e ON e.src = s.id AND e.tier = 2 WHERE e.dst NOT IN (SELECT id FROM u1) GROUP BY e.dst)
SELECT id, tier, hops FROM u1 UNION ALL SELECT id, tier, hops FROM s2""")
def impact_tiers(spark, d):
    return walk.impact(supply_graph(spark, d).select("src", "dst", "tier"), spark.sql("SELECT 'nation:3' AS id"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, w(id, hops) AS (SELECT 'region:1', 0 UNION ALL SELECT e.dst, w.hops + 1 FROM w JOIN edges e ON e.src = w.id AND e.tier < 2)
SELECT id, min(hops) AS hops FROM w GROUP BY id""")
def lineage_down(spark, d):
    return walk.reach(supply_graph(spark, d).filter("tier < 2").select("src", "dst"), spark.sql("SELECT 'region:1' AS id"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, w(id, hops) AS (SELECT 'part:5', 0 UNION SELECT e.src, w.hops + 1 FROM w JOIN edges e ON e.dst = w.id)
SELECT id, min(hops) AS hops FROM w GROUP BY id""")
def lineage_up(spark, d):
    return walk.reach(supply_graph(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.sql("SELECT 'part:5' AS id"))


_TREE = """tree AS (
  SELECT 'region:' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""


@query(f"""WITH RECURSIVE {_TREE}, c(ancestor, descendant, distance) AS (SELECT parent, id, 1 FROM tree WHERE parent IS NOT NULL
  UNION ALL SELECT t.parent, c.descendant, c.distance + 1 FROM c JOIN tree t ON t.id = c.ancestor WHERE t.parent IS NOT NULL)
SELECT ancestor, descendant, distance FROM c""")
def hierarchy_closure(spark, d):
    return walk.closure(supply_graph(spark, d).filter("kind IN ('contains', 'runs') AND NOT dst LIKE 'supplier:%'").select(F.col("dst").alias("id"), F.col("src").alias("parent")))


@query(f"""WITH {GRAPH_SQL}, stats AS (
  SELECT 'edge' AS what, kind, count(*) AS n FROM edges GROUP BY kind UNION ALL SELECT 'unresolved', kind, count(*) FROM edges WHERE dst NOT IN (SELECT src FROM edges) GROUP BY kind
  UNION ALL SELECT 'node', split_part(id, ':', 1), count(*) FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) GROUP BY 2)
SELECT what, kind, n FROM stats""")
def graph_statistics(spark, d):
    e = supply_graph(spark, d)
    sources = e.select(F.col("src").alias("_src")).distinct()
    flagged = e.join(sources, e["dst"] == sources["_src"], "left").withColumn("resolved", F.col("_src").isNotNull())
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("kind", F.split_part("id", F.lit(":"), F.lit(1)))
    return graph.statistics(nodes, flagged)


@query("""WITH p AS (SELECT DISTINCT regexp_replace(url, '^(https?://[^/]+).*', '\\1') AS prefix FROM pages UNION SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/[a-z]+/[0-9]') FROM pages WHERE page_id % 3 = 0)
SELECT page_id, url, prefix AS component FROM (SELECT page_id, url, prefix, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC NULLS LAST) AS k
FROM pages LEFT JOIN p ON starts_with(url, prefix) AND prefix <> '') WHERE k = 1""")
def component_owner(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    prefixes = pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("prefix")).union(pages.filter("page_id % 3 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[a-z]+/[0-9])", 1))).filter("prefix <> ''").distinct()
    return graph.longest_prefix(pages, "url", prefixes).withColumnRenamed("prefix", "component")


@query("""SELECT l.l_orderkey AS order_key, l.l_linenumber AS line, c.c_nationkey AS customer_nation, s.s_nationkey AS supplier_nation
FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey WHERE c.c_nationkey <> s.s_nationkey""")
def component_crossings(spark, d):
    t = lambda n: table(spark, d, n)
    edges = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    owners = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("component")).union(t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_nationkey"))
    return graph.crossings(edges, owners).select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("src_component").alias("customer_nation"), F.col("dst_component").alias("supplier_nation"))


@query("""SELECT l_partkey AS part, count(DISTINCT s_nationkey) AS users, string_agg(DISTINCT CAST(s_nationkey AS VARCHAR), ',' ORDER BY CAST(s_nationkey AS VARCHAR)) AS components
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey HAVING count(DISTINCT s_nationkey) > 1""")
def shared_resources(spark, d):
    uses = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("resource"), F.col("s_nationkey").cast("string").alias("component"))
    return graph.shared_by(uses).select(F.col("resource").alias("part"), "users", F.array_join("components", ",").alias("components"))


@query("""SELECT event_id, user_id, c_custkey IS NOT NULL AS resolved, CASE WHEN c_custkey IS NULL THEN 'unresolved:' || user_id ELSE CAST(user_id AS VARCHAR) END AS target,
CASE WHEN c_custkey IS NULL THEN 'no such customer' END AS reason FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) ON user_id = c_custkey""")
def unresolved_references(spark, d):
    known = table(spark, d, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("user_id"))
    return graph.resolve(table(spark, d, "events").select("event_id", "user_id"), known, "user_id", "no such customer")


@query("""SELECT r.o_orderkey AS ref, c.s_suppkey AS target FROM orders r LEFT JOIN (
  SELECT o.o_orderkey AS k, s.s_suppkey, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY CASE WHEN s.s_suppkey % 5 = o.o_orderkey % 5 THEN 0 ELSE 1 END, s.s_suppkey) AS n
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN supplier s ON s_nationkey = c_nationkey) c ON c.k = r.o_orderkey AND c.n = 1""")
def ranked_fallback(spark, d):
    t = lambda n: table(spark, d, n)
    refs = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("ref"), F.col("c_nationkey").alias("nation"), (F.col("o_orderkey") % 5).alias("class"))
    found = t("supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5).alias("class"), "s_suppkey")
    return graph.ranked_fallback(refs, found, ["nation"], ["class"], ["s_suppkey"], ["ref"]).select("ref", F.col("s_suppkey").alias("target"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, doc_id % 3 + 1 AS first, doc_id % 3 + 2 AS last, CASE WHEN lang = 'en' THEN 'the' ELSE 'de' END AS word FROM documents)
SELECT c.doc_id, c.word, coalesce(bool_or(contains(l.text, c.word)), false) AS ok FROM c LEFT JOIN lines l ON l.doc_id = c.doc_id AND l.line BETWEEN c.first AND c.last GROUP BY c.doc_id, c.word""")
def edge_line_check(spark, d):
    docs = table(spark, d, "documents")
    cited = docs.select(F.col("doc_id").alias("file"), (F.col("doc_id") % 3 + 1).alias("first"), (F.col("doc_id") % 3 + 2).alias("last"), F.when(F.col("lang") == "en", "the").otherwise("de").alias("word"))
    return graph.cited_lines(L.to_lines(docs, "doc_id", "text"), cited).select(F.col("file").alias("doc_id"), "word", "ok")


@query(f"""WITH {_LINES}, n AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS s FROM lines)
SELECT doc_id, CAST(s AS BIGINT) AS statement, min(line) AS first, max(line) AS last, sha256(string_agg(text, ' ' ORDER BY line)) AS digest FROM n WHERE s > 0 GROUP BY doc_id, s""")
def statement_fold(spark, d):
    folded = L.fold(L.to_lines(table(spark, d, "documents"), "doc_id", "text"), F.col("text").rlike("^[A-Z]"))
    return folded.select(F.col("file").alias("doc_id"), "statement", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.sha2("text", 256).alias("digest"))


@query("""WITH n AS (SELECT count(*) // 250 + 1 AS files FROM orders), c AS (SELECT o_orderkey AS id, o_orderkey % files AS file, (o_orderkey * 7919) % 20000 + 1 AS first, (o_orderkey * 7919) % 20000 + 4 AS last FROM orders, n),
h AS (SELECT event_id % files AS file, (event_id * 104729) % 20000 + 1 AS b, (event_id * 104729) % 20000 + 1 + event_id % 90 AS e FROM events, n)
SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file = c.file AND h.b <= c.last AND c.first <= h.e)""")
def outside_hunks(spark, d):
    orders = table(spark, d, "orders")
    files, k, e = orders.count() // 250 + 1, F.col("o_orderkey"), F.col("event_id")
    changes = orders.select(k.alias("id"), (k % files).alias("file"), (k * 7919 % 20000 + 1).alias("first"), (k * 7919 % 20000 + 4).alias("last"))
    hunks = table(spark, d, "events").select((e % files).alias("file"), (e * 104729 % 20000 + 1).alias("begin"), (e * 104729 % 20000 + 1 + e % 90).alias("end"))
    return graph.overlapping(changes, hunks).select("id")


@query("""SELECT l_orderkey AS file, CAST(k AS INTEGER) AS step, 'PGM' || l_partkey AS program, 'PROD.S' || l_suppkey AS dataset, CASE l_linenumber % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'SHR' ELSE 'OLD' END AS disposition
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)""")
def job_steps(spark, d):
    from pyspark.sql import Window as W

    n = F.col("k").cast("string")
    one = table(spark, d, "lineitem").withColumn("k", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    disp = F.when(F.col("l_linenumber") % 3 == 0, "").when(F.col("l_linenumber") % 3 == 1, ",DISP=SHR").otherwise(",DISP=(OLD,KEEP)")
    text = F.concat_ws("\n", F.concat(F.lit("//S"), n, F.lit(" EXEC PGM=PGM"), F.col("l_partkey").cast("string")), F.lit("//* DD NOTE=1"), F.concat(F.lit("//OUT DD DSN=PROD.S"), F.col("l_suppkey").cast("string"), F.lit(",")), F.concat(F.lit("//   UNIT=A"), disp), F.lit("//IN DD *"), F.lit("EXEC PGM=NOT"), F.lit("/*"))
    files = one.select("l_orderkey", F.struct("k", text.alias("t")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select("l_orderkey", F.concat(F.lit("//J JOB A\n"), F.array_join(F.transform("x", lambda x: x["t"]), "\n")).alias("t"))
    found = L.jcl(L.to_lines(files, "l_orderkey", "t"))
    steps = found.withColumn("line", F.col("first"))
    step = L.carried(L.carried(steps, F.when(F.col("kind") == "EXEC", F.col("name")), "step"), F.when(F.col("kind") == "EXEC", L.operand(F.col("operands"), "PGM")), "program")
    return step.filter("kind = 'DD' AND name = 'OUT'").select("file", F.expr("CAST(substring(step, 2) AS INT)").alias("step"), "program", L.operand(F.col("operands"), "DSN").alias("dataset"), L.disposition(F.col("operands")).alias("disposition"))


@query("""SELECT s_suppkey AS file, 'T' || s_suppkey AS name, 'PGM' || s_nationkey AS program, CASE WHEN s_suppkey % 2 = 0 THEN 'HIGH' END AS priority FROM supplier""")
def definitions(spark, d):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("* notes\nDEFINE TRANSACTION(T"), k, F.lit(") GROUP(G)\n  PROGRAM(PGM"), F.col("s_nationkey").cast("string"), F.lit(") PROGRAM(LATER)"), F.when(F.col("s_suppkey") % 2 == 0, "\n  PRIORITY(HIGH)").otherwise(""))
    found = L.definitions(L.to_lines(table(spark, d, "supplier").select("s_suppkey", text.alias("t")), "s_suppkey", "t"))
    return found.select("file", "name", F.col("options")["PROGRAM"].alias("program"), F.col("options")["PRIORITY"].alias("priority"))


@query("""SELECT p_partkey AS file, 'P' || p_size AS paragraph, kind, target, source FROM part, LATERAL (VALUES ('paragraph', 'P' || p_size, CAST(NULL AS VARCHAR)), ('performs', 'Q' || (p_size % 7), NULL), ('calls', 'SUB' || (p_size % 5), NULL), ('flows-to', 'TOTAL', 'PRICE-' || p_size)) v(kind, target, source)""")
def procedure_facts(spark, d):
    s = F.col("p_size")
    text = F.concat(F.lit("      * PERFORM NOTHING\n       P"), s, F.lit(".\n           PERFORM Q"), s % 7, F.lit(" THRU QX.\n           CALL 'SUB"), s % 5, F.lit("' USING A.\n           MOVE PRICE-"), s, F.lit(" TO TOTAL."))
    return L.procedure_facts(L.to_lines(table(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")).select("file", "paragraph", "kind", "target", "source")


@query("""SELECT p_partkey AS id, 'PART' || (p_size % 5) || ',T' || p_size || ',SUPP' AS reads, CASE WHEN p_size % 2 = 0 THEN 'LOG' || p_size ELSE 'STOCK' END AS writes FROM part""")
def sql_tables(spark, d):
    s = F.col("p_size").cast("string")
    sql = F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("INSERT INTO log"), s, F.lit(" "))).otherwise("UPDATE STOCK SET A = 1; "), F.lit("SELECT a FROM part"), F.col("p_size") % 5, F.lit(" p, t"), s, F.lit(" x JOIN supp ON 1 = 1 WHERE b IN (SELECT 1)"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.tables_read(sql), ",").alias("reads"), F.array_join(T.tables_written(sql), ",").alias("writes"))


@query(f"""WITH {COMMITS_SQL} SELECT change, ticket, row_number() OVER (PARTITION BY change ORDER BY p) AS rank FROM (
    SELECT change, record AS ticket, 0 AS p FROM commits WHERE record IS NOT NULL AND has_trailers UNION ALL SELECT change, regexp_extract(subject, '(INC[0-9]{{7}})'), 1 FROM commits WHERE contains(subject, 'INC')
    UNION ALL SELECT change, regexp_extract(subject, '^\\[(PAY-[1-9][0-9]*)\\]', 1), 2 FROM commits WHERE regexp_matches(subject, '^\\[PAY-[1-9]')
    UNION ALL SELECT change, record, 3 FROM commits WHERE record IS NOT NULL AND NOT has_trailers)""")
def ticket_refs(spark, d):
    c = commits(spark, d).withColumn("block", T.trailers(F.col("lines")))
    refs = T.tickets(F.col("lines"), F.col("block"))
    return c.select("change", F.posexplode(refs).alias("k", "t")).select("change", F.col("t.id").alias("ticket"), (F.col("k") + 1).cast("long").alias("rank"))


@query(f"""WITH {COMMITS_SQL}, p AS (SELECT change, author, email, approver AS name, approver_email AS mail FROM commits WHERE has_trailers)
SELECT change, approver, CASE WHEN approver IS NULL THEN NULL ELSE NOT same END AS independent, reviewer, agents FROM (
 SELECT c.change, p.name AS approver, CASE WHEN p.change IS NOT NULL THEN CASE WHEN c.email IS NOT NULL THEN lower(c.email) = lower(p.mail) ELSE lower(c.author) = lower(p.name) END END AS same,
   CASE WHEN c.has_trailers THEN c.reviewer END AS reviewer, CAST(CASE WHEN c.has_trailers AND c.bot THEN 1 ELSE 0 END AS INTEGER) AS agents FROM commits c LEFT JOIN p ON p.change = c.change)""")
def who(spark, d):
    c = commits(spark, d).withColumn("block", T.trailers(F.col("lines")))
    approvals = T.values_of(F.col("block"), "Approved-by")
    bot = lambda v: T.is_agent(*T.person(v))
    human = F.filter(approvals, lambda v: ~bot(v))
    c = c.withColumns({"first": F.get(human, F.lit(0)), "agents": F.size(F.filter(approvals, bot)), "review": F.get(T.values_of(F.col("block"), "Reviewed-by"), F.lit(0))})
    name, mail = T.person(F.col("first"))
    return c.select("change", name.alias("approver"), (~T.same_person(F.col("author"), F.col("email"), name, mail)).alias("independent"), T.person(F.col("review"))[1].alias("reviewer"), "agents").withColumn("independent", F.when(F.col("approver").isNotNull(), F.col("independent")))


@query(f"""WITH {COMMITS_SQL} SELECT change, array_to_string(list_filter([CASE WHEN NOT has_trailers THEN 'no approver' END, CASE WHEN NOT has_trailers THEN 'no reviewer' END, CASE WHEN record IS NULL OR NOT has_trailers THEN 'no change record' END, CASE WHEN email IS NULL THEN 'no address' END], lambda x: x IS NOT NULL), ';') AS gaps FROM commits""")
def record_gaps(spark, d):
    c = commits(spark, d).withColumn("block", T.trailers(F.col("lines")))
    none = lambda key, says: F.when(F.size(T.values_of(F.col("block"), key)) == 0, says)
    return c.select("change", F.array_join(F.array(none("Approved-by", "no approver"), none("Reviewed-by", "no reviewer"), none("Change", "no change record"), F.when(F.col("email").isNull(), "no address")), ";").alias("gaps"))


_PEOPLE = """people AS (SELECT o_orderkey AS change, 'approver' AS role, 'p' || (o_orderkey % 7) AS person FROM orders UNION ALL SELECT o_orderkey, 'approver', 'p' || (o_custkey % 7) FROM orders WHERE o_orderkey % 3 <> 0
 UNION ALL SELECT o_orderkey, 'implementer', 'p' || (o_custkey % 5) FROM orders UNION ALL SELECT o_orderkey, 'agent', 'bot' FROM orders WHERE o_orderkey % 4 = 0)"""


def _people(spark, d):
    o = table(spark, d, "orders")
    p = lambda c, m: F.concat(F.lit("p"), (F.col(c) % m).cast("string"))
    row = lambda df, role, who_: df.select(F.col("o_orderkey").alias("change"), F.lit(role).alias("role"), who_.alias("person"))
    return (row(o, "approver", p("o_orderkey", 7)).unionByName(row(o.filter("o_orderkey % 3 <> 0"), "approver", p("o_custkey", 7))).unionByName(row(o, "implementer", p("o_custkey", 5))).unionByName(row(o.filter("o_orderkey % 4 = 0"), "agent", F.lit("bot"))))


_RULES = f"""WITH {_PEOPLE}, ind AS (SELECT c.change, count(DISTINCT a.person) AS n FROM (SELECT DISTINCT change FROM people) c LEFT JOIN (SELECT * FROM people a WHERE role = 'approver' AND NOT EXISTS (SELECT 1 FROM people m WHERE m.role = 'implementer' AND m.change = a.change AND m.person = a.person)) a ON a.change = c.change GROUP BY c.change),
f AS (SELECT o_orderkey AS change, o_orderpriority = '1-URGENT' AS high, o_orderkey % 4 = 0 AS agent, n FROM orders JOIN ind ON change = o_orderkey),
s AS (SELECT change, 'two-approvers' AS rule, CASE WHEN NOT high THEN 'not-evaluated' WHEN n < 2 THEN 'fail' ELSE 'pass' END AS status FROM f
 UNION ALL SELECT change, 'agent-approval', CASE WHEN NOT agent THEN 'not-evaluated' WHEN n = 0 THEN 'fail' ELSE 'pass' END FROM f)"""


def _statuses(spark, d):
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("change"), (F.col("o_orderpriority") == "1-URGENT").alias("high"), (F.col("o_orderkey") % 4 == 0).alias("agent")).join(gate.independent_approvals(_people(spark, d)), "change")
    return gate.rule_rows(facts, "two-approvers", F.col("high"), F.col("independent") < 2).unionByName(gate.rule_rows(facts, "agent-approval", F.col("agent"), F.col("independent") == 0))


@query(f"{_RULES} SELECT change, rule, status FROM s")
def rule_statuses(spark, d):
    return _statuses(spark, d)


@query(f"{_RULES} SELECT change, count(*) FILTER (status = 'fail') = 0 AS ok, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (status = 'fail'), '') AS failed FROM s GROUP BY change")
def gate_status(spark, d):
    return gate.gate(_statuses(spark, d)).select("change", "ok", F.array_join("failed", ",").alias("failed"))


_CALL = "CASE p_size % 6 WHEN 0 THEN 'CALL-RSA-SIGN' WHEN 1 THEN 'ecdsa_verify' WHEN 2 THEN 'AES256' WHEN 3 THEN 'SHA-1' WHEN 4 THEN 'sha256' ELSE 'HASH-X' END"
_ALGORITHM = "CASE p_size % 6 WHEN 0 THEN 'RSA' WHEN 1 THEN 'EC' WHEN 2 THEN 'AES' WHEN 3 THEN 'SHA-1' WHEN 4 THEN 'SHA-2' ELSE 'unknown' END"


def _calls(spark, d):
    p = F.col("p_size") % 6
    name = F.when(p == 0, "CALL-RSA-SIGN").when(p == 1, "ecdsa_verify").when(p == 2, "AES256").when(p == 3, "SHA-1").when(p == 4, "sha256").otherwise("HASH-X")
    return table(spark, d, "part").select("p_partkey", "p_brand", name.alias("call"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 64).alias("bits")).withColumn("algorithm", T.algorithm(F.col("call"))).withColumn("vulnerable", T.vulnerable(F.col("algorithm")))


@query(f"SELECT p_partkey AS id, {_CALL} AS call, {_ALGORITHM} AS algorithm, CASE WHEN p_size % 6 = 5 THEN NULL ELSE p_size % 6 < 2 END AS vulnerable FROM part")
def crypto_inventory(spark, d):
    return _calls(spark, d).select(F.col("p_partkey").alias("id"), "call", "algorithm", "vulnerable")


@query(f"""WITH c AS (SELECT p_partkey AS k, {_ALGORITHM} AS alg, CASE WHEN p_size % 5 > 0 THEN p_size * 64 END AS bits, CASE WHEN p_size % 6 = 5 THEN NULL ELSE p_size % 6 < 2 END AS bad FROM part)
SELECT a.k AS id, coalesce(a.bad, false) AND NOT (a.alg IS NOT DISTINCT FROM b.alg AND a.bits IS NOT DISTINCT FROM b.bits AND coalesce(b.bad, false)) AS denied, a.bad IS NULL AS warned FROM c a LEFT JOIN c b ON b.k = a.k + 6""")
def crypto_rule(spark, d):
    now = _calls(spark, d)
    was = now.select((F.col("p_partkey") - 6).alias("p_partkey"), F.col("algorithm").alias("a0"), F.col("bits").alias("b0"), F.col("vulnerable").alias("v0"))
    c = F.col
    return now.join(was, "p_partkey", "left").select(c("p_partkey").alias("id"), gate.crypto_denied((c("a0"), c("b0"), c("v0")), (c("algorithm"), c("bits"), c("vulnerable"))).alias("denied"), c("vulnerable").isNull().alias("warned"))


@query("""WITH s AS (SELECT DISTINCT c_mktsegment AS classification, n_regionkey AS region, c_custkey % 4 AS tier FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT r_name AS profile, r_regionkey AS home, 2 AS most FROM region)
SELECT classification, region, tier, profile, array_to_string(list_filter([CASE WHEN classification = 'BUILDING' AND tier = 3 THEN 'secret data stays' END, CASE WHEN region <> home THEN 'leaves its region' END, CASE WHEN tier > most THEN 'tier too high' END], lambda x: x IS NOT NULL), ';') AS broken FROM s, p""")
def egress_matrix(spark, d):
    s = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("region"), (F.col("c_custkey") % 4).alias("tier")).distinct()
    settings = s.withColumns({"classification": F.when(F.col("segment") == "BUILDING", "secret").otherwise("open"), "backend": F.when(F.col("tier") == 3, "remote").otherwise("local")})
    profiles = table(spark, d, "region").select(F.col("r_name").alias("profile"), F.col("r_regionkey").alias("home"), F.lit(2).alias("most"))
    return gate.egress(settings, profiles).select(F.col("segment").alias("classification"), "region", "tier", "profile", F.array_join("broken", ";").alias("broken"))


@query("""WITH w AS (SELECT n_name AS framework, r_name AS control, k.kind FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('view'), ('refund'), ('signup')) k(kind)), h AS (SELECT DISTINCT event_type AS kind FROM events)
SELECT framework, control, count(*) AS needed, count(h.kind) AS present FROM w LEFT JOIN h ON h.kind = w.kind GROUP BY framework, control""")
def control_evidence(spark, d):
    frameworks = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("framework"), F.col("r_name").alias("control"), F.array(F.lit("view"), F.lit("refund"), F.lit("signup")).alias("needs"))
    return gate.controls(table(spark, d, "events").select(F.col("event_type").alias("kind")), frameworks)


@query("""SELECT o_orderkey AS id, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS digest FROM orders""")
def ledger_digest(spark, d):
    return rollup.digests(table(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_custkey", "o_orderpriority", "o_orderkey"], 256).withColumnRenamed("o_orderkey", "id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'missing' WHEN o_orderkey % 31 = 0 THEN 'invalid' ELSE 'valid' END AS status FROM orders""")
def verified_release(spark, d):
    o = table(spark, d, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus"]
    changed = o.filter("o_orderkey % 23 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 31 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return rollup.verified(rollup.digests(o, "o_orderkey", cols), rollup.digests(changed, "o_orderkey", cols), "o_orderkey").withColumnRenamed("o_orderkey", "id")

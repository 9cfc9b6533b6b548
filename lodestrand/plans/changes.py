"""Queries on commit messages: tickets, people, reasons, open items, and the facts that rules read. Their SQL parses the same messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import change, gate
from lodestrand.plans.derive import MESSAGES_SQL, messages, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Lines, whether each is a trailer, and trailers' keys and values, by expressions over the texts.
_PARSED = rf"""{MESSAGES_SQL},
s AS (SELECT change, author, email, string_split(text, chr(10)) AS lines FROM messages),
b AS (SELECT *, list_max(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN trim(lines[i]) = '' THEN i ELSE 0 END)) AS blank FROM s),
c AS (SELECT *, CASE WHEN blank > 0 AND blank < len(lines) AND len(list_filter(lines[blank + 1:], lambda x: NOT regexp_matches(x, '^[A-Za-z0-9][A-Za-z0-9-]*:[ \t]+\S'))) = 0 THEN blank ELSE len(lines) END AS body FROM b),
l AS (SELECT change, author, email, body, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM c),
t AS (SELECT change, author, email, k, lower(regexp_extract(line, '^([^:]+):', 1)) AS key, rtrim(regexp_extract(line, '^[^:]+:[ \t]+(\S.*)$', 1)) AS value FROM l WHERE k > body),
p AS (SELECT *, CASE WHEN regexp_matches(value, '<[^<>@\s]+@[^<>\s]+>$') THEN trim(regexp_replace(value, '<[^<>]+>$', '')) ELSE trim(value) END AS name, nullif(regexp_extract(value, '<([^<>@\s]+@[^<>\s]+)>$', 1), '') AS mail FROM t),
q AS (SELECT *, regexp_matches(name, '(?i)(\[bot\]$|\bbot$)') OR regexp_matches(coalesce(mail, ''), '(?i)(^|[-_.+])bot@') AS bot FROM p),
named(change, k, part, ids, place) AS (
  SELECT change, k, 0, regexp_extract_all(value, '\b((?:CHG|CTASK|INC|PRB|RITM|REQ)[0-9]{{7}})\b', 1), 'trailer' FROM t WHERE NOT (key IN ('requested-by', 'approved-by', 'reviewed-by', 'signed-off-by', 'co-authored-by', 'acked-by', 'tested-by', 'assisted-by', 'generated-by', 'ai-agent'))
  UNION ALL SELECT change, k, 1, regexp_extract_all(value, '\b([A-Z][A-Z0-9]{{1,9}}-[1-9][0-9]*)\b', 1), 'trailer' FROM t WHERE NOT (key IN ('requested-by', 'approved-by', 'reviewed-by', 'signed-off-by', 'co-authored-by', 'acked-by', 'tested-by', 'assisted-by', 'generated-by', 'ai-agent'))
  UNION ALL SELECT change, 1000 + k, 0, regexp_extract_all(line, '\b((?:CHG|CTASK|INC|PRB|RITM|REQ)[0-9]{{7}})\b', 1), CASE k WHEN 1 THEN 'subject' ELSE 'body' END FROM l WHERE k <= body
  UNION ALL SELECT change, 1001, 1, list_filter([regexp_extract(line, '^\[?([A-Z][A-Z0-9]{{1,9}}-[1-9][0-9]*)\]?[:\s]', 1)], lambda x: x <> ''), 'subject' FROM l WHERE k = 1
  UNION ALL SELECT change, 1000 + k, 2, regexp_extract_all(line, '\[([A-Z][A-Z0-9]{{1,9}}-[1-9][0-9]*)\]', 1), CASE k WHEN 1 THEN 'subject' ELSE 'body' END FROM l WHERE k <= body),
ids AS (SELECT change, k, part, place, unnest(ids) AS ticket, generate_subscripts(ids, 1) AS n FROM named),
firsts AS (SELECT *, row_number() OVER (PARTITION BY change, ticket ORDER BY k, part, n) AS seen FROM ids),
refs AS (SELECT change, ticket, place, row_number() OVER (PARTITION BY change ORDER BY k, part, n) AS rank FROM firsts WHERE seen = 1)"""


def _parsed(spark, d):
    return messages(spark, d).withColumn("lines", F.split("text", "\n")).withColumn("block", T.trailers(F.col("lines")))


@query(f"WITH {_PARSED} SELECT change, ticket, place, rank FROM refs")
def ticket_places(spark, d):
    m = _parsed(spark, d)
    found = m.select("change", F.posexplode(T.tickets(F.col("lines"), F.col("block"))).alias("k", "t"))
    return found.select("change", F.col("t.id").alias("ticket"), F.col("t.place").alias("place"), (F.col("k") + 1).cast("long").alias("rank"))


@query(f"""WITH {_PARSED}, r AS (SELECT change, arg_min(ticket, rank) AS request FROM refs WHERE ticket LIKE 'CHG%' AND regexp_matches(ticket, '^CHG[0-9]{{7}}$') GROUP BY change),
y AS (SELECT change, lower(trim(arg_min(value, k))) AS type FROM t WHERE key = 'change-type' GROUP BY change)
SELECT m.change, split_part(m.text, chr(10), 1) AS subject, r.request, y.type AS change_type, y.type IN ('emergency', 'expedited') AS emergency FROM messages m LEFT JOIN r ON r.change = m.change LEFT JOIN y ON y.change = m.change""")
def change_reasons(spark, d):
    return _parsed(spark, d).select("change", *[c.alias(n) for n, c in change.why(F.col("lines"), F.col("block")).items()])


@query(f"""WITH {_PARSED}, a AS (SELECT change, k, row_number() OVER (PARTITION BY change ORDER BY k) AS n, name, mail, CASE WHEN mail IS NOT NULL AND email IS NOT NULL THEN lower(mail) = lower(email) ELSE lower(name) = lower(author) END AS own FROM q WHERE key = 'approved-by' AND NOT bot),
w AS (SELECT change, count(*) AS approvers, bool_or(NOT own) AS independent, bool_or(own) AS same FROM a GROUP BY change), z AS (SELECT change, count(*) AS n FROM t WHERE key = 'requested-by' GROUP BY change),
r AS (SELECT change, count(*) AS n FROM refs WHERE regexp_matches(ticket, '^CHG[0-9]{{7}}$') GROUP BY change), y AS (SELECT DISTINCT change FROM t WHERE key = 'change-type')
SELECT m.change, array_to_string(list_filter([CASE WHEN z.n IS NULL THEN 'no requester recorded' END, CASE WHEN w.approvers IS NULL THEN 'no approver recorded' WHEN NOT w.independent THEN 'an approver is also the implementer' WHEN w.same THEN 'an approver also implemented the change; another approver did not' END,
  CASE WHEN r.n IS NULL THEN 'no change request number' END, CASE WHEN y.change IS NULL THEN 'change type not recorded' END], lambda x: x IS NOT NULL), ';') AS items
FROM messages m LEFT JOIN w ON w.change = m.change LEFT JOIN z ON z.change = m.change LEFT JOIN r ON r.change = m.change LEFT JOIN y ON y.change = m.change""")
def open_items(spark, d):
    m = _parsed(spark, d)
    me = F.array(T.person_struct(F.col("author"), F.col("email")))
    return m.select("change", F.array_join(change.open_items(F.col("lines"), F.col("block"), me), ";").alias("items"))


@query(f"""WITH {_PARSED} SELECT change, count(*) FILTER (key IN ('assisted-by', 'generated-by', 'ai-agent') OR key IN ('requested-by', 'approved-by', 'reviewed-by', 'signed-off-by', 'co-authored-by', 'acked-by', 'tested-by') AND bot) AS agents,
coalesce(string_agg(name, ',' ORDER BY k) FILTER (key IN ('assisted-by', 'generated-by', 'ai-agent') OR key IN ('requested-by', 'approved-by', 'reviewed-by', 'signed-off-by', 'co-authored-by', 'acked-by', 'tested-by') AND bot), '') AS names FROM q GROUP BY change""")
def automatic_authors(spark, d):
    found = _parsed(spark, d).filter(F.size("block") > 0).select("change", T.agents(F.col("block")).alias("a"))
    return found.select("change", F.size("a").cast("long").alias("agents"), F.array_join(F.transform("a", lambda x: T.person(T.value_of(x))[0]), ",").alias("names"))


@query("""WITH e AS (SELECT l_suppkey AS change, o_orderkey AS k, 'User ' || (o_custkey % 5) AS name, CASE WHEN o_orderkey % 3 > 0 THEN 'u' || (o_custkey % 4) || '@example.org' END AS mail FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT change, name, mail, min(k) AS k FROM e GROUP BY ALL), w AS (SELECT change, list({'name': name, 'mail': mail} ORDER BY k, name, mail) AS all_ FROM g GROUP BY change)
SELECT change, array_to_string(list_transform(list_reduce(list_transform(all_, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: CASE WHEN y.mail IS NOT NULL AND x[1].mail IS NOT NULL THEN lower(y.mail) = lower(x[1].mail) ELSE lower(y.name) = lower(x[1].name) END)) > 0 THEN kept ELSE list_concat(kept, x) END), lambda y: y.name || ' ' || coalesce(y.mail, '-')), ',') AS people FROM w""")
def implementers(spark, d):
    """The people behind a supplier's orders, in order, each once."""
    k = F.col("o_orderkey")
    e = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == k).select(
        F.col("l_suppkey").alias("change"), k.alias("k"), F.concat(F.lit("User "), (F.col("o_custkey") % 5).cast("string")).alias("name"),
        F.when(k % 3 > 0, F.concat(F.lit("u"), (F.col("o_custkey") % 4).cast("string"), F.lit("@example.org"))).alias("email"))
    once = e.groupBy("change", "name", "email").agg(F.min("k").alias("k"))
    merged = once.groupBy("change").agg(F.array_sort(F.collect_list(F.struct("k", "name", F.col("email").isNull().alias("none"), "email"))).alias("all"))
    people = change.distinct_people(F.transform("all", lambda p: T.person_struct(p["name"], p["email"])))
    return merged.select("change", F.array_join(F.transform(people, lambda p: F.concat_ws(" ", p["name"], F.coalesce(p["email"], F.lit("-")))), ",").alias("people"))


_RUNS = """v AS (SELECT o_orderkey AS change, o_custkey % 5 AS p, count(l_orderkey) AS tests, count(*) FILTER (l_tax > 0.07 AND l_discount > 0.09) AS different, count(*) FILTER (l_linenumber = 7 AND l_quantity > 45) AS errors FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
w AS (SELECT change, CASE WHEN different > 0 THEN 'not-equivalent' WHEN errors > 0 OR p = 4 OR tests = 0 THEN 'inconclusive' ELSE 'equivalent' END AS verdict, tests, different, errors, CAST(CASE WHEN p = 4 THEN 1 ELSE 0 END AS INTEGER) AS untested FROM v)"""


@query(f"WITH {_RUNS} SELECT change, verdict, CASE verdict WHEN 'not-equivalent' THEN 'fail' WHEN 'inconclusive' THEN 'inconclusive' ELSE 'pass' END AS status, tests, different, errors, untested FROM w")
def equivalence_rule(spark, d):
    """The rule on behaviour: a difference fails; untested programs, errors and changes without any test prove nothing."""
    o, line = table(spark, d, "orders").select(F.col("o_orderkey").alias("change"), "o_custkey"), table(spark, d, "lineitem")
    n = lambda c: F.count_if(c)
    facts = o.join(line, F.col("change") == F.col("l_orderkey"), "left").groupBy("change", "o_custkey").agg(
        F.count("l_orderkey").alias("tests"), n((F.col("l_tax") > 0.07) & (F.col("l_discount") > 0.09)).alias("different"), n((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45)).alias("errors"))
    facts = facts.withColumn("untested", F.when(F.col("o_custkey") % 5 == 4, 1).otherwise(0))
    return gate.equivalence_rule(facts).select("change", "verdict", "status", "tests", "different", "errors", "untested")


@query(f"""WITH {_PARSED}, people AS (SELECT DISTINCT change, 'approver' AS role, coalesce(lower(mail), lower(name)) AS person FROM q WHERE key = 'approved-by' AND NOT bot UNION SELECT change, 'implementer', coalesce(lower(email), lower(author)) FROM messages)
SELECT m.change, (SELECT coalesce(string_agg(person, ',' ORDER BY person), '') FROM people p WHERE p.change = m.change AND role = 'approver') AS approvers, (SELECT coalesce(string_agg(person, ',' ORDER BY person), '') FROM people p WHERE p.change = m.change AND role = 'implementer') AS implementers,
o_orderpriority = '1-URGENT' AS high FROM messages m JOIN orders ON o_orderkey = m.change""")
def policy_facts(spark, d):
    """What rules read of a change: people by role, and whether a component of high criticality is touched."""
    m = _parsed(spark, d)
    who: Column = F.transform(F.filter(T.people_of(F.col("block"), "Approved-by"), lambda p: ~T.is_agent(p["name"], p["email"])), lambda p: F.lower(F.coalesce(p["email"], p["name"])))
    rows = m.select("change", F.array_sort(F.array_distinct(who)).alias("approvers"), F.array(F.lower(F.coalesce("email", "author"))).alias("implementers"))
    high = table(spark, d, "orders").select(F.col("o_orderkey").alias("change"), (F.col("o_orderpriority") == "1-URGENT").alias("high"))
    return rows.join(high, "change").select("change", F.array_join("approvers", ",").alias("approvers"), F.array_join("implementers", ",").alias("implementers"), "high")

"""Queries on bank products, behaviour, covers, risk, scorecards and the ledger stream, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import bank, behave, cover, exact_cover, rollup
from lodestrand.plans.derive import cents, table
from lodestrand.streaming import ledger

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ACCOUNTS = """accounts AS (SELECT c_custkey AS account, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, CAST(50000 AS BIGINT) AS overdraft,
  CASE c_custkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'C' ELSE 'X' END AS product, c_custkey % 40 + 1 AS days FROM customer)"""
_INTEREST = """interest AS (SELECT account, balance, CASE WHEN balance <= 0 OR product = 'X' THEN 0 ELSE
  (2 * balance * (CASE WHEN product = 'C' THEN 1000 WHEN balance <= 500000 THEN 12500 ELSE 20000 END) * days + 365000000) // 730000000 END AS interest,
  CASE WHEN balance <= 0 THEN 'N' WHEN product = 'X' THEN 'B' WHEN days > 31 THEN 'L' ELSE ' ' END AS flag FROM accounts)"""


def _accounts(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("account"), cents("c_acctbal").alias("balance"), F.lit(50_000).cast("long").alias("overdraft"), F.when(k % 3 == 0, "S").when(k % 3 == 1, "C").otherwise("X").alias("product"), (k % 40 + 1).alias("days"))


@query(f"WITH {_ACCOUNTS}, {_INTEREST} SELECT account, CAST(interest AS BIGINT) AS interest, flag FROM interest")
def interest_accrual(spark, d):
    made = bank.interest(F.col("balance"), F.col("days"), F.col("product"))
    return _accounts(spark, d).select("account", made["interest"].alias("interest"), made["flag"].alias("flag"))


_FEES = """f AS (SELECT c_custkey AS account, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'T' WHEN 'HOUSEHOLD' THEN 'R' WHEN 'FURNITURE' THEN 'R' ELSE '?' END AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS average, count(o_orderkey) AS items
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
fees AS (SELECT account, CAST(CASE WHEN segment = 'R' AND average < 150000 THEN 500 WHEN segment = 'B' THEN 1000 + greatest(items - 10, 0) * 25 ELSE 0 END AS BIGINT) AS fee,
 CASE segment WHEN 'T' THEN 'W' WHEN 'R' THEN CASE WHEN average >= 150000 THEN 'W' ELSE 'C' END WHEN 'B' THEN 'C' ELSE 'E' END AS code FROM f)"""


def _fees(spark, d):
    items = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("items"))
    s = F.col("c_mktsegment")
    segment = F.when(s == "BUILDING", "B").when(s == "MACHINERY", "T").when(s.isin("HOUSEHOLD", "FURNITURE"), "R").otherwise("?")
    made = bank.fee(cents("c_acctbal"), F.coalesce("items", F.lit(0)), segment)
    return table(spark, d, "customer").join(items, "c_custkey", "left").select(F.col("c_custkey").alias("account"), made["fee"].alias("fee"), made["code"].alias("code"))


@query(f"WITH {_FEES} SELECT account, fee, code FROM fees")
def fee_assessment(spark, d):
    return _fees(spark, d)


@query("""WITH p AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) - 1000000 AS amount, CASE WHEN o_orderkey % 20 = 0 THEN 'EUR' ELSE 'USD' END AS currency, (o_orderkey % 9) * 1000000 AS used,
  CASE o_orderkey % 4 WHEN 0 THEN 'WEB' WHEN 1 THEN 'ATM' WHEN 2 THEN 'BRANCH' ELSE 'MAIL' END AS channel FROM orders),
s AS (SELECT *, CASE WHEN currency <> 'USD' THEN 'R' WHEN amount <= 0 THEN 'I' WHEN used + amount > CASE channel WHEN 'WEB' THEN 20000000 WHEN 'ATM' THEN 5000000 WHEN 'BRANCH' THEN 50000000 ELSE 0 END THEN 'D' ELSE 'A' END AS decision FROM p)
SELECT id, decision, CASE WHEN decision = 'A' AND amount >= 40000000 THEN 'Y' ELSE 'N' END AS report FROM s""")
def payment_screen(spark, d):
    k = F.col("o_orderkey")
    channel = F.when(k % 4 == 0, "WEB").when(k % 4 == 1, "ATM").when(k % 4 == 2, "BRANCH").otherwise("MAIL")
    made = bank.screen(cents("o_totalprice") - 1_000_000, F.when(k % 20 == 0, "EUR").otherwise("USD"), (k % 9) * 1_000_000, channel)
    return table(spark, d, "orders").select(k.alias("id"), made["decision"].alias("decision"), made["report"].alias("report"))


_POSTINGS = """postings AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END AS account, CASE o_orderkey % 5 WHEN 0 THEN 'C' WHEN 4 THEN 'X' ELSE 'D' END AS type, CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders),
posted AS (SELECT p.*, balance, CASE WHEN balance IS NULL THEN 'unknown account' WHEN type = 'X' THEN 'bad type' WHEN type = 'D' AND balance - amount < -overdraft THEN 'over limit' END AS reject FROM postings p LEFT JOIN accounts a ON a.account = p.account),
done AS (SELECT seq, account, type, amount, balance, CASE WHEN reject IS NOT NULL THEN balance WHEN type = 'C' THEN balance + amount WHEN balance - amount < 0 THEN balance - amount - 2500 ELSE balance - amount END AS after, reject FROM posted)"""


def _posted(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("seq"), F.when(k % 50 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("account"), F.when(k % 5 == 0, "C").when(k % 5 == 4, "X").otherwise("D").alias("type"), F.round("o_totalprice").cast("long").alias("amount"))
    return bank.post(rows, _accounts(spark, d).select("account", "balance", "overdraft"))


@query(f"WITH {_ACCOUNTS}, {_POSTINGS} SELECT seq, account, after, reject FROM done")
def posting(spark, d):
    return _posted(spark, d).select("seq", "account", "after", "reject")


@query(f"""WITH {_ACCOUNTS}, {_INTEREST}, {_FEES}, {_POSTINGS}, l AS (SELECT account, arg_max(after, seq) AS p FROM done WHERE balance IS NOT NULL GROUP BY account)
SELECT i.account, i.balance, CAST(coalesce(l.p, i.balance + i.interest) - coalesce(fees.fee, 0) AS BIGINT) AS closing FROM interest i LEFT JOIN l ON l.account = i.account LEFT JOIN fees ON fees.account = i.account""")
def settle_last_write(spark, d):
    return bank.settle(_accounts(spark, d).select("account", "balance"), interest_accrual(spark, d).select("account", "interest"), _posted(spark, d), _fees(spark, d).select("account", "fee"))


@query(f"""WITH {_ACCOUNTS}, {_INTEREST}, {_FEES}, {_POSTINGS}, l AS (SELECT account, sum(after - balance) AS p FROM done WHERE balance IS NOT NULL GROUP BY account)
SELECT i.account, i.balance, CAST(i.balance + i.interest + coalesce(l.p, 0) - coalesce(fees.fee, 0) AS BIGINT) AS closing FROM interest i LEFT JOIN l ON l.account = i.account LEFT JOIN fees ON fees.account = i.account""")
def settle_cumulative(spark, d):
    return bank.settle(_accounts(spark, d).select("account", "balance"), interest_accrual(spark, d).select("account", "interest"), _posted(spark, d), _fees(spark, d).select("account", "fee"), cumulative=True)


_RUNS = """runs AS (SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS test, l_returnflag AS program, l_linenumber AS ln, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(round(l_discount * 100) AS BIGINT) AS disc FROM lineitem),
one AS (SELECT test * 100 + row_number() OVER (PARTITION BY test ORDER BY program, ln, price, disc) AS test, program, ln, price, disc FROM runs)"""


def _runs(spark, d):
    line = table(spark, d, "lineitem")
    key = (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("test")
    rows = line.select(key, F.col("l_returnflag").alias("program"), F.col("l_linenumber").alias("ln"), cents("l_extendedprice").alias("price"), F.round(F.col("l_discount") * 100).cast("long").alias("disc"))
    again = F.row_number().over(W.partitionBy("test").orderBy("program", "ln", "price", "disc"))  # runs with one key are all kept
    one = rows.withColumn("test", F.col("test") * 100 + again)
    old = F.call_function("div", F.col("price") * (100 - F.col("disc")), F.lit(100))
    new = F.when((F.col("program") == "R") & (F.col("disc") >= 9), old + 1).otherwise(old)
    base = one.withColumns({"output": old, "rc": F.lit(0)})
    head = one.filter("ln <> 7 OR program <> 'N'").withColumns({"output": new, "rc": F.lit(0)})
    return one, base, head


_RESULT = """res AS (SELECT test, program, CASE WHEN program = 'N' AND ln = 7 THEN 'error' WHEN program = 'R' AND disc >= 9 THEN 'different' ELSE 'same' END AS result FROM one)"""


@query(f"WITH {_RUNS}, {_RESULT} SELECT test, result FROM res")
def behaviour_compare(spark, d):
    _, base, head = _runs(spark, d)
    return behave.compare(base, head, "test")


@query(f"""WITH {_RUNS}, {_RESULT}, o AS (SELECT program FROM res UNION SELECT substr(o_orderpriority, 1, 1) FROM orders)
SELECT o.program, count(result) AS tests, count(*) FILTER (result = 'different') AS different, count(*) FILTER (result = 'error') AS errors, count(*) FILTER (result = 'untested') AS untested,
CASE WHEN count(*) FILTER (result = 'different') > 0 THEN 'not-equivalent' WHEN count(result) = 0 OR count(*) FILTER (result <> 'same') > 0 THEN 'inconclusive' ELSE 'equivalent' END AS verdict FROM o LEFT JOIN res ON res.program = o.program GROUP BY o.program""")
def behaviour_verdict(spark, d):
    """Programs with runs, and others that the change touches and nobody ran."""
    one, base, head = _runs(spark, d)
    owners = one.select("program").union(table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1)))
    return behave.verdict(behave.compare(base, head, "test").join(one.select("test", "program"), "test"), ["program"], owners)


@query("""WITH f AS (SELECT p_brand AS field, CAST(-999 AS BIGINT) AS low, CAST(999 + p AS BIGINT) AS top FROM (SELECT p_brand, max(p_size) AS p FROM part GROUP BY 1)), l AS (SELECT DISTINCT p_brand AS field, CAST(p_size * 20 AS BIGINT) AS literal FROM part),
c AS (SELECT field, literal + k.k AS value FROM l, (VALUES (-1), (0), (1)) k(k) UNION SELECT field, low FROM f UNION SELECT field, 0 FROM f UNION SELECT field, top FROM f)
SELECT DISTINCT c.field, CAST(c.value AS BIGINT) AS value FROM c JOIN f ON f.field = c.field WHERE value BETWEEN low AND top""")
def boundary_candidates(spark, d):
    part = table(spark, d, "part")
    fields = part.groupBy(F.col("p_brand").alias("field")).agg(F.lit(-999).cast("long").alias("low"), (F.max("p_size") + 999).cast("long").alias("top"))
    return behave.boundary_pool(fields, part.select(F.col("p_brand").alias("field"), (F.col("p_size") * 20).cast("long").alias("literal")).distinct(), F.lit(1))


@query("""WITH seeds AS (SELECT p_partkey AS seed, p_size AS size, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part), pool AS (SELECT DISTINCT 'size' AS field, CAST(p_size AS BIGINT) AS value FROM part UNION SELECT 'price', CAST(p_size * 100 AS BIGINT) FROM part)
SELECT seed, field, value, CASE field WHEN 'size' THEN value ELSE size END AS size, CASE field WHEN 'price' THEN value ELSE price END AS price FROM seeds, pool""")
def input_variants(spark, d):
    part = table(spark, d, "part")
    seeds = part.select(F.col("p_partkey").alias("seed"), F.create_map(F.lit("size"), F.col("p_size").cast("long"), F.lit("price"), F.floor("p_retailprice").cast("long")).alias("inputs"))
    sizes = part.select(F.col("p_size").cast("long").alias("s")).distinct()
    pool = sizes.select(F.lit("size").alias("field"), F.col("s").alias("value")).unionByName(sizes.select(F.lit("price").alias("field"), (F.col("s") * 100).alias("value")))
    return behave.variants(seeds, pool).select("seed", "field", "value", F.col("inputs")["size"].alias("size"), F.col("inputs")["price"].alias("price"))


@query("""SELECT user_id AS owner, count(*) AS readings, count(*) FILTER (event_id % 97 = 0) AS moved FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 97 = 0) > 0""")
def unstable_owners(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("owner"), "value")
    again = e.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return behave.unstable(e, again, ["event_id"], "value", "owner")


@query("""WITH t AS (SELECT o_orderkey AS test, [CASE WHEN o_totalprice > 200000 THEN 'c1:T' ELSE 'c1:F' END, CASE WHEN o_orderstatus = 'O' THEN 'c2:T' ELSE 'c2:F' END] AS covers, o_orderkey % 50 AS line FROM orders)
SELECT test, need FROM (SELECT test, 'outcome:' || unnest(covers) AS need FROM t UNION ALL SELECT test, 'line:' || line FROM t) WHERE need IN ('outcome:c1:T', 'outcome:c2:F') OR need IN (SELECT 'line:' || p_size FROM part WHERE p_size % 4 = 0)""")
def test_obligations(spark, d):
    o = table(spark, d, "orders")
    covers = behave.outcomes(o.withColumnRenamed("o_orderkey", "test"), {"c1": F.col("o_totalprice") > 200_000, "c2": F.col("o_orderstatus") == "O"})
    tests = covers.withColumn("lines", F.array(F.col("test") % 50))
    lines = table(spark, d, "part").filter("p_size % 4 = 0").select(F.lit("line").alias("kind"), F.col("p_size").cast("string").alias("item")).distinct()
    wanted = lines.unionByName(spark.sql("SELECT * FROM VALUES ('outcome', 'c1:T'), ('outcome', 'c2:F') AS t(kind, item)"))
    return behave.obligations(tests, wanted)


@query("""SELECT l_returnflag || l_linenumber AS bug, bool_or(l_quantity >= 49 AND l_returnflag = 'A') AS caught FROM lineitem GROUP BY 1""")
def mutation_kills(spark, d):
    line = table(spark, d, "lineitem").select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("bug"), F.col("l_quantity").alias("old"), F.when((F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "A"), F.col("l_quantity") - 1).otherwise(F.col("l_quantity")).alias("new"))
    return behave.mutation_share(line, "bug", "old", "new")


@query("""SELECT p_partkey AS id, p_type || ',' || p_size || ',1.5' AS found FROM part""")
def condition_literals(spark, d):
    text = F.concat(F.lit("IF A > "), F.col("p_size").cast("string"), F.lit(" OR B = '"), "p_type", F.lit("' OR C < 1.5"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.literals(text), ",").alias("found"))


@query("""SELECT p_partkey AS id, p_size % 3 <> 0 AS is_numeric, p_size % 3 = 1 AS signed, CASE WHEN p_size % 3 <> 0 THEN p_size + 2 END AS digits, CASE WHEN p_size % 3 <> 0 THEN 2 END AS scale, CASE WHEN p_size % 3 <> 0 THEN p_size + 2 ELSE p_size END AS length FROM part""")
def pictures(spark, d):
    s = F.col("p_size").cast("string")
    pic = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("X("), s, F.lit(")"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("S9("), s, F.lit(")V99"))).otherwise(F.concat(F.lit("9("), s, F.lit(") V9(2)")))
    made = T.picture(pic)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), made["numeric"].alias("is_numeric"), *[made[c].alias(c) for c in ("signed", "digits", "scale", "length")])


def _cover(spark, d):
    t = lambda n: table(spark, d, n)
    pairs = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("candidate"), F.concat_ws("/", "p_brand", "p_type").alias("element")).distinct()
    costs = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("candidate"), (F.col("s_suppkey") % 3 + 1).alias("cost"))
    return pairs, costs


def _cover_parts(spark, d):
    pairs = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("candidate"), F.col("l_partkey").alias("element")).distinct()
    return pairs, _cover(spark, d)[1]


def _buyers(spark, d):
    """Which nations buy more of a size of parts than their share, and what a nation costs."""
    t = lambda n: table(spark, d, n)
    bought = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "p_size").agg(F.count(F.lit(1)).alias("n"))
    by_nation, by_size, all_ = W.partitionBy("c_nationkey"), W.partitionBy("p_size"), bought.agg(F.sum("n").alias("all"))  # one row
    more = bought.withColumns({"of_nation": F.sum("n").over(by_nation), "of_size": F.sum("n").over(by_size)}).crossJoin(all_).filter(F.col("n") * F.col("all") > F.col("of_nation") * F.col("of_size"))
    return more.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("candidate"), F.col("p_size").alias("element")), t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("candidate"), (F.col("n_nationkey") % 4 + 2).alias("cost"))


@query()
def cover_exact(spark, d):
    """The cheapest nations that between them buy more than their share of every size."""
    return exact_cover.exact_cover(*_buyers(spark, d))


_PAIRS = """pairs AS (SELECT DISTINCT 's' || l_suppkey AS candidate, p_brand || '/' || p_type AS element FROM lineitem JOIN part ON l_partkey = p_partkey), costs AS (SELECT 's' || s_suppkey AS candidate, s_suppkey % 3 + 1 AS cost FROM supplier)"""


@query()
def cover_greedy(spark, d):
    """Few suppliers that have all parts."""
    return cover.greedy_cover(*_cover_parts(spark, d))


@query(f"""WITH {_PAIRS}, z AS (SELECT p.candidate, count(*) AS n, any_value(cost) AS cost FROM pairs p JOIN costs c ON c.candidate = p.candidate GROUP BY 1),
k AS (SELECT a.candidate AS a, b.candidate AS b, count(*) AS n FROM pairs a JOIN pairs b ON a.element = b.element AND a.candidate <> b.candidate GROUP BY 1, 2)
SELECT DISTINCT a.candidate FROM k JOIN z a ON a.candidate = k.a JOIN z b ON b.candidate = k.b WHERE k.n = a.n AND b.cost <= a.cost AND (b.n > a.n OR b.cost < a.cost OR b.candidate < a.candidate)""")
def cover_dominated(spark, d):
    return cover.dominated(*_cover(spark, d))


@query(f"""WITH {_PAIRS}, p AS (SELECT sum(cost) + 1 AS p FROM costs), t AS (SELECT a.candidate AS i, b.candidate AS j, CASE WHEN a.candidate = b.candidate THEN -p ELSE 2 * p END AS v FROM pairs a JOIN pairs b ON a.element = b.element AND a.candidate <= b.candidate, p UNION ALL SELECT candidate, candidate, cost FROM costs)
SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM t GROUP BY i, j HAVING sum(v) <> 0""")
def cover_penalties(spark, d):
    return cover.cover_qubo(*_cover(spark, d))


def _quadratic(spark, d):
    """A form over ten groups of suppliers: minus the parts of each, plus the parts that two share."""
    line = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("i"), "l_partkey").distinct()
    linear = line.groupBy("i").agg((-F.count(F.lit(1))).alias("v"))
    both = line.join(line.withColumnRenamed("i", "j"), "l_partkey").filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("v"))
    return linear, both


_FORM = """g AS (SELECT DISTINCT CAST(l_suppkey % 10 AS INTEGER) AS i, l_partkey FROM lineitem), lin AS (SELECT i, -count(*) AS v FROM g GROUP BY i), quad AS (SELECT a.i, b.i AS j, count(*) AS v FROM g a JOIN g b ON a.l_partkey = b.l_partkey AND a.i < b.i GROUP BY 1, 2)"""


@query(f"""WITH {_FORM}, x AS (SELECT range AS a FROM range(1024)), t AS (SELECT a, ((a >> (9 - i)) & 1) * v AS v FROM x, lin UNION ALL SELECT a, ((a >> (9 - i)) & 1) * ((a >> (9 - j)) & 1) * v FROM x, quad)
SELECT a AS assignment, CAST(sum(v) AS BIGINT) AS energy FROM t GROUP BY a""")
def qubo_energies(spark, d):
    return cover.qubo_energies(spark, *_quadratic(spark, d), 10)


@query(f"""WITH {_FORM}, h AS (SELECT i, -2 * v AS v FROM lin UNION ALL SELECT i, -v FROM quad UNION ALL SELECT j, -v FROM quad)
SELECT 'field' AS term, i, CAST(NULL AS INTEGER) AS j, CAST(sum(v) AS BIGINT) AS v FROM h GROUP BY i UNION ALL SELECT 'coupling', i, j, v FROM quad UNION ALL SELECT 'offset', NULL, NULL, CAST(sum(v) AS BIGINT) FROM (SELECT 2 * v AS v FROM lin UNION ALL SELECT v FROM quad)""")
def ising_terms(spark, d):
    return cover.ising(*_quadratic(spark, d))


_RISK = """risk AS (SELECT s_suppkey AS supplier, coalesce(a.n, 0) AS fan_in, coalesce(b.n, 0) AS churn, coalesce(c.n, 0) AS crypto FROM supplier
 LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY 1) a ON a.k = s_suppkey LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM (SELECT DISTINCT l_suppkey, date_trunc('month', l_shipdate) FROM lineitem) GROUP BY 1) b ON b.k = s_suppkey
 LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.07 GROUP BY 1) c ON c.k = s_suppkey)"""


def _risk(spark, d):
    line = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "supplier")
    return cover.features(table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier")), {
        "fan_in": line.select("supplier", "l_orderkey").distinct(), "churn": line.select("supplier", F.trunc("l_shipdate", "month").alias("m")).distinct(), "crypto": line.filter("l_returnflag = 'R' AND l_tax > 0.07").select("supplier"),
    }, "supplier")


@query(f"WITH {_RISK} SELECT supplier, fan_in, churn, crypto FROM risk")
def risk_features(spark, d):
    return _risk(spark, d)


@query(f"WITH {_RISK} SELECT 'S' || supplier AS name, CAST(fan_in + 10 * churn + 3 * crypto AS BIGINT) AS score FROM risk ORDER BY score DESC, name LIMIT 10")
def review_top(spark, d):
    scored = _risk(spark, d).select(F.concat(F.lit("S"), F.col("supplier").cast("string")).alias("name"), (F.col("fan_in") + 10 * F.col("churn") + 3 * F.col("crypto")).alias("score"))
    return cover.top(scored, 10)


_KIND = "CASE event_type WHEN 'view' THEN 'refactor' WHEN 'click' THEN 'refactor' WHEN 'error' THEN 'defect' ELSE 'intended' END"
_VERDICT = "CASE WHEN event_id % 13 = 0 THEN 'inconclusive' WHEN (event_type IN ('view', 'click')) = (event_id % 7 <> 0) THEN 'equivalent' ELSE 'not-equivalent' END"
_LEDGER = f"""l0 AS (SELECT *, {_KIND} AS kind, {_VERDICT} AS verdict, CAST(user_id % 6 AS VARCHAR) AS bank, CAST(user_id % 3 AS VARCHAR) AS market FROM events),
ledger AS (SELECT *, CASE WHEN verdict = 'inconclusive' THEN 'inconclusive' WHEN kind = 'refactor' THEN CASE WHEN verdict = 'equivalent' THEN 'proven' ELSE 'false-alarm' END WHEN verdict = 'equivalent' THEN 'missed' WHEN kind = 'defect' THEN 'caught' ELSE 'confirmed' END AS outcome FROM l0)"""


def _ledger(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "refactor").when(F.col("event_type") == "error", "defect").otherwise("intended")
    verdict = F.when(F.col("event_id") % 13 == 0, "inconclusive").when(F.col("event_type").isin("view", "click") == (F.col("event_id") % 7 != 0), "equivalent").otherwise("not-equivalent")
    rows = e.withColumns({"kind": kind, "verdict": verdict, "bank": (F.col("user_id") % 6).cast("string"), "market": (F.col("user_id") % 3).cast("string")})
    return rows.withColumn("outcome", rollup.outcome(F.col("kind"), F.col("verdict")))


@query(f"""WITH {_LEDGER} SELECT market, bank, kind, count(*) AS runs, count(*) FILTER (outcome = 'proven') AS proven, count(*) FILTER (outcome = 'caught') AS caught, count(*) FILTER (outcome IN ('missed', 'false-alarm')) AS wrong, count(DISTINCT CAST(ts AS DATE)) AS days
FROM ledger GROUP BY GROUPING SETS ((), (market), (bank), (kind))""")
def scorecard_sets(spark, d):
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return rollup.scorecard(_ledger(spark, d), ["market", "bank", "kind"], [F.count(F.lit(1)).alias("runs"), is_("proven").alias("proven"), is_("caught").alias("caught"), is_("missed", "false-alarm").alias("wrong"), F.countDistinct(F.to_date("ts")).alias("days")])


@query(f"""WITH {_LEDGER}, c AS (SELECT count(*) FILTER (kind = 'refactor') AS r, count(*) FILTER (outcome = 'proven') AS p, count(*) FILTER (kind = 'defect') AS b, count(*) FILTER (outcome = 'caught') AS c, count(*) FILTER (kind = 'none') AS z FROM ledger)
SELECT p || ' of ' || r || ' (' || (100 * p // r) || '%)' AS proven, c || ' of ' || b || ' (' || (100 * c // b) || '%)' AS caught, CASE WHEN z = 0 THEN '-' END AS none FROM c""")
def headline_measures(spark, d):
    n = lambda c, v: F.count_if(F.col(c) == v)
    t = _ledger(spark, d).agg(n("kind", "refactor").alias("r"), n("outcome", "proven").alias("p"), n("kind", "defect").alias("b"), n("outcome", "caught").alias("c"), n("kind", "none").alias("z"))
    return t.select(rollup.share(F.col("p"), F.col("r")).alias("proven"), rollup.share(F.col("c"), F.col("b")).alias("caught"), rollup.share(F.lit(0), F.col("z")).alias("none"))


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1""")
def month_rollup(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("cents"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query(f"""WITH {_LEDGER} SELECT event_id, bank, kind, outcome FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY ts DESC, event_id DESC) AS k FROM ledger WHERE outcome IN ('missed', 'false-alarm')) WHERE k <= 15""")
def last_wrong(spark, d):
    k = F.row_number().over(W.partitionBy("bank").orderBy(F.desc("ts"), F.desc("event_id")))
    return _ledger(spark, d).filter(F.col("outcome").isin("missed", "false-alarm")).withColumn("k", k).filter("k <= 15").select("event_id", "bank", "kind", "outcome")


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def ledger_stream(spark, d):
    """The events as a stream, re-sent ones dropped, into a table; then totals by day."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = ledger.source(spark, f"{d}/event[s].parquet", table(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ledger.once(ledger.distinct_rows(stream, ["event_id"], "ts", "40 days"), "ledger").select(*events.columns)
    return rows.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(cents("value")).alias("cents"))


@query("""WITH s AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT event_id, event_type, k AS place FROM s WHERE k <= 20""")
def stratified_rows(spark, d):
    """The first rows of each kind in a fixed order (a sampling report)."""
    k = F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))
    return table(spark, d, "events").withColumn("place", k.cast("long")).filter("place <= 20").select("event_id", "event_type", "place")

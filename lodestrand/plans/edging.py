"""Queries on edges of jobs, definitions and commands, on services that use keys, and on what records lack, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.functions import crypto
from lodestrand.operators import change, edges
from lodestrand.plans.derive import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_PROGRAMS = "pr AS (SELECT DISTINCT 'P' || s_suppkey AS name FROM supplier WHERE s_suppkey % 7 <> 3)"


def _programs(spark, d):
    return table(spark, d, "supplier").filter("s_suppkey % 7 <> 3").select(_t("P", F.col("s_suppkey")).alias("name"))  # the analyzed ones


@query(f"""WITH {_PROGRAMS}, s AS (SELECT 'J' || o_orderkey AS job, CASE WHEN o_orderkey % 10 = 0 THEN 'PROC' ELSE 'JOB' END AS job_kind, 'S1' AS step, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'IKJEFT01' WHEN 2 THEN 'DFSRRC00' ELSE 'P' || o_custkey % 40 END AS program, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || o_custkey % 30 END AS proc FROM orders),
r AS (SELECT 'J' || l_orderkey AS job, 'S1' AS step, 'P' || l_suppkey AS program FROM lineitem WHERE l_orderkey % 6 IN (1, 2)), dd AS (SELECT DISTINCT 'J' || l_orderkey AS job, 'S1' AS step, 'DD' || l_linenumber AS dd, CASE WHEN l_linenumber <> 5 THEN 'X.Y' || max(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) END AS dataset, CASE l_linenumber % 3 WHEN 0 THEN '(OLD,KEEP)' WHEN 1 THEN 'SHR' END AS disp FROM lineitem),
pc AS (SELECT 'C' || n_nationkey AS name FROM nation), f AS (SELECT 'P' || s_suppkey AS program, CASE s_suppkey % 3 WHEN 0 THEN 'UT-S-DD' WHEN 1 THEN 'S-DD' ELSE 'dd' END || (s_suppkey % 7 + 1) AS assigned, 'file:P' || s_suppkey || '.F' AS id FROM supplier),
w AS (SELECT job, step, program FROM s WHERE program IS NOT NULL UNION SELECT job, step, program FROM r),
a AS (SELECT 'contains>step:' || job || '.' || step AS key, lower(job_kind) || ':' || job AS src, 'step:' || job || '.' || step AS dst, 'contains' AS kind, true AS resolved, NULL AS via FROM s
 UNION ALL SELECT 'runs>step:' || job || '.' || step, 'step:' || job || '.' || step, CASE WHEN name IS NULL THEN 'unresolved:' ELSE '' END || 'program:' || program, 'runs', name IS NOT NULL, NULL FROM s LEFT JOIN pr ON name = program WHERE program IS NOT NULL
 UNION ALL SELECT DISTINCT 'runs>step:' || r.job || '.' || r.step || '>' || r.program, 'step:' || r.job || '.' || r.step, CASE WHEN name IS NULL THEN 'unresolved:' ELSE '' END || 'program:' || r.program, 'runs', name IS NOT NULL, CASE WHEN s.program = 'DFSRRC00' THEN 'ims-region' ELSE 'tso-run' END FROM r JOIN s ON s.job = r.job LEFT JOIN pr ON name = r.program
 UNION ALL SELECT 'runs>step:' || job || '.' || step, 'step:' || job || '.' || step, CASE WHEN name IS NULL THEN 'unresolved:' ELSE '' END || 'proc:' || proc, 'runs-proc', name IS NOT NULL, NULL FROM s LEFT JOIN pc ON name = proc WHERE program IS NULL AND proc IS NOT NULL
 UNION ALL SELECT 'dd>step:' || job || '.' || step || '>' || dd, 'step:' || job || '.' || step, 'dataset:' || dataset, 'dd', true, disp FROM dd WHERE dataset IS NOT NULL
 UNION ALL SELECT 'binds>step:' || dd.job || '.' || dd.step || '>' || dd.dd, min(f.id), 'dataset:' || dd.dataset, 'binds', true, NULL FROM dd JOIN w ON w.job = dd.job JOIN f ON f.program = w.program AND regexp_replace(upper(f.assigned), '^([A-Z]{{2}}-)*(S-)?', '') = dd.dd WHERE dataset IS NOT NULL GROUP BY dd.job, dd.step, dd.dd, dd.dataset)
SELECT key, src, dst, kind, resolved, via FROM a""")
def job_edges(spark, d):
    """Jobs of one step each: what they run, by program, input, region or procedure, and their datasets. `via` also shows a DD's disposition."""
    c, orders, line = F.col, table(spark, d, "orders"), table(spark, d, "lineitem")
    k = c("o_orderkey")
    steps = orders.select(_t("J", k).alias("job"), F.when(k % 10 == 0, "PROC").otherwise("JOB").alias("job_kind"), F.lit("S1").alias("step"), F.when(k % 6 == 1, "IKJEFT01").when(k % 6 == 2, "DFSRRC00").when(k % 6 > 2, _t("P", c("o_custkey") % 40)).alias("program"), F.when(k % 3 == 0, _t("C", c("o_custkey") % 30)).alias("proc"))
    runs = line.filter("l_orderkey % 6 IN (1, 2)").select(_t("J", c("l_orderkey")).alias("job"), F.lit("S1").alias("step"), _t("P", c("l_suppkey")).alias("program"))  # only their steps run what input names
    dds = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p")).select(_t("J", c("l_orderkey")).alias("job"), F.lit("S1").alias("step"), _t("DD", c("l_linenumber")).alias("dd"), F.when(c("l_linenumber") != 5, _t("X.Y", c("p"))).alias("dataset"), F.when(c("l_linenumber") % 3 == 0, "(OLD,KEEP)").when(c("l_linenumber") % 3 == 1, "SHR").alias("disp"))
    s = c("s_suppkey")
    files = table(spark, d, "supplier").select(_t("P", s).alias("program"), F.concat(F.when(s % 3 == 0, "UT-S-DD").when(s % 3 == 1, "S-DD").otherwise("dd"), (s % 7 + 1).cast("string")).alias("assigned"), _t("file:P", s, ".F").alias("id"))
    made = edges.job_edges(steps, runs, dds, _programs(spark, d), table(spark, d, "nation").select(_t("C", c("n_nationkey")).alias("name")), files)
    return made.select("key", "src", "dst", "kind", "resolved", F.coalesce("via", "disp").alias("via"))


@query(f"""WITH {_PROGRAMS}, x AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'TRANSACTION' WHEN 1 THEN 'FILE' ELSE 'MAPSET' END AS kind, 'N' || c_custkey AS name, 'P' || c_nationkey * 3 AS program, CASE WHEN c_custkey % 2 = 0 THEN 'D.' || c_nationkey END AS dataset FROM customer)
SELECT 'starts>transaction:' || x.name AS key, 'transaction:' || x.name AS src, CASE WHEN pr.name IS NULL THEN 'unresolved:' ELSE '' END || 'program:' || program AS dst, 'starts' AS kind, pr.name IS NOT NULL AS resolved FROM x LEFT JOIN pr ON pr.name = program WHERE kind = 'TRANSACTION'
UNION ALL SELECT 'dsname>cics-file:' || name, 'cics-file:' || name, 'dataset:' || dataset, 'cics-dataset', true FROM x WHERE kind = 'FILE' AND dataset IS NOT NULL""")
def definition_edges(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    options = F.map_filter(F.create_map(F.lit("PROGRAM"), _t("P", n * 3), F.lit("DSNAME"), F.when(k % 2 == 0, _t("D.", n))), lambda key, v: v.isNotNull())
    found = table(spark, d, "customer").select(F.when(k % 3 == 0, "TRANSACTION").when(k % 3 == 1, "FILE").otherwise("MAPSET").alias("kind"), _t("N", k).alias("name"), options.alias("options"))
    return edges.definition_edges(found, _programs(spark, d)).select("key", "src", "dst", "kind", "resolved")


_WHAT = "CASE k % 7 WHEN 0 THEN 'LINK' WHEN 1 THEN 'XCTL' WHEN 2 THEN 'READ' WHEN 3 THEN 'REWRITE' WHEN 4 THEN 'SEND' WHEN 5 THEN 'START' ELSE 'SYNCPOINT' END"


@query(f"""WITH {_PROGRAMS}, v AS (SELECT DISTINCT 'Q' || s_nationkey AS program, 'F' || s_suppkey % 6 AS field, 'P' || s_suppkey % 20 AS value FROM supplier),
c AS (SELECT k, 'Q' || cust % 30 AS program, {_WHAT} AS command, k % 7 AS w, CASE WHEN k % 2 = 0 THEN 'P' || cust % 50 END AS literal, CASE WHEN k % 2 = 1 THEN 'F' || k % 9 END AS field FROM (SELECT o_orderkey AS k, o_custkey AS cust FROM orders)),
n AS (SELECT c.*, coalesce(literal, v.value) AS value, CASE WHEN literal IS NULL THEN count(v.value) OVER (PARTITION BY k) ELSE 1 END AS several FROM c LEFT JOIN v ON literal IS NULL AND v.program = c.program AND v.field = c.field WHERE w < 6)
SELECT CASE WHEN several > 1 THEN k || '>' || value ELSE CAST(k AS VARCHAR) END AS key, 'para:' || n.program AS src, CASE WHEN value IS NULL THEN 'unresolved:dynamic:' || field WHEN w < 2 THEN CASE WHEN pr.name IS NULL THEN 'unresolved:' ELSE '' END || 'program:' || value WHEN w < 4 THEN 'cics-file:' || value WHEN w = 4 THEN 'mapset:' || value ELSE 'transaction:' || value END AS dst,
CASE WHEN w < 2 THEN 'calls' WHEN w < 4 THEN 'cics-file' WHEN w = 4 THEN 'uses-screen' ELSE 'starts-transaction' END AS kind, value IS NOT NULL AND (w > 1 OR pr.name IS NOT NULL) AS resolved, CASE WHEN w < 2 THEN 'cics-' || lower(command) END AS via, CASE WHEN w > 1 THEN command END AS command, CASE WHEN literal IS NULL THEN field END AS from_field FROM n LEFT JOIN pr ON pr.name = value""")
def transaction_edges(spark, d):
    """Commands of programs whose options are literals or fields, by the values that these may hold."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k % 7 < 2, "program").when(k % 7 < 4, "file").when(k % 7 == 4, "mapset").otherwise("transid")
    command = F.when(k % 7 == 0, "LINK").when(k % 7 == 1, "XCTL").when(k % 7 == 2, "READ").when(k % 7 == 3, "REWRITE").when(k % 7 == 4, "SEND").when(k % 7 == 5, "START").otherwise("SYNCPOINT")
    option = F.when(k % 2 == 0, F.create_map(name, _t("P", cust % 50))).otherwise(F.create_map(F.concat(name, F.lit("_ref")), _t("F", k % 9)))
    commands = table(spark, d, "orders").select(k.cast("string").alias("key"), _t("Q", cust % 30).alias("program"), _t("para:Q", cust % 30).alias("src"), command.alias("command"), option.alias("options"))
    s = F.col("s_suppkey")
    values = table(spark, d, "supplier").select(_t("Q", F.col("s_nationkey")).alias("program"), _t("F", s % 6).alias("field"), _t("P", s % 20, " ").alias("value"))
    return edges.transaction_edges(commands, values, _programs(spark, d)).drop("reason")


_NAMES = ["CSNBOWH", "csnesye", "CSNFDSG1", "CSNDPKE", "CSNBXXX", "CSNE", "SUBPROG", "CSNDDSV1", "CSFPOWH", "CSNBRNGL"]
_WORDS = ["SHA-256", "AES", "RSA-PSS", "ECC", "PADDED", "sha1", "DSA", "DSAX", "T DES", "TDES", "DH"]


@query("""WITH p AS (SELECT p_partkey AS id, ['CSNBOWH', 'csnesye', 'CSNFDSG1', 'CSNDPKE', 'CSNBXXX', 'CSNE', 'SUBPROG', 'CSNDDSV1', 'CSFPOWH', 'CSNBRNGL'][p_partkey % 10 + 1] AS call, ['SHA-256', 'AES', 'RSA-PSS', 'ECC', 'PADDED', 'sha1', 'DSA', 'DSAX', 'T DES', 'TDES', 'DH'][p_size % 11 + 1] AS a, ['SHA-256', 'AES', 'RSA-PSS', 'ECC', 'PADDED', 'sha1', 'DSA', 'DSAX', 'T DES', 'TDES', 'DH'][(p_partkey * 7) % 11 + 1] AS b, 1024 * (p_size % 5) AS n FROM part),
m AS (SELECT *, CASE WHEN regexp_matches(upper(call), '^CSN[BDEF]|^CSFP') THEN CASE upper(call) WHEN 'CSNESYE' THEN 'CSNBSYE' WHEN 'CSNFDSG1' THEN 'CSNDDSG1' WHEN 'CSNDDSV1' THEN 'CSNDDSV' WHEN 'CSNE' THEN 'CSNB' ELSE call END END AS service,
 list_filter([CASE x WHEN 'SHA-256' THEN 'sha-256' WHEN 'AES' THEN 'aes' WHEN 'RSA-PSS' THEN 'rsa' WHEN 'ECC' THEN 'ecc' WHEN 'sha1' THEN 'sha-1' WHEN 'DSA' THEN 'dsa' WHEN 'TDES' THEN 'des' WHEN 'DH' THEN 'dh' END FOR x IN [a, b]], lambda y: y IS NOT NULL)[1] AS algorithm FROM p)
SELECT id, service, CASE service WHEN 'CSNBOWH' THEN 'hash' WHEN 'CSNBSYE' THEN 'symmetric-encrypt' WHEN 'CSNDPKE' THEN 'asymmetric-encrypt' WHEN 'CSNDDSV' THEN 'signature-verify' WHEN 'CSNBRNGL' THEN 'random' ELSE CASE WHEN service IS NOT NULL THEN 'unclassified' END END AS category,
algorithm, CASE WHEN algorithm IN ('rsa', 'dsa', 'dh') AND n IN (1024, 2048, 3072, 4096) THEN CAST(n AS INTEGER) END AS key_bits, CASE WHEN algorithm IS NOT NULL THEN algorithm IN ('rsa', 'ecc', 'dsa', 'dh') WHEN coalesce(service LIKE 'CSND%', false) THEN NULL ELSE false END AS vulnerable FROM m""")
def crypto_services(spark, d):
    """Calls as services, with the algorithm and key size that they are given."""
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    p, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(p.alias("id"), crypto.service(pick(_NAMES, p % 10)).alias("s"), F.array(pick(_WORDS, size % 11), pick(_WORDS, p * 7 % 11)).alias("texts"), F.array((1024 * (size % 5)).cast("int")).alias("numbers"))
    return rows.withColumn("u", crypto.use(F.col("s.name"), F.col("texts"), F.col("numbers"))).select("id", F.col("s.name").alias("service"), F.col("s.category").alias("category"), "u.algorithm", "u.key_bits", "u.vulnerable")


@query("""WITH e AS (SELECT l_orderkey AS change, 'f' || l_linenumber AS file, l_returnflag = 'A' AS bin, CAST(l_quantity AS INTEGER) % 3 AS ins, CAST(l_linenumber AS INTEGER) % 2 AS del, l_partkey % 4 AS hunks, l_suppkey % 17 <> 0 AS known FROM lineitem),
g AS (SELECT change, bool_or(NOT known) AS lost, bool_or(NOT bin AND (ins > 0 OR del > 0) AND hunks = 0) AS bare FROM (SELECT *, bool_or(known) OVER (PARTITION BY change, file) AS k2 FROM e) GROUP BY change),
f AS (SELECT change, bool_or(NOT k) AS lost FROM (SELECT change, file, bool_or(known) AS k FROM e GROUP BY change, file) GROUP BY change)
SELECT o_orderkey AS change, array_to_string(list_filter([CASE WHEN o_orderkey % 6 = 0 THEN 'who: implementer has no name or email' END, CASE WHEN o_orderkey % 13 = 0 THEN 'when: missing a time' END, CASE WHEN o_orderkey % 29 = 0 OR g.change IS NULL THEN 'where: repository, commit or files missing' END,
 CASE WHEN o_orderkey % 31 = 0 OR coalesce(f.lost, false) THEN 'what: a changed file was not accounted for' END, CASE WHEN coalesce(g.bare, false) THEN 'how: a text change has no hunks' END], lambda x: x IS NOT NULL), ';') AS gaps
FROM orders LEFT JOIN g ON g.change = o_orderkey LEFT JOIN f ON f.change = o_orderkey""")
def incomplete_records(spark, d):
    """What the record of each change (order) lacks; its files are its lines."""
    c = F.col
    k = c("o_orderkey")
    e = table(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), _t("f", c("l_linenumber")).alias("file"), (c("l_suppkey") % 17 != 0).alias("known"), F.struct(
        (c("l_returnflag") == "A").alias("binary"), (c("l_quantity").cast("int") % 3).alias("insertions"), (c("l_linenumber").cast("int") % 2).alias("deletions"), (c("l_partkey") % 4).cast("int").alias("hunks")).alias("edit"))
    files = e.groupBy("o_orderkey").agg(F.collect_set("file").alias("files"), F.collect_set(F.when(c("known"), c("file"))).alias("accounted"), F.collect_list("edit").alias("edits"))
    text = lambda cond: F.when(cond, F.lit("x"))
    record = F.struct(F.lit("n").alias("name"), text(k % 6 != 0).alias("email"), text(k % 13 != 0).alias("authored"), F.lit("t").alias("committed"), F.lit("r").alias("repository"), F.when(k % 29 == 0, "").otherwise("c").alias("commit"), "files", "accounted", F.when(k % 31 == 0, F.array(F.lit("unreadable"))).otherwise(F.array().cast("array<string>")).alias("problems"), "edits")
    return table(spark, d, "orders").join(files, "o_orderkey", "left").select(k.alias("change"), F.array_join(change.gaps(record), ";").alias("gaps"))

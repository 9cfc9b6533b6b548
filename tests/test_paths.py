"""Ways of impact, sharing through resources, and rules that must not pass, against walks written here."""

import os
import random

from pyspark.sql import functions as F

from lodestrand.operators import gate, graph, steps, walk
from lodestrand.plans import assembly
from lodestrand.sources import lines as L

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def traced(edges, seeds):
    """(tier, hops, up) of each node: level by level, tier by tier, the smallest predecessor of equally good ones."""
    out = {}
    for s, t, tier in edges:
        out.setdefault(s, []).append((t, tier))
    done = {s: (0, 0, None) for s in seeds}
    for tier in range(3):
        begin, levels = dict(done), {}
        for n, (_, h, _) in done.items():
            levels.setdefault(h, []).append(n)
        h = 0
        while h <= max(levels):
            for n in levels.get(h, []):
                for t, step in out.get(n, []):
                    if step <= tier and t not in begin:
                        if t not in done:
                            done[t] = (tier, h + 1, n)
                            levels.setdefault(h + 1, []).append(t)
                        elif done[t][1] == h + 1 and n < done[t][2]:
                            done[t] = (tier, h + 1, n)
            h += 1
    return done


def way(done, node):
    out = [node]
    while (up := done[out[0]][2]) is not None:
        out.insert(0, up)
    return out


def test_ways_in_random_graphs(spark):
    r = random.Random(31)
    for n, m in ((9, 20), (40, 70), (60, 62)):
        edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.randrange(3)) for _ in range(m)] + [(f"c{k}", f"c{k + 1}", 0) for k in range(37)] + [("n0", "c0", 1)]
        want = traced(edges, ["n0", "n3"])
        met = walk.traced(spark.createDataFrame(edges, "src string, dst string, tier int"), spark.createDataFrame([("n0",), ("n3",)], "id string"))
        assert {x["id"]: (x["tier"], x["hops"], x["up"]) for x in met.collect()} == want
        assert {x["id"]: x["via"] for x in walk.unrolled(met).collect()} == {k: way(want, k) for k in want}


def test_ways_over_all_modes(spark):
    spread = steps.steps(*assembly._system(spark, DATA)).collect()
    label = {(x["src"], x["dst"]): x["label"] for x in spread}
    entry = {"data:D7|definition": None, "program:P2|node": None, "para:P3.A1|node": "flow:P3#9"}
    done = traced([(x["src"], x["dst"], x["tier"]) for x in spread], list(entry))
    best = {}
    for s, (tier, hops, _) in done.items():
        via = way(done, s)
        first = entry[via[0]]
        node = s.rpartition("|")[0]
        found = (tier, len(via) - 1 + (first is not None), hops, s, via, first)
        best[node] = min(best.get(node, found), found, key=lambda x: x[:4])
    bare = lambda s: s.rpartition("|")[0]
    want = {}
    for node, (tier, length, _, _, via, first) in best.items():
        parts = ([f"{first} contained-in {bare(via[0])}"] if first else []) + [f"{bare(a)} {label[a, b]} {bare(b)}" for a, b in zip(via, via[1:], strict=False)]
        want[node] = (tier, length, " > ".join(parts))
    got = {x["id"]: (x["tier"], x["length"], x["via"]) for x in assembly.impact_paths(spark, DATA).collect()}
    assert got == want and max(x[1] for x in want.values()) > 3


def test_dispositions_as_job_entities_hand_them_out(spark):
    text = "//J JOB A\n//S EXEC PGM=P\n//A DD DSN=X.A,DISP=(OLD,KEEP)\n//B DD DSN=X.B,DISP=SHR\n//C DD DSN=X.C\n//D DD DSN=X.D,DISP=(,KEEP)\n//E DD DSN=X.E,DISP=(mod)"
    dds = L.job_entities(L.jcl(L.to_lines(spark.createDataFrame([("f", text)], "f string, t string"), "f", "t"))).filter("kind = 'jcl-dd'")
    none = F.lit(None).cast("string")
    edges = dds.select(F.lit("step").alias("src"), F.col("dataset").alias("dst"), F.lit("dd").alias("kind"), F.lit(True).alias("resolved"), none.alias("command"), "disp", F.lit(False).alias("dynamic"), none.alias("paragraph"), none.alias("mode"))
    nodes, tree = spark.createDataFrame([("step", "step")], "id string, kind string"), spark.createDataFrame([], "id string, parent string")
    got = {(x["src"].removesuffix("|node"), x["dst"].removesuffix("|node")) for x in steps.steps(nodes, edges, tree).collect()}
    assert got == {("X.A", "step"), ("step", "X.A"), ("X.B", "step"), ("step", "X.C"), ("step", "X.D"), ("step", "X.E")}


def test_sharing_through_resources_against_a_search_from_each(spark):
    r = random.Random(17)
    edges = {(f"p{r.randrange(12)}", f"r{r.randrange(30)}") for _ in range(40)} | {(f"r{r.randrange(30)}", f"r{r.randrange(30)}") for _ in range(45)} | {("r1", "r2"), ("r2", "r1"), ("x1", "r3"), ("p1", "x1")}
    owner = {f"p{k}": f"c{k % 5}" for k in range(9)} | {"r5": "c9"}
    want = {}
    for resource in {b for _, b in edges if b[0] == "r"}:
        seen, todo, users = {resource}, [resource], set()
        while todo:
            here = todo.pop()
            for a, b in edges:
                if b == here and b[0] == "r":
                    if a in owner:
                        users.add(owner[a])
                    elif a not in seen:
                        seen.add(a)
                        todo.append(a)
        if len(users) > 1:
            want[resource] = sorted(users)
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = graph.shared_through(e, e.filter("dst LIKE 'r%'").select(F.col("dst").alias("id")), spark.createDataFrame(list(owner.items()), "id string, component string"))
    assert {x["resource"]: list(x["components"]) for x in got.collect()} == want and len(want) > 5


def test_a_change_without_tests_proves_nothing(spark):
    facts = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 3, 0, 0, 0), (3, 0, 1, 0, 0), (4, 2, 0, 0, 1), (5, 2, 0, 1, 0)], "change int, tests int, different int, errors int, untested int")
    assert {r["change"]: (r["verdict"], r["status"]) for r in gate.equivalence_rule(facts).collect()} == {
        1: ("inconclusive", "inconclusive"), 2: ("equivalent", "pass"), 3: ("not-equivalent", "fail"), 4: ("inconclusive", "inconclusive"), 5: ("inconclusive", "inconclusive")}


def test_two_statements_are_two_edges_and_the_last_of_a_fact_counts(spark):
    nodes = spark.createDataFrame([("p:A", "p", "A", 0), ("p:A", "p", "later", 1)], "id string, kind string, name string, rank int")
    refs = spark.createDataFrame([("k1", 1, "s", "performs", "p", "A", 10), ("k2", 1, "s", "performs", "p", "A", 12), ("k3", 1, "s", "performs", "p", "A", 13), ("k3", 2, "s", "performs", "p", "NONE", 14)], "key string, rank int, src string, kind string, target_kind string, target string, where int")
    found, edges = graph.assemble(nodes, refs)
    assert {(e["key"], e["dst"], e["resolved"], e["where"]) for e in edges.collect()} == {("k1", "p:A", True, 10), ("k2", "p:A", True, 12), ("k3", "unresolved:p:NONE", False, 14)}
    assert {n["id"] for n in found.collect()} == {"p:A", "unresolved:p:NONE"}


def test_jumps_prefer_the_callers_section_and_keep_unknown_targets(spark):
    paragraphs = spark.createDataFrame([("P", "S1", 1, "A", "P.S1.A"), ("P", "S2", 2, "A", "P.S2.A"), ("P", "S2", 3, "B", "P.S2.B")], "program string, section string, seq int, name string, id string")
    sections = spark.createDataFrame([("P", 1, "S1", "P.S1"), ("P", 2, "A", "P.sectionA"), ("P", 3, "S2", "P.S2")], "program string, seq int, name string, id string")
    row = lambda key, target, thru=None, section=None, inside=None: (key, "P", "x", "performs", target, thru, section, inside)
    jumps = spark.createDataFrame([row("1", "A", None, "S2"), row("2", "A", None, "S9"), row("3", "A", "B", "S1"), row("4", "S2"), row("5", "NO", "B"), row("6", "B", "GONE"), row("7", "A", None, "S1", "S2"), row("8", "B", None, None, "S1")], "key string, program string, src string, kind string, target string, thru string, section string, in_section string")
    got = {e["key"]: (e["dst"], e["resolved"], e["thru"]) for e in graph.jump_edges(jumps, paragraphs, sections).collect()}
    assert got == {"1": ("P.S2.A", True, None), "2": ("P.S1.A", True, None), "3": ("P.S1.A", True, "P.S2.B"), "4": ("P.S2", True, None), "5": ("unresolved:paragraph:NO", False, None), "6": ("P.S2.B", True, "GONE"), "7": ("P.S2.A", True, None), "8": ("unresolved:paragraph:B", False, None)}


def test_services_functions_and_exposure(spark):
    from lodestrand.functions import crypto

    def of(column, schema, *values):
        r = spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]
        return tuple(r) if r is not None and not isinstance(r, list) else r

    c = F.col
    assert of(crypto.service(c("t")), "t string", "csnbowh1") == ("CSNBOWH", "hash") and of(crypto.service(c("t")), "t string", "CSNFPKE") == ("CSNDPKE", "asymmetric-encrypt")
    assert of(crypto.service(c("t")), "t string", "CSFZZZ") is None and of(crypto.service(c("t")), "t string", "CSNBZZZ") == ("CSNBZZZ", "unclassified") and of(crypto.service(c("t")), "t string", None) is None
    assert [tuple(x) for x in of(crypto.sql_functions(c("t")), "t string", "SELECT hash_sha256 (A), MY-HASH(B), ENCRYPT(C) FROM T WHERE HASHED(1)")] == [("HASH_SHA256", "hash"), ("ENCRYPT", "symmetric-encrypt")]
    use = crypto.use(c("n"), c("t"), c("k"))
    schema = "n string, t array<string>, k array<int>"
    assert of(use, schema, "CSNDDSG", ["pad", " rsa-x"], [7, 2048, 4096]) == ("rsa", 2048, True) and of(use, schema, "CSNBOWH", ["SHA-512"], [2048]) == ("sha-512", None, False)
    assert of(use, schema, "CSNDPKB", ["pad"], [2048]) == (None, None, None) and of(use, schema, "CSNBSYE", [], []) == (None, None, False)


def test_gaps_of_records(spark):
    from lodestrand.operators import change

    schema = "name string, email string, authored string, committed string, repository string, commit string, files array<string>, accounted array<string>, problems array<string>, edits array<struct<binary:boolean,insertions:int,deletions:int,hunks:int>>"
    full = ("n", "e", "a", "c", "r", "s", ["x"], ["x", "y"], [], [(False, 1, 0, 1), (True, 3, 0, 0), (False, 0, 0, 0)])
    other = ("n", "", "a", None, "r", "s", [], [], ["bad"], [(False, 0, 2, 0)])
    rows = spark.createDataFrame([full, other, (None,) * 10], schema)
    got = [r["g"] for r in rows.select(change.gaps(F.struct(*rows.columns)).alias("g")).collect()]
    assert got == [[], [change.GAPS[k] for k in ("who", "when", "where", "what", "how")], [change.GAPS[k] for k in ("who", "when", "where")]]


def test_tso_input_counts_under_tso_programs_only(spark):
    text = "//J JOB X\n//S1 EXEC PGM=IKJEFT1B\n RUN PROGRAM(ABC)\n//S2 EXEC PGM=IEFBR14\n RUN PROGRAM(NO)\n//S3 EXEC IKJEFT01\n RUN PROGRAM(NO)"
    lines = L.to_lines(spark.createDataFrame([(1, text)], "f int, t string"), "f", "t")
    assert [(r["line"], r["program"]) for r in L.tso_runs(lines).collect()] == [(3, "ABC")]


def test_edges_of_jobs_and_books(spark):
    from lodestrand.operators import edges

    steps = spark.createDataFrame([("J", "JOB", "A", "P1", None), ("J", "JOB", "B", None, "C1"), ("J", "JOB", "C", "DFSRRC00", None), ("J", "JOB", "D", None, None)], "job string, job_kind string, step string, program string, proc string")
    runs = spark.createDataFrame([("J", "C", "P2"), ("J", "C", "P2")], "job string, step string, program string")
    dds = spark.createDataFrame([("J", "C", "IN", "D.S", "SHR"), ("J", "C", "NO", None, None)], "job string, step string, dd string, dataset string, disp string")
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    files = spark.createDataFrame([("P2", "ut-s-in", "file:P2.F"), ("P9", "IN", "file:P9.F")], "program string, assigned string, id string")
    got = {r["key"]: (r["src"], r["dst"], r["resolved"], r["reason"]) for r in edges.job_edges(steps, runs, dds, one("P1", "P2"), one("C9"), files).collect()}
    assert len(got) == 10 and got["runs>step:J.A"] == ("step:J.A", "program:P1", True, None) and got["runs>step:J.C>P2"][1] == "program:P2"
    assert got["runs>step:J.B"] == ("step:J.B", "unresolved:proc:C1", False, "procedure not in the analyzed code") and got["runs>step:J.C"][1] == "unresolved:program:DFSRRC00"
    assert got["binds>step:J.C>IN"][:2] == ("file:P2.F", "dataset:D.S") and got["dd>step:J.C>IN"][1] == "dataset:D.S" and got["contains>step:J.D"][0] == "job:J"
    copies = spark.createDataFrame([("k1", "P", "BK", None), ("k2", "P", "NO", "x"), ("k3", "P", "BK", "recursive COPY")], "key string, program string, name string, problem string")
    assert {r["key"]: (r["dst"], r["resolved"], r["reason"]) for r in edges.book_edges(copies, one("BK")).collect()} == {"k1": ("copybook:BK", True, None), "k2": ("unresolved:copybook:NO", False, "copybook not found"), "k3": ("copybook:BK", True, "recursive COPY")}

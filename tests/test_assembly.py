"""Steps and walks against a heap, and forms of statements, messages and edits case by case."""

import heapq
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import behave, cover, gate, graph, program, steps, walk
from lodestrand.plans import assembly, business, programs
from lodestrand.sources import lines as L

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def heap_walk(edges, seeds):
    out, queue, done = {}, [(0, 0, s) for s in seeds], {}
    for s, t, tier in edges:
        out.setdefault(s, []).append((t, tier))
    while queue:
        tier, hops, node = heapq.heappop(queue)
        if node in done:
            continue
        done[node] = (tier, hops)
        for other, step in out.get(node, []):
            if other not in done:
                heapq.heappush(queue, (max(tier, step), hops + 1, other))
    return done


def phases(edges, seeds):
    """Breadth-first by tier, begun from all that is settled."""
    done = {s: (0, 0) for s in seeds}
    for tier in range(3):
        queue = [(h, n) for n, (_, h) in done.items()]
        heapq.heapify(queue)
        best = {}
        while queue:
            hops, node = heapq.heappop(queue)
            if hops > best.get(node, done.get(node, (0, hops))[1]):
                continue
            for s, t, step in edges:
                if s == node and step <= tier and t not in done and hops + 1 < best.get(t, 1 << 30):
                    best[t] = hops + 1
                    heapq.heappush(queue, (hops + 1, t))
        done |= {n: (tier, h) for n, h in best.items()}
    return done


def test_impact_of_random_graphs(spark):
    r = random.Random(21)
    for n in (8, 14):
        edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.randrange(3)) for _ in range(3 * n)]
        got = {x["id"]: (x["tier"], x["hops"]) for x in walk.impact(spark.createDataFrame(edges, "src string, dst string, tier int"), spark.createDataFrame([("n0",)], "id string")).collect()}
        assert got == phases(edges, ["n0"])
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in heap_walk(edges, ["n0"]).items()}


def test_impact_by_mode_reaches_what_a_heap_reaches(spark):
    made = [(x["src"], x["dst"], x["tier"]) for x in assembly.impact_steps(spark, DATA).collect()]
    want = {}
    for state, (tier, _) in heap_walk(made, ["data:D7|definition", "program:P2|node"]).items():
        node = state.rpartition("|")[0]
        want[node] = min(want.get(node, 9), tier)
    assert {x["id"]: x["tier"] for x in assembly.impact_by_mode(spark, DATA).collect()} == want


def test_steps_by_mode(spark):
    nodes = spark.createDataFrame([("p", "program"), ("a", "paragraph"), ("g", "data"), ("x", "data"), ("y", "data"), ("f", "file")], "id string, kind string")
    row = lambda *v: v + (None,) * (9 - len(v))
    edges = spark.createDataFrame([row("p", "a", "contains", True), row("x", "y", "flows-to", True, None, None, False, "a"), row("a", "t", "writes-table", True), row("f", "d", "binds", True)], "src string, dst string, kind string, resolved boolean, command string, disp string, dynamic boolean, paragraph string, mode string")
    tree = spark.createDataFrame([("x", "g")], "id string, parent string")
    got = {(s["src"], s["dst"]): s["tier"] for s in steps.steps(nodes, edges, tree).collect()}
    assert got[("a|node", "p|node")] == 0 and got[("p|node", "a|node")] == 2  # the program may change what its writer writes
    assert got[("x|definition", "g|definition")] == 0 and ("x|value", "g|definition") not in got
    assert got[("x|definition", "a|node")] == 0 and got[("x|value", "a|node")] == 1 and got[("x|value", "y|value")] == 1
    assert got[("g|value", "y|value")] == 1  # a group's part flows on
    assert got[("a|node", "t|node")] == 2 and got[("d|node", "f|value")] == 2


def test_gaps_and_reliant_systems(spark):
    found = spark.createDataFrame([("p", 0, 0), ("unresolved:data:Q", 1, 2)], "id string, tier int, hops int")
    nodes = spark.createDataFrame([("p", "program"), ("q", "program"), ("unresolved:data:Q", "unresolved"), ("unresolved:data:R", "unresolved")], "id string, kind string")
    edges = spark.createDataFrame([("p", "u", "calls", True, False)], "src string, dst string, kind string, dynamic boolean, resolved boolean")
    unread = spark.createDataFrame([("a.txt", "no reader for this type")], "file string, why string")
    assert {(r["gap"], r["what"]) for r in steps.impact_gaps(found, nodes, edges, unread).collect()} == {("no reader for this type", "a.txt"), ("unresolved", "unresolved:data:Q"), ("run-time call", "p")}
    assert steps.impact_gaps(found.filter("id <> 'p'"), nodes, edges, unread).count() == 2
    owners = spark.createDataFrame([("p", "core"), ("q", "edge")], "id string, component string")
    relied = spark.createDataFrame([("core", ["bank", "risk"]), ("edge", ["web"])], "component string, systems array<string>")
    assert {r["system"] for r in steps.reliant(found, owners, relied).collect()} == {"bank", "risk"}


def test_closures_end_on_cycles(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e")], "id string, parent string")
    got = {(r["ancestor"], r["descendant"]): r["distance"] for r in walk.closure(tree).collect()}
    assert got[("b", "d")] == 2 and got[("c", "d")] == 3 and got[("a", "c")] == 1 and got[("a", "b")] == 2 and ("a", "a") not in got
    chain = [(f"t{k}", f"t{k + 1}") for k in range(90)] + [("t90", None)]
    assert program.chains(spark.createDataFrame(chain, "type string, super string")).filter("type = 't0'").count() == 91


def one(spark, column, *values):
    schema = ", ".join(f"v{k} string" for k in range(len(values)))
    return spark.createDataFrame([values], schema).select(column(*[F.col(f"v{k}") for k in range(len(values))]).alias("x")).first()["x"]


def test_tickets_of_odd_messages(spark):
    def of(message):
        lines = F.split(F.lit(message), "\n")
        return [tuple(t) for t in spark.range(1).select(T.tickets(lines, T.trailers(lines)).alias("t")).first()["t"]]

    assert of("Use UTF-8 and SHA-256") == []
    assert of("ABC-12: use UTF-8 [X1-3]") == [("ABC-12", "tracker", "issue", "subject"), ("X1-3", "tracker", "issue", "subject")]
    assert of("Fix\n\nSee INC0012345, INC123 and ABC-12") == [("INC0012345", "records", "incident", "body")]
    assert of("Fix\n\nbody [OPS-0] [OPS-7]\n\nChange: CHG0000001 and ABC-4\nReviewed-by: XY-3 <a@b.example>") == [("CHG0000001", "records", "change", "trailer"), ("ABC-4", "tracker", "issue", "trailer"), ("OPS-7", "tracker", "issue", "body")]
    assert of("CTASK1234567 REQ7654321 CTASK1234567") == [("CTASK1234567", "records", "change-task", "subject"), ("REQ7654321", "records", "request", "subject")]


def test_families_of_algorithms(spark):
    words = {"ECC": "EC", "EC-P256": "EC", "DSA": "DSA", "DSAX": "unknown", "DH": "DH", "diffie-hellman": "DH", "MD5": "MD5", "TDES": "DES", "DES": "DES", "UNIVERSAL": "unknown", "RSA2048": "RSA", "sha512": "SHA-2", "SHA-1": "SHA-1", "SHA-3": "unknown", "CALL-RSA-SIGN": "RSA", "AES256": "AES"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.algorithm(F.col("w")).alias("a"))
    got = {r["w"]: (r["a"], r["v"]) for r in rows.select("w", "a", T.vulnerable(F.col("a")).alias("v")).collect()}
    assert {w: a for w, (a, _) in got.items()} == words
    assert all(v is (None if a == "unknown" else a in ("RSA", "EC", "DSA", "DH")) for a, v in got.values())
    bits = spark.createDataFrame([("RSA 2048",), ("RSA 1234 4096",), ("AES 2048",)], "w string").select(T.key_bits(F.col("w"), T.algorithm(F.col("w"))).alias("b"))
    assert [r["b"] for r in bits.collect()] == [2048, 4096, None]


def test_literals_in_either_quotes(spark):
    assert one(spark, T.literals, "IF A = \"it's 5\" OR B = 'x \"y\"' OR C > 7") == ["it's 5", 'x "y"', "7"]


def test_statement_texts(spark):
    assert one(spark, L.without_separators, "MOVE A, B; TO 'x, y' C,D,") == "MOVE A  B  TO 'x, y' C,D "
    text = "DATA DIVISION.\nEXEC SQL INCLUDE X END-EXEC.\nPROCEDURE DIVISION.\n  EXEC CICS\n   LINK PROGRAM('P') END-EXEC\n  exec sql SELECT 1\n END-EXEC."
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in L.exec_blocks(F.col("t")).items()]).first()
    assert [tuple(b) for b in got["blocks"]] == [("SQL", "INCLUDE X"), ("CICS", "LINK PROGRAM('P')"), ("SQL", "SELECT 1")]
    assert got["masked"] == "DATA DIVISION.\n.\nPROCEDURE DIVISION.\n  CONTINUE\n  CONTINUE."
    assert one(spark, L.region_program, "DFSRRC00", "(BMP,'PGM7',PSB)") == "PGM7" and one(spark, L.region_program, "IKJEFT01", "BMP,X") is None


def test_runs_and_entities_of_jobs(spark):
    text = "//J JOB X\n//S1 EXEC PGM=IKJEFT01\n//SYSTSIN DD *\n RUN PROGRAM(ABC) PLAN(P)\n//* RUN PROGRAM(NO)\n run prog ( x1 )\n/*\n//S2 EXEC PGM=B\n//O DD DSN=q.r(M),DISP=(OLD,KEEP)\n"
    lines = L.to_lines(spark.createDataFrame([(1, text)], "f int, t string"), "f", "t")
    assert {(r["line"], r["first"], r["program"]) for r in L.tso_runs(lines).collect()} == {(4, 2, "ABC"), (6, 2, "X1")}
    got = {r["id"]: (r["kind"], r["program"], r["dataset"], r["disp"]) for r in L.job_entities(L.jcl(lines)).collect()}
    assert got == {"job:J": ("jcl-job", None, None, None), "jcl-step:J.S1": ("jcl-step", "IKJEFT01", None, None), "jcl-dd:J.S1.SYSTSIN": ("jcl-dd", None, None, None), "jcl-step:J.S2": ("jcl-step", "B", None, None), "jcl-dd:J.S2.O": ("jcl-dd", None, "Q.R", "(OLD,KEEP)")}


def test_touched_lines(spark):
    cases = [("a\nb\nc", "a\nb\nc", []), ("a\nb\nc", "a\nX\nc", [2]), ("a\nb\nc", "a\nc", [2]), ("a\nb\nc", "a\nb\nnew\nc", [2, 3]), ("a", "new\na", [1]), (None, "x", []), ("a\nb", None, [1, 2])]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    assert {r["k"]: r["x"] for r in rows.select("k", behave.touched_lines(F.col("a"), F.col("b")).alias("x")).collect()} == {k: want for k, (_, _, want) in enumerate(cases)}


def test_edits_of_documents(spark):
    docs = {r["doc_id"]: (r["text"] or "").split("\n") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in assembly.edit_lines(spark, DATA).collect():
        lines = docs[r["doc_id"]]
        if len(lines) < 3:
            assert r["lines"] == []
        elif len(set(lines)) == len(lines):  # no other choice of matches
            assert 3 in r["lines"] and not {1, 2} & set(r["lines"]) - ({2} if len(lines) == 3 else set())


def test_verdicts_rules_and_covers_that_must_not_pass(spark):
    results = spark.createDataFrame([("a", "same")], "program string, result string")
    owners = spark.createDataFrame([("a",), ("b",)], "program string")
    assert {r["program"]: (r["tests"], r["verdict"]) for r in behave.verdict(results, ["program"], owners).collect()} == {"a": (1, "equivalent"), "b": (0, "inconclusive")}
    statuses = spark.createDataFrame([(1, "two-approvers", "pass"), (1, "made-up", "pass")], "change int, rule string, status string")
    with pytest.raises(ValueError, match="made-up"):
        gate.gate(statuses, known=("two-approvers",))
    pairs = spark.createDataFrame([("c", "e1"), ("free", "e2")], "candidate string, element string")
    with pytest.raises(ValueError, match="e2"):
        cover.greedy_cover(pairs, spark.createDataFrame([("c", 1)], "candidate string, cost long"))
    with pytest.raises(ValueError):
        cover.qubo_energies(spark, pairs, pairs, 40)
    needs = spark.createDataFrame([("t1", "n1"), ("t2", "n1"), ("t2", "n2"), ("t3", "n3")], "test string, need string")
    assert {r["need"] for r in behave.chosen_meet_all(needs, spark.createDataFrame([("t2",)], "test string")).collect()} == {"n3"}


def test_slack_makes_double_cover_free(spark):
    pairs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("a", "y"), ("b", "z")], "candidate string, element string")
    terms = {(r["a"], r["b"]): r["v"] for r in cover.cover_slack_qubo(pairs, spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "candidate string, cost long")).collect()}
    names = sorted({n for k in terms for n in k})
    energy = lambda on: sum(v for (i, j), v in terms.items() if i in on and j in on)
    least = min(((energy({n for k, n in enumerate(names) if bits >> k & 1}), sorted(n for k, n in enumerate(names) if bits >> k & 1 and "/" not in n)) for bits in range(1 << len(names))), key=lambda x: x[0])
    assert least[1] == ["a", "b"] and least[0] == 2 - 3 * 4  # both cover x, and the slack pays for it


def test_longest_ranges_and_first_paths(spark):
    changes = spark.createDataFrame([(1, "f", 1, 3), (2, "f", 60, 70), (3, "f", 300, 300), (4, "g", 1, 3)], "id int, file string, first int, last int")
    hunks = spark.createDataFrame([("f", 3, 3), ("f", 64, 640)], "file string, begin int, end int")
    assert {r["id"] for r in graph.overlapping(changes, hunks).collect()} == {4}
    runs = spark.createDataFrame([(3, "p"), (1, "p"), (2, "q")], "test int, path string")
    assert {(r["path"], r["test"]) for r in behave.first_of_each_path(runs, "path", "test").collect()} == {("p", 1), ("q", 2)}


def test_risk_model_orders_by_what_it_learned(spark):
    r = random.Random(3)
    rows = [(k, float(a := r.random()), float(r.random()), int(a > 0.5)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, risky int")
    model, area = cover.train_risk(df, ["a", "b"], "risky")
    assert area > 0.95 and model.featureImportances[0] > 0.8
    assert df.select(cover.risk_score({"a": 2.0, "b": 0.0}).alias("s"), "a").filter("abs(s - 2 * a) > 1e-9").count() == 0


def test_selected_tests_meet_all_obligations_as_brute_force_picks_them(spark):
    needs = business.test_obligations(spark, DATA).select(F.col("test").cast("string").alias("test"), "need").distinct()
    left, want = {}, []
    for r in needs.collect():
        left.setdefault(r["test"], set()).add(r["need"])
    while any(left.values()):
        best = min((t for t in left if left[t]), key=lambda t: (1 / len(left[t]), t))
        want.append(best)
        gone = set(left[best])
        left = {t: s - gone for t, s in left.items()}
    chosen = programs.test_selection(spark, DATA)
    assert [r["candidate"] for r in chosen.orderBy("step").collect()] == want
    assert behave.chosen_meet_all(needs, chosen.select(F.col("candidate").alias("test"))).count() == 0

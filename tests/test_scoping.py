"""Names in scopes against look-ups one at a time."""

import os
import sys

import pytest

from lodestrand.operators.scopes import Scopes
from lodestrand.plans import scoping

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.setrecursionlimit(20_000)


class Index:
    def __init__(self, types, imports, wildcards, methods=(), fields=()):
        self.types = {t["fqn"]: t for t in types}
        self.imports = {(i["module"], i["simple"]): i["fqn"] for i in imports}
        self.wild = {}
        for w in sorted(wildcards, key=lambda w: w["at"]):
            self.wild.setdefault(w["module"], []).append(w["package"])
        self.by_name, self.fields, self.names = {}, {(f["owner"], f["name"]): f["field"] for f in fields}, {m["name"] for m in methods}
        for m in sorted(methods, key=lambda m: m["at"]):
            self.by_name.setdefault((m["owner"], m["name"]), []).append(m)

    def resolve(self, written, context):
        if not written:
            return None
        written = written.removesuffix("...").split("[")[0]
        if written in self.types:
            return written
        head, _, rest = written.partition(".")
        full = lambda x: f"{x}.{rest}" if rest and f"{x}.{rest}" in self.types else x
        scope = context
        while scope:
            if f"{scope}.{head}" in self.types:
                return full(f"{scope}.{head}")
            top, scope = scope, self.types[scope]["outer"]
        package, module = top.rpartition(".")[0], self.types[context]["module"]
        for x in [self.imports.get((module, head)), f"{package}.{head}" if package else head, *(f"{p}.{head}" for p in self.wild.get(module, []))]:
            if x in self.types:
                return full(x)
        return None

    def supers(self, fqn):
        out, queue = [], [fqn]
        while queue:
            here = queue.pop(0)
            for w in self.types[here]["supers"]:
                p = self.resolve(w, here)
                if p and p not in out and p != fqn:
                    out.append(p)
                    queue.append(p)
        return out

    def visible(self, fqn):
        out = []
        while fqn:
            out += [fqn, *self.supers(fqn)]
            fqn = self.types[fqn]["outer"]
        return out

    def targets(self, chain, name, args):
        for t in chain:
            fits = [m for m in self.by_name.get((t, name), []) if args is None or (args >= m["arity"] - 1 if m["varargs"] else args == m["arity"])]
            if fits:
                return fits
        return []

    def calls(self, calls):
        by_id, done = {c["call"]: c for c in calls}, {}

        def one(k):
            if k not in done:
                done[k] = (None, [])
                c = by_id[k]
                here, r = c["caller"], c["receiver"]
                if c["receiver_call"] is not None:
                    t = result(c["receiver_call"]) if c["receiver_call"] in by_id else None
                    chain = [t, *self.supers(t)] if t else None
                elif c["name"] == "<init>":
                    t = self.resolve(c["receiver_type"], here)
                    chain = self.supers(here)[:1] if r == "super" else [here] if r == "this" else [t] if t else None
                elif r in (None, "this"):
                    chain = self.visible(here)
                elif r == "super":
                    chain = self.supers(here)
                else:
                    t = self.resolve(c["receiver_type"], here)
                    chain = [t, *self.supers(t)] if t else None
                done[k] = (chain, self.targets(chain, c["name"], c["args"]) if chain else [])
            return done[k]

        def result(k):
            chain, found = one(k)
            if by_id[k]["name"] == "<init>":
                return chain[0] if chain else None
            return self.resolve(found[0]["returns"], found[0]["owner"]) if found else None

        out = set()
        for k in sorted(by_id):
            c = by_id[k]
            chain, found = one(k)
            if chain is None:
                if c["name"] != "<init>" and c["name"] in self.names:
                    out.add((k, f"unresolved:method:{c['name']}", None, "receiver type not known"))
            elif not found and c["name"] == "<init>" and chain:
                out.add((k, f"class:{chain[0]}", None, None))
            out |= {(k, m["id"], "arity" if len(found) > 1 else None, None) for m in found}
        return out


@pytest.fixture(scope="module")
def index(spark):
    return Index(*[df.collect() for df in scoping.tree(spark, DATA)])


def test_types_and_supertypes(spark, index):
    want = {(t, k, p) for t, row in index.types.items() for k, w in enumerate(row["supers"]) if (p := index.resolve(w, t))}
    assert {tuple(r) for r in scoping.type_names(spark, DATA).collect()} == want
    order = {}
    for r in scoping.type_supertypes(spark, DATA).collect():
        order.setdefault(r["type"], []).append((r["level"], [int(x) for x in r["path"].split(".")], r["ancestor"]))
    assert {t: [a for *_, a in sorted(v)] for t, v in order.items()} == {t: s for t in index.types if (s := index.supers(t))}


def test_fields(spark, index):
    want = {}
    for u in scoping.use_rows(spark, DATA).collect():
        t = None if u["receiver"] in (None, "this") else index.resolve(u["receiver"], u["caller"])
        chain = index.visible(u["caller"]) if u["receiver"] in (None, "this") else [t, *index.supers(t)] if t else []
        if hit := next((index.fields[x, u["name"]] for x in chain if (x, u["name"]) in index.fields), None):
            want[u["use"]] = hit
    assert {r["use"]: r["field"] for r in scoping.field_uses(spark, DATA).collect()} == want and len(want) > 100


def test_chained_calls(spark, index):
    want = index.calls(scoping.call_rows(spark, DATA).collect())
    assert {tuple(r) for r in scoping.chained_calls(spark, DATA).collect()} == want
    assert {t for _, _, t, _ in want} == {None, "arity"} and {r for *_, r in want} == {None, "receiver type not known"}


def test_strategies_clashes_chains_and_cycles(spark):
    T = "fqn string, outer string, module string, supers array<string>"
    types = [("a.A", None, "m", ["B", "x.B"]), ("a.A.B", "a.A", "m", []), ("a.B", None, "n", ["A"]), ("x.B", None, "x", []), ("x.C", None, "x", ["D"]), ("w.D", None, "w", ["x.C"]), ("Top", None, "t", []), ("a.A.B.C", "a.A.B", "m", ["C"])]
    imports, wild = [("m", "C", "x.C"), ("m", "Gone", "q.Gone")], [("x", 0, "none"), ("x", 1, "w"), ("x", 2, "a")]
    methods = [("b1", "a.A.B", 1, "run", 0, False, "C"), ("b2", "a.A.B", 2, "run", 1, True, "B"), ("c1", "x.C", 3, "run", 0, False, "x.B"), ("d1", "w.D", 4, "go", 2, False, "int")]
    calls = [(1, "a.A", "run", "b", "B", None, 0), (2, "a.A", "run", None, None, 1, 0), (3, "a.A", "go", None, None, 2, 2), (4, "a.A", "run", None, None, 5, 0), (5, "a.A", "run", None, None, 4, 0), (6, "a.A", "<init>", None, "x.C", None, 0), (7, "a.A", "run", None, None, 6, None),
             (8, "a.A", "run", "super", None, None, 0), (9, "Top", "run", "super", None, None, 0), (10, "a.A", "nothing", "q", "Q", None, 0), (11, "a.A", "<init>", "super", None, None, 0), (12, "a.A.B.C", "run", None, None, None, 3)]
    C = "call int, caller string, name string, receiver string, receiver_type string, receiver_call int, args int"
    M = "id string, owner string, at int, name string, arity int, varargs boolean, returns string"
    scopes = Scopes(spark.createDataFrame(types, T), spark.createDataFrame(imports, "module string, simple string, fqn string"), spark.createDataFrame(wild, "module string, at int, package string"))
    rows = lambda data, schema: [r.asDict() for r in spark.createDataFrame(data, schema).collect()]
    index = Index(rows(types, T), rows(imports, "module string, simple string, fqn string"), rows(wild, "module string, at int, package string"), rows(methods, M))
    asked = [(w, c) for c in ("a.A", "a.A.B.C", "a.B", "x.C", "Top") for w in ("A", "B", "C", "D", "B.C", "A.B", "a.A.B[]", "x.B...", "Gone", "Top", "B.Z", "", None)]
    refs = spark.createDataFrame([(k, w, c) for k, (w, c) in enumerate(asked)], "ref int, written string, context string")
    got = {r["ref"]: r["type"] for r in scopes.resolve(refs).collect()}
    assert got == {k: t for k, (w, c) in enumerate(asked) if (t := index.resolve(w, c))}
    assert {tuple(r) for r in scopes.calls(spark.createDataFrame(calls, C), spark.createDataFrame(methods, M)).collect()} == index.calls(rows(calls, C))
    empty = Scopes(spark.createDataFrame([], T), spark.createDataFrame([], "module string, simple string, fqn string"), spark.createDataFrame([], "module string, at int, package string"))
    assert empty.calls(spark.createDataFrame([], C), spark.createDataFrame([], M)).count() == 0

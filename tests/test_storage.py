"""Record layouts against a recursive layout of the same descriptions."""

import os
import re

import pytest

from lodestrand.operators import program, storage
from lodestrand.plans import programs
from lodestrand.sources import lines as L

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NO = ("POINTER", "INDEX", "COMP-1", "COMP-2")


class Item:
    def __init__(self, line, text):
        t = text.strip().upper()
        pick = lambda p: (re.search(p, t) or [None, None])[1]
        self.line, self.level, self.name, self.children, self.base = line, int(t[:2]), re.match(r"\d\d\s+([A-Z0-9-]+)", t)[1], [], None
        self.pic, self.redefines = pick(r"\sPIC\s+(\S+?)\.?(?:\s|$)"), pick(r"REDEFINES\s+([A-Z0-9-]+)")
        self.times, self.varies = int(pick(r"OCCURS\s+(\d+)") or 1), bool(re.search(r"OCCURS\s+\d+\s+TO", t))
        self.usage = (re.search(r"\b(COMP(?:UTATIONAL)?(?:-\d)?|BINARY|PACKED-DECIMAL|DISPLAY|POINTER|INDEX)\b(?!-)", re.sub(r"'[^']*'", "", t)) or [None])[0]
        self.usage = self.usage and self.usage.replace("COMPUTATIONAL", "COMP")
        self.value = pick(r"\sVALUE\s+('[^']*'|[\d.]*\d)")


def places(pic):
    return sum(int(n or 1) for n in re.findall(r"[9X](?:\((\d+)\))?", pic))


def size(item, usage, bad):
    """Bytes of one occurrence, or None; sets size and start of all below, starts from the item's own."""
    usage = item.usage or usage
    bad = bad or item.varies or usage in NO
    total, at = 0, {}
    for c in item.children:
        if c.redefines and (same := [x for x in item.children if x.line < c.line and x.name == c.redefines]):
            c.base = same[-1].base or same[-1]
        size(c, usage, bad)
    for c in item.children:
        if c.base is None:
            views = [x for x in item.children if x is c or x.base is c]
            at[c.line] = total
            widest = [x.size * x.times if x.size is not None else None for x in views]
            total = None if total is None or None in widest else total + max(widest)
    item.at = {c.line: at[(c.base or c).line] for c in item.children}
    if bad:
        item.size = None
    elif item.children:
        item.size = total
    elif item.pic is None:
        item.size = None
    else:
        n = places(item.pic)
        item.size = n // 2 + 1 if usage in ("COMP-3", "PACKED-DECIMAL") else (2 if n <= 4 else 4 if n <= 9 else 8) if usage in ("COMP", "COMP-4", "COMP-5", "BINARY") else n


def tops(lines):
    stack, out = [], []
    for line, text in lines:
        if not re.match(r"\s*\d\d\s+[A-Za-z0-9-]+", text) or text.strip().startswith("88"):
            continue
        item = Item(line, text)
        while stack and (stack[-1].level >= item.level or item.level == 77):
            stack.pop()
        (stack[-1].children if stack else out).append(item)
        stack.append(item)
    return out


def laid_out(lines):
    """{line: (name, size, bytes, start)} of items, and occurrences (line, subscripts, start, bytes)."""
    found, each = {}, []

    def place(item, start, tables):
        found[item.line] = (item.name, item.size, None if item.size is None else item.size * item.times, start)
        tables = [*tables, (item.times, item.size)]
        if item.pic and item.size is not None and item.name != "FILLER":
            spots = [((), start)] if start is not None else []
            for times, stride in tables:
                spots = [(s + ((k + 1,) if times > 1 else ()), at + k * (stride or 0)) for s, at in spots for k in range(times)] if times == 1 or stride is not None else []
            each.extend((item.line, ",".join(map(str, s)), at, item.size) for s, at in spots)
        for c in item.children:
            place(c, None if start is None or item.at[c.line] is None else start + item.at[c.line], tables)

    for top in tops(lines):
        size(top, None, False)
        place(top, 0, [])
    return found, each


@pytest.fixture(scope="module")
def texts(spark):
    out = {}
    for r in programs._records(spark, DATA).orderBy("file", "line").collect():
        out.setdefault(r["file"], []).append((r["line"], r["text"]))
    return out


def test_layout_of_all_records(spark, texts):
    got = {}
    for r in programs.storage_layout(spark, DATA).collect():
        got.setdefault(r["file"], {})[r["line"]] = (r["name"], r["size"], r["bytes"], r["start"] if r["problem"] is None and r["size"] is not None else "-")
    clean = 0
    for k, lines in texts.items():
        want, _ = laid_out(lines)
        assert {n: x[:3] for n, x in got[k].items()} == {n: x[:3] for n, x in want.items()}
        if not any(x[1] is None for n, x in want.items()):
            clean += 1
            assert {n: x[3] for n, x in got[k].items()} == {n: x[3] for n, x in want.items()}
    assert clean > 100


def test_occurrences_of_all_records(spark, texts):
    got = {}
    for r in programs.storage_occurrences(spark, DATA).collect():
        got.setdefault(r["file"], []).append((r["line"], r["subscripts"], r["start"], r["bytes"]))
    for k, lines in texts.items():
        want, each = laid_out(lines)
        if not any(x[1] is None for x in want.values()):
            assert sorted(got[k]) == sorted(each)


def test_values_through_shared_storage(spark, texts):
    got = {(r["file"], r["name"], r["value"], r["overlaps"]) for r in programs.storage_values(spark, DATA).collect()}
    want = set()
    for k, lines in texts.items():
        found, _ = laid_out(lines)

        def below(item):
            yield item
            for c in item.children:
                yield from below(c)

        def visit(item, group, k=k, found=found):
            group = item.base or group
            if item.pic and group is not None:
                for other in below(group):
                    if other.value and other.pic == item.pic:
                        a, b = found[item.line], found[other.line]
                        want.add((k, item.name, other.value, a[2] is not None and b[2] is not None and a[3] < b[3] + b[2] and b[3] < a[3] + a[2]))
            for c in item.children:
                visit(c, group)

        for top in tops(lines):
            size(top, None, False)
            visit(top, None)
    assert {x[:3] for x in got} == {x[:3] for x in want} and len(want) > 50


def test_one_record(spark):
    text = "01 R.\n 05 A PIC X(3).\n 05 B REDEFINES A PIC X(5).\n 05 C REDEFINES B PIC X.\n 05 T OCCURS 2 COMP-3.\n  10 N PIC S9(5).\n  10 U OCCURS 3 PIC 9.\n 05 Z PIC X."
    items = storage.described(L.to_lines(spark.createDataFrame([("f", text)], "f string, t string"), "f", "t"))
    placed = storage.record_layout(program.parents(items, [1, 5, 10]))
    assert {r["name"]: (r["start"], r["size"], r["bytes"]) for r in placed.collect()} == {"R": (0, 18, 18), "A": (0, 3, 3), "B": (0, 5, 5), "C": (0, 1, 1), "T": (5, 6, 12), "N": (5, 3, 3), "U": (8, 1, 3), "Z": (17, 1, 1)}
    spots = {(r["name"], tuple(r["subscripts"])): r["start"] for r in storage.occurrences(placed).collect()}
    assert spots["U", (2, 3)] == 16 and spots["N", (2,)] == 11 and spots["Z", ()] == 17 and len(spots) == 12
    none = storage.record_layout(program.parents(items.limit(0), [1, 5]))
    assert none.count() == 0 and storage.occurrences(none).count() == 0

"""Rewriting of program texts against a token-by-token rewriting written here."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import rewrite
from lodestrand.plans import rewriting

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tokens(text):
    """(start, end, word) by scanning characters."""
    out, i, n = [], 0, len(text)
    ends = lambda j: j >= n or text[j].isspace()
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
            continue
        j = i + 1
        if text.startswith("==", i) and (k := text.find("==", i + 2)) >= 0:
            j = k + 2
        elif c in "'\"":
            while j < n and text[j] not in (c, "\n"):
                j += 1
            j += j < n and text[j] == c
        elif c in "()" or (c in ".,;" and ends(i + 1)):
            pass
        else:
            while j < n and not (text[j].isspace() or text[j] in "'\"()" or (text[j] in ".,;" and ends(j + 1))):
                j += 1
        out.append((i, j, text[i:j]))
        i = j
    return out


def key(word):
    return word if word[0] in "'\"" else word.upper()


def bare(word):
    return " ".join((word[2:-2] if word.startswith("==") and word.endswith("==") and len(word) > 3 else word).split())


def put(text, old, new):
    if re.fullmatch(r"\(\S+\)|:\S+:", old):
        out, i = "", 0
        while i < len(text):
            if text[i] in "'\"":
                j = next((k + (text[k] != "\n") for k in range(i + 1, len(text)) if text[k] in (text[i], "\n")), len(text))
                out, i = out + text[i:j], j
            elif text[i : i + len(old)].upper() == old.upper():
                out, i = out + new, i + len(old)
            else:
                out, i = out + text[i], i + 1
        return out
    want = [key(w) for _, _, w in tokens(old) if w not in ",;"]
    found = [t for t in tokens(text) if t[2] not in ",;"]
    hits, i = [], 0
    while want and i + len(want) <= len(found):
        if [key(w) for _, _, w in found[i : i + len(want)]] == want:
            hits.append((found[i][0], found[i + len(want) - 1][1]))
            i += len(want)
        else:
            i += 1
    for a, b in reversed(hits):
        text = text[:a] + new + "\n" * text[a:b].count("\n") + text[b:]
    return text


def pairs_at(found, j):
    out = []
    while j + 2 < len(found) and found[j + 1][2].upper() == "BY":
        out.append((bare(found[j][2]), bare(found[j + 2][2])))
        j += 3
    return out, j


def regions(text):
    found, statements, i = tokens(text), [], 0
    while i < len(found):
        after = found[i + 1][2] if i + 1 < len(found) else ""
        if found[i][2].upper() == "REPLACE" and (after.startswith("==") or after.upper() == "OFF"):
            pairs, j = ([], i + 2) if after.upper() == "OFF" else pairs_at(found, i + 1)
            stop = j < len(found) and found[j][2] == "."
            statements.append((found[i][0], found[j if stop else j - 1][1], pairs))
            i = j + 1
        else:
            i += 1
    out, at = "", 0
    for k, (a, b, pairs) in enumerate(statements):
        to = statements[k + 1][0] if k + 1 < len(statements) else len(text)
        region = text[b:to]
        for old, new in pairs:
            region = put(region, old, new)
        out += text[at:a] + "\n" * text[a:b].count("\n") + region
        at = to
    return out + text[at:]


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_regions_of_all_documents(spark):
    got = {r["file"]: (r["lines"], r["digest"]) for r in rewriting.replace_regions(spark, DATA).collect()}
    texts = {r["file"]: r["text"] for r in rewriting.replace_sources(spark, DATA).collect()}
    want = {k: regions(t) for k, t in texts.items()}
    assert got == {k: (t.count("\n") + 1, hashlib.sha256(t.encode()).hexdigest()) for k, t in want.items()}
    assert all(t.count("\n") == texts[k].count("\n") for k, t in want.items()) and sum(want[k] != t for k, t in texts.items()) > 100


@pytest.mark.parametrize("text", [
    "REPLACE ==A B== BY ==X==. a\n  b A, B AB 'A B' A B. REPLACE OFF. A B", "A REPLACE ==:T:== BY ==new== ==(P)== BY ==q==. :t:-x ':T:' z(P)", "REPLACE ==X.== BY ==Y==. X. X.5 X\nREPLACE ==5== BY ==6==. 5 X.",
    "REPLACE ==== BY ==Y==. A", "no statement REPLACEMENT == A ==", "REPLACE ==\"q w\"== BY 'z' ==e== BY (.\n\"q w\" \"q  w\" E", "REPLACE OFF", "", "REPLACE ==A== BY ==B== ==B== BY ==C== . A B\nA", "REPLACE ==\\E$1.*== BY ==$2\\==. \\E$1.* x", "REPLACE ==A==\nBY ==B==\n.\nA 'unclosed A\nA",
])
def test_regions_case_by_case(spark, text):
    assert one(spark, rewrite.without_replace, text) == regions(text)


def logical(rows):
    out = []
    for number, raw in rows:
        mark, area = (raw[6] if len(raw) > 6 else " "), raw[7:72]
        if mark in "*/dD" or re.match(r"(?i)^\s*(EJECT|SKIP[123])\s*\.?\s*$|^\s*(CBL|PROCESS)\s", area):
            continue
        quote, code = "", ""
        for i, c in enumerate(area):
            if not quote and area.startswith("*>", i):
                break
            quote = "" if quote == c else quote or (c if c in "'\"" else "")
            code += c
        if mark == "-" and out:
            text, quote = out[-1][2], ""
            for c in text:
                quote = "" if quote == c else quote or (c if c in "'\"" else "")
            body = code.lstrip(" ")
            out[-1][1:] = [number, text.ljust(65) + (body[1:] if body.startswith(quote) else body) if quote else text.rstrip(" ") + body]
        elif code.strip(" "):
            out.append([number, number, code.rstrip(" ")])
    return [tuple(x) for x in out]


def test_fixed_lines_of_all_documents(spark):
    by_file = {}
    for r in rewriting.fixed_sources(spark, DATA).orderBy("file", "line").collect():
        by_file.setdefault(r["file"], []).append((r["line"], r["text"]))
    want = {(f, a, b, hashlib.sha256(t.encode()).hexdigest()) for f, rows in by_file.items() for a, b, t in logical(rows)}
    assert {tuple(r) for r in rewriting.fixed_lines(spark, DATA).collect()} == want


def test_continued_literals(spark):
    def of(*lines):
        df = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(lines)], "file string, line int, text string")
        return [(r["line"], r["last"], r["text"]) for r in rewrite.code_lines(df).orderBy("line").collect()]

    first = "000001 DISPLAY 'never en"
    assert of(first, "000002-    'ding sto", "000003-    'ry'.") == [(1, 3, ("DISPLAY 'never en".ljust(65) + "ding sto").ljust(65) + "ry'.")]
    assert of("000001 DISPLAY 'it''s", "000002*    note", "000003-    ' on'", "000004 STOP.") == [(1, 3, "DISPLAY 'it''s".ljust(65) + " on'"), (4, 4, "STOP.")]
    assert of("000001 MOVE A", "000002-    BC TO D.") == [(1, 2, "MOVE ABC TO D.")]
    assert of("000001-   FIRST", "short", "000003/  no", "000004 A *> c '", "000005   SKIP2 .") == [(1, 1, "   FIRST"), (4, 4, "A")]


def expand(text, origin, library, stack, file, copies):
    """Lines [origin, line, text] by statement after statement."""
    rows = [[origin, k + 1, t] for k, t in enumerate(text.split("\n"))]
    found, out, at = tokens(text), [], 0
    starts = [0]
    for _, _, t in rows:
        starts.append(starts[-1] + len(t) + 1)

    def take(a, b):
        line = text[:a].count("\n")
        for k, t in enumerate(text[a:b].split("\n")):
            if t.strip(" "):
                out.append([origin, line + k + 1, t])

    i = 0
    while i < len(found):
        word = found[i][2].upper()
        if word == "COPY" and i + 1 < len(found):
            name, j, pairs = found[i + 1][2].strip("'\"").upper(), i + 2, []
            while j < len(found) and found[j][2].upper() in ("OF", "IN", "SUPPRESS"):
                j += 1 if found[j][2].upper() == "SUPPRESS" else 2
            if j < len(found) and found[j][2].upper() == "REPLACING":
                pairs, j = pairs_at(found, j + 1)
        elif word == "EXEC" and [t[2].upper() for t in found[i + 1 : i + 3]] == ["SQL", "INCLUDE"]:
            name, j, pairs = found[i + 3][2].strip("'\"").upper(), i + 4, []
            if j < len(found) and found[j][2].upper() == "END-EXEC":
                j += 1
        else:
            i += 1
            continue
        stop = found[j if j < len(found) and found[j][2] == "." else j - 1][1]
        take(at, found[i][0])
        at = stop
        problem = "copybook not found" if name not in library else "recursive COPY" if name in stack or len(stack) >= 16 else None
        copies.append((origin, file, name, problem))
        if problem is None:
            body = expand(library[name], name, library, (*stack, name), file, copies)
            joined = "\n".join(t for _, _, t in body)
            for old, new in pairs:
                joined = put(joined, old, new)
            out += [[o, n, t] for (o, n, _), t in zip(body, joined.split("\n"), strict=True)] if body else []
        i = next((k for k, t in enumerate(found) if t[0] >= stop), len(found))
    take(at, len(text))
    return out


def test_copies_of_all_documents(spark):
    files, library = rewriting.book_sources(spark, DATA)
    books = {r["book"].upper(): r["text"] for r in library.collect()}
    lines, copies = rewrite.expand_books(files, library)
    got, said = {}, []
    for r in lines.orderBy("file", "seq").collect():
        got.setdefault(r["file"], []).append([r["origin"], r["line"], r["text"]])
    for r in files.collect():
        want = [x for x in expand(r["text"], str(r["file"]), books, (), r["file"], said) if x[2].strip(" ")]
        assert got.get(r["file"], []) == want
    assert sorted((str(x) for x in said)) == sorted(str((r["origin"], r["file"], r["name"], r["problem"])) for r in copies.collect())
    assert {p for *_, p in said} == {None, "copybook not found", "recursive COPY"}


def test_books_in_books(spark):
    books = spark.createDataFrame([("A", "a1 :X:\n COPY B REPLACING ==:X:== BY ==in==. tail :X:\na3"), ("b", "b1 :X:\n\nCOPY A.\nb3"), ("SELF", "s COPY self. t")], "book string, text string")
    files = spark.createDataFrame([(1, "x COPY a REPLACING ==:X:== BY ==out==.\ny"), (2, "COPY NONE. z"), (3, "COPY SELF"), (4, "plain 'COPY A.'"), (5, ""), (6, None)], "file int, text string")
    lines, copies = rewrite.expand_books(files, books)
    rows = {}
    for r in lines.orderBy("file", "seq").collect():
        rows.setdefault(r["file"], []).append((r["origin"], r["line"], r["text"].strip()))
    assert rows[1] == [("1", 1, "x"), ("A", 1, "a1 out"), ("B", 1, "b1 in"), ("B", 4, "b3"), ("A", 2, "tail out"), ("A", 3, "a3"), ("1", 2, "y")]
    assert rows[2] == [("2", 1, "z")] and rows[3] == [("SELF", 1, "s"), ("SELF", 1, "t")] and rows[4] == [("4", 1, "plain 'COPY A.'")] and 5 not in rows and 6 not in rows
    assert ("B", "A", "recursive COPY") in {(r["origin"], r["name"], r["problem"]) for r in copies.collect()}


def test_embedded_blocks_of_all_documents(spark):
    texts = {r["file"]: r["text"] for r in rewriting.block_sources(spark, DATA).collect()}
    got = {}
    for r in rewriting.embedded_blocks(spark, DATA).orderBy("file", "block").collect():
        got.setdefault(r["file"], []).append((r["kind"], r["text"], r["first"], r["last"], r["digest"]))
    pattern = re.compile(r"(?is)(?<![\w-])EXEC\s+(SQL|CICS|DLI)\b(.*?)\bEND-EXEC\b")
    for k, t in texts.items():
        at = re.search(r"(?i)(?<![\w-])PROCEDURE\s+DIVISION\b", t).start()
        left = pattern.sub(lambda m, at=at: ("CONTINUE" if m.start() >= at else "") + "\n" * m[0].count("\n"), t)
        digest = hashlib.sha256(left.encode()).hexdigest()
        assert got[k] == [(m[1].upper(), " ".join(m[2].split()), t[: m.start()].count("\n") + 1, t[: m.end()].count("\n") + 1, digest) for m in pattern.finditer(t)]

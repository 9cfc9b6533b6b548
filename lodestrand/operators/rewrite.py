"""Text manipulation of program sources before facts are read: fixed-format lines, copied books with replacements, REPLACE regions.

A source is one row; what happens inside it is column expressions over its text, and copied
books are joins, one round for each depth. A rewrite never changes the number of lines, so a
line keeps the place it comes from. Nulls stay null; empty texts have no lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import bound
from lodestrand.sources.scratch import cut

# Forms of literals, words and separators, and of replaced parts of words.
LITERAL = r"""'[^'\n]*'?|"[^"\n]*"?"""
WORD = r"""(?:[^\s'"().,;]|[.,;](?!\s|$))+"""
TOKEN = rf"==.*?==|{LITERAL}|[.,;](?=\s|$)|[()]|{WORD}"
WORD_END = r"""(?=[.,;](?:\s|$)|[\s'"()]|$)"""
PART = r"^(?:\(\S+\)|:\S+:)$"
REPLACE = rf"(?i:REPLACE)\s+(?:(?i:OFF){WORD_END}|==.*?==\s+(?i:BY)\s+(?:{TOKEN})(?:\s+(?:{TOKEN})\s+(?i:BY)\s+(?:{TOKEN}))*)(?:\s*\.(?=\s|$))?"
COPY = (
    rf"(?i:COPY)\s+(?:{TOKEN})(?:\s+(?i:OF|IN)\s+(?:{TOKEN}))?(?:\s+(?i:SUPPRESS){WORD_END})?(?:\s+(?i:REPLACING)(?:\s+(?:{TOKEN})\s+(?i:BY)\s+(?:{TOKEN}))+)?(?:\s*\.(?=\s|$))?"
    rf"|(?i:EXEC\s+SQL\s+INCLUDE)\s+(?:{TOKEN})(?:\s+(?i:END-EXEC)(?:\s*\.(?=\s|$))?)?"
)
DIRECTIVE = r"(?i)^\s*(?:EJECT|SKIP[123])\s*\.?\s*$|^\s*(?:CBL|PROCESS)\s"
#: Books inside books are followed so deep.
DEEPEST = 16
#: Stands for a statement in a text that is about to be split there.
_MARK = "\u0001"


def rewritten(text: Column, wanted: Column, rest: str, put: Callable[[Column], Column]) -> Column:
    """The text with each match of `wanted` (a pattern without groups) replaced by `put` of it; what `rest` matches before is passed over whole."""
    pattern = F.concat(F.lit("(?s)("), wanted, F.lit(f")|{rest}"))
    hits = lambda k: F.regexp_extract_all(text, pattern, F.lit(k))
    made = F.zip_with(hits(0), hits(1), lambda hit, own: F.when(own == "", hit).otherwise(put(own)))
    return bound(made, lambda m: F.array_join(F.zip_with(F.split(text, pattern, -1), m, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), ""))


def line_breaks(text: Column) -> Column:
    """As many line breaks as a text has."""
    return F.regexp_replace(text, r"[^\n]", "")


def operand(text: Column) -> Column:
    """An operand without its == marks, white space as single spaces."""
    inner = F.when(text.rlike("(?s)^==.*==$"), F.substring(text, F.lit(3), F.length(text) - 4)).otherwise(text)
    return F.trim(F.regexp_replace(inner, r"\s+", " "))


def pairs_of(statement: Column) -> Column:
    """(old, new) structs of the operands around BY in a statement."""
    pattern = F.lit(rf"(?s)({TOKEN})\s+(?i:BY)\s+({TOKEN})")
    side = lambda k: F.regexp_extract_all(statement, pattern, F.lit(k))
    return F.zip_with(side(1), side(2), lambda a, b: F.struct(operand(a).alias("old"), operand(b).alias("new")))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def sequence_of(old: Column) -> Column:
    """The pattern of the words of `old` one after another, commas and semicolons between them aside: words in any case, literals as they are. Empty where there is none."""
    words = F.filter(F.regexp_extract_all(old, F.lit(f"(?s){TOKEN}"), F.lit(0)), lambda t: ~t.isin(",", ";"))
    one = lambda t: F.when(t.rlike("""^['"]"""), _quoted(t)).when(t.isin("(", ")"), _quoted(t)).when(t == ".", F.lit(r"\.(?=\s|$)")).otherwise(F.concat(F.lit("(?iu:"), _quoted(t), F.lit(f"){WORD_END}")))
    return F.array_join(F.transform(words, one), r"(?:\s|[,;](?=\s|$))*")


def replaced(text: Column, pairs: Column) -> Column:
    """The text after each (old, new) pair in turn: every sequence of old's words, or the part of a word if old is one such as :TAG:, gives way to new and keeps its line breaks. Literals are whole words."""
    def one(t: Column, p: Column) -> Column:
        part = p["old"].rlike(PART)
        words = sequence_of(p["old"])
        by_word = rewritten(t, words, TOKEN, lambda own: F.concat(p["new"], line_breaks(own)))
        by_part = rewritten(t, F.concat(F.lit("(?iu:"), _quoted(p["old"]), F.lit(")")), LITERAL, lambda own: p["new"])
        return F.when(part, by_part).when(words == "", t).otherwise(by_word)

    return F.aggregate(pairs, text, one)


def without_replace(text: Column) -> Column:
    """The text after its REPLACE statements, which go (their line breaks stay): each rules the text up to the next one, and REPLACE OFF ends it."""
    return bound(text, _without_replace)


def _without_replace(text: Column) -> Column:
    none = F.array().cast("array<string>")
    statements = F.filter(F.regexp_extract_all(text, F.lit(f"(?s)({REPLACE})|{TOKEN}"), F.lit(1)), lambda s: s != "")
    marked = rewritten(text, F.lit(REPLACE), TOKEN, lambda own: F.concat(F.lit(_MARK), line_breaks(own)))
    rules = F.concat(F.array(F.array().cast("array<struct<old:string,new:string>>")), F.transform(F.coalesce(statements, none), pairs_of))
    return bound(rules, lambda r: F.array_join(F.zip_with(F.split(marked, _MARK, -1), r, lambda region, pairs: replaced(region, pairs)), ""))


def code_lines(lines: DataFrame) -> DataFrame:
    """(file, line, last, text) of fixed-format lines (file, line, text): columns 8 to 72 without comment lines, directives and comments at a line's end; continuation lines (column 7 holds -) are joined.

    Where a literal is open at the end of a line, the line is filled up to column 72 and the
    continuation goes on behind its own opening quote. A continuation before all other lines stands alone.
    """
    mark = F.when(F.length("text") > 6, F.substring("text", 7, 1)).otherwise(" ")
    area = F.substring("text", 8, 65)
    code = F.regexp_extract(area, r"""^((?:'[^']*'?|"[^"]*"?|(?!\*>)[^'"])*)""", 1)
    kept = lines.select("file", "line", mark.alias("mark"), code.alias("code"), area.alias("area")).filter(~F.col("mark").isin("*", "/", "d", "D") & ~F.col("area").rlike(DIRECTIVE))
    kept = kept.filter((F.col("mark") == "-") | (F.trim("code") != ""))
    order = W.partitionBy("file").orderBy("line")
    first = F.row_number().over(order) == 1
    begun = kept.withColumn("group", F.sum(F.when((F.col("mark") != "-") | first, 1).otherwise(0)).over(order))
    parts = begun.groupBy("file", "group").agg(F.min("line").alias("line"), F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "code"))).alias("parts"))
    quote = lambda open_, text: F.regexp_extract(F.regexp_replace(F.concat(open_, text), """'[^']*'|"[^"]*\"""", ""), """(['"])""", 1)
    begin = F.rtrim(F.col("parts")[0]["code"])
    state = F.struct(begin.alias("text"), quote(F.lit(""), begin).alias("open"))

    def join(s: Column, p: Column) -> Column:
        body = F.ltrim(p["code"])
        into = F.when(F.substring(body, 1, 1) == s["open"], F.substring(body, F.lit(2), F.length(body))).otherwise(body)
        wide = F.when(F.length(s["text"]) < 65, F.rpad(s["text"], 65, " ")).otherwise(s["text"])
        return F.when(s["open"] != "", F.struct(F.concat(wide, into).alias("text"), quote(s["open"], into).alias("open"))).otherwise(
            F.struct(F.concat(F.rtrim(s["text"]), body).alias("text"), quote(F.lit(""), body).alias("open")))

    joined = F.aggregate(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), state, join)
    return parts.select("file", "line", "last", joined["text"].alias("text")).filter(F.trim("text") != "")


def expand_books(files: DataFrame, library: DataFrame, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(lines, copies): the lines (file, seq, origin, line, text) of files (file, text) with COPY and EXEC SQL INCLUDE statements replaced by the lines of library (book, text), and the statements (origin, file, name, problem).

    Books are expanded first and a statement's replacements made after, over the whole of
    what it brings in. A book inside itself, or deeper than `deepest`, is a recursive COPY and brings in nothing, like an unknown one. Blank lines go. `origin` and `line` are where a line stands.
    """
    name = lambda s: F.upper(F.trim(F.regexp_replace(F.regexp_extract(s, rf"(?s)^(?i:COPY|EXEC\s+SQL\s+INCLUDE)\s+({TOKEN})", 1), """^['"]|['"]$""", "")))
    books = library.groupBy(F.upper("book").alias("name")).agg(F.min("text").alias("book_text"))
    no_pairs = F.array().cast("array<struct<old:string,new:string>>")
    now = cut(files.select("file", F.array().cast("array<int>").alias("path"), F.array().cast("array<string>").alias("inside"), F.col("file").cast("string").alias("origin"), "text", no_pairs.alias("pairs")), "sources")
    levels, copies = [], None
    while True:
        found = F.filter(F.regexp_extract_all("text", F.lit(f"(?s)({COPY})|{TOKEN}"), F.lit(1)), lambda s: s != "")
        marked = rewritten(F.col("text"), F.lit(COPY), TOKEN, lambda own: F.concat(F.lit(_MARK), line_breaks(own)))
        cut_up = cut(now.withColumns({"found": found, "regions": F.split(marked, _MARK, -1)}).drop("text"), "regions")
        begins = F.aggregate("regions", F.array(F.lit(1)), lambda done, r: F.concat(done, F.array(F.element_at(done, -1) + F.length(line_breaks(r)))))
        region = cut_up.withColumn("begins", begins).select("file", "path", "origin", "begins", F.posexplode("regions").alias("at", "region"))
        before = F.col("begins")[F.col("at")]
        own = region.select("file", "path", F.col("at").alias("at"), F.lit(0).alias("side"), F.filter(F.transform(F.split("region", "\n"), lambda t, k: F.struct(F.col("origin").alias("origin"), (before + k).alias("line"), t.alias("text"))), lambda x: F.trim(x["text"]) != "").alias("lines"))
        asks = cut_up.select("file", "path", "inside", "origin", F.posexplode("found").alias("at", "statement")).withColumn("name", name(F.col("statement")))
        hits = asks.join(books, "name", "left")
        deep = F.array_contains("inside", F.col("name")) | (F.size("inside") >= deepest)
        problem = F.when(F.col("book_text").isNull(), "copybook not found").when(deep, "recursive COPY")
        said = hits.select("origin", "file", "name", problem.alias("problem"))
        copies = said if copies is None else copies.unionByName(said)
        levels.append((cut(now.select("file", "path", "pairs"), "pairs"), cut(own, "regions")))
        now = cut(hits.filter(problem.isNull()).select(
            "file", F.concat("path", F.array("at")).alias("path"), F.concat("inside", F.array("name")).alias("inside"), F.col("name").alias("origin"), F.col("book_text").alias("text"), pairs_of(F.col("statement")).alias("pairs")), "sources")
        if now.isEmpty():
            break
    below = None
    for nodes, own in reversed(levels):
        parts = own if below is None else own.unionByName(below)
        whole = parts.groupBy("file", "path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "side", "lines"))), lambda x: x["lines"])).alias("lines"))
        text = replaced(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.col("pairs"))
        put = F.zip_with("lines", F.split(text, "\n"), lambda x, t: F.struct(x["origin"].alias("origin"), x["line"].alias("line"), t.alias("text")))
        done = whole.join(nodes, ["file", "path"]).select("file", "path", F.when(F.size("pairs") > 0, put).otherwise(F.col("lines")).alias("lines"))
        below = cut(done.select("file", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("path"), F.element_at(F.concat(F.array(F.lit(-1)), "path"), -1).alias("at"), F.lit(1).alias("side"), "lines"), "books")
    lines = below.select("file", F.posexplode("lines").alias("k", "x")).select("file", (F.col("k") + 1).alias("seq"), "x.origin", "x.line", "x.text").filter(F.trim("text") != "")
    return lines, copies


def masked_blocks(text: Column) -> Column:
    """A struct: blocks (kind, text with single spaces, first and last line) of EXEC ... END-EXEC, and the text with each given way to CONTINUE behind PROCEDURE DIVISION and to nothing before it, line breaks kept."""
    return bound(text, _masked_blocks)


def _masked_blocks(text: Column) -> Column:
    block = r"(?<![\w-])(?i:EXEC)\s+(?i:SQL|CICS|DLI)\b.*?\b(?i:END-EXEC)\b"
    inner = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)^EXEC\s+(?:SQL|CICS|DLI)\b|\bEND-EXEC$", ""), r"\s+", " "))
    breaks = lambda x: F.length(line_breaks(x))

    def numbered(parts: Column) -> Column:
        # one pass: the line at which the text in front of each block ends, then the block's own
        start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<kind:string,text:string,first:int,last:int>>").alias("made"))

        def step(s: Column, p: Column) -> Column:
            first = s["line"] + breaks(p["before"])
            last = first + breaks(p["block"])
            own = F.struct(F.upper(F.regexp_extract(p["block"], r"(?is)^EXEC\s+(\w+)", 1)).alias("kind"), inner(p["block"]).alias("text"), first.alias("first"), last.alias("last"))
            return F.struct(last.alias("line"), F.concat(s["made"], F.array(own)).alias("made"))

        return F.aggregate(F.filter(parts, lambda p: p["block"].isNotNull()), start, step, lambda s: s["made"])

    parts = F.zip_with(F.split(text, f"(?s){block}", -1), F.regexp_extract_all(text, F.lit(f"(?s){block}"), F.lit(0)), lambda a, b: F.struct(a.alias("before"), b.alias("block")))
    given = lambda part, put: rewritten(part, F.lit(block), r"\x00", lambda own: F.concat(F.lit(put), line_breaks(own)))
    both = lambda at: F.concat(given(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), ""), given(F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(""), "CONTINUE"))
    return F.struct(bound(parts, numbered).alias("blocks"), bound(F.regexp_instr(text, F.lit(r"(?i)(?<![\w-])PROCEDURE\s+DIVISION\b")), both).alias("masked"))

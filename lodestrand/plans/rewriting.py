"""Queries on program texts before facts are read: REPLACE regions, copied books, fixed-format lines and embedded blocks, in texts that vary with the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import rewrite
from lodestrand.plans.derive import spread, table
from lodestrand.sources import lines as L
from lodestrand.sources.scratch import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _word(k):
    """A word of the document's own, without what would end a word."""
    found = F.get(F.filter(F.regexp_extract_all("text", F.lit(r"(?<!\S)([A-Za-zÀ-ÖØ-Ýà-öø-ý]{2,12})(?!\S)"), F.lit(1)), lambda w: ~F.upper(w).isin("BY", "OF", "IN", "OFF", "COPY", "REPLACE")), F.lit(k))
    return F.coalesce(found, F.lit(f"none{k}"))


def _docs(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    words = docs.withColumns({f"w{k}": _word(k) for k in range(4)})
    return cut(words.withColumn("whole", F.split(F.regexp_replace("text", "(?i)\\b(copy|replace|exec)\\b", "x$1"), "\n")), "words")


def _t(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def replace_sources(spark, d):
    """(file, text): a document's lines with REPLACE statements around its halves, which name words of its own, parts of words and literals."""
    docs = _docs(spark, d)
    half = F.call_function("div", F.size("whole"), F.lit(2)).cast("int")
    lines = lambda a, n: F.array_join(F.slice("whole", a, n), "\n")
    text = _t(
        "START :TAG:-", F.col("w0"), " '", F.col("w0"), "'.\nREPLACE ==", F.col("w0"), "== BY ==", F.col("w1"), " new-", F.col("w0"), "==\n  ==:TAG:== BY ==K", F.col("doc_id").cast("string"), "==.\n:TAG:-A ", F.upper("w0"), ", ':TAG:'\n", lines(F.lit(1), half),
        "\nREPLACE ==", F.col("w2"), " ", F.col("w3"), "== BY ==[", F.col("w2"), "]==. ", F.col("w2"), "\n\n ", F.upper("w3"), " ", lines(half + 1, F.size("whole")), "\nREPLACE OFF.\n", F.col("w2"), " ", F.col("w3"), " end.")
    return docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("file"), text.alias("text"))


@query
def replace_regions(spark, d):
    """Each source after its REPLACE statements: lines, and a digest of the text."""
    made = replace_sources(spark, d).select("file", rewrite.without_replace(F.col("text")).alias("text"))
    return made.select("file", F.size(F.split("text", "\n")).alias("lines"), F.sha2("text", 256).alias("digest"))


def book_sources(spark, d):
    """files (file, text) that copy books, and library (book, text): books are documents, some of which copy another one, or themselves."""
    docs = _docs(spark, d).filter("text IS NOT NULL")
    k = F.col("doc_id")
    body = F.array_join("whole", "\n")
    books = docs.select(_t("BK", (k % 200).cast("string")).alias("book"), k.alias("k"), _t(
        "01 :P:-REC.\n", F.array_join(F.slice("whole", 1, 6), "\n"),
        F.when(k % 3 == 0, _t("\n  COPY BK", ((k * 7 + 1) % 230).cast("string"), " REPLACING ==:P:== BY ==Q", (k % 9).cast("string"), "==. 05 REST.")).when(k % 3 == 1, _t("\nEXEC SQL INCLUDE 'bk", ((k * 5 + 3) % 200).cast("string"), "' END-EXEC.")).when(k % 9 == 2, _t("\nCOPY bk", (k % 200).cast("string"), ".")).otherwise("\n  05 :P:-LAST.")).alias("text"))
    library = books.groupBy("book").agg(F.min_by("text", "k").alias("text"))
    files = docs.select(k.alias("file"), _t("HEAD ", F.col("w0"), " COPY bk", (k % 211).cast("string"), " OF LIB REPLACING ==:P:== BY ==", F.col("w1"), "== ", F.col("w0"), " BY ", F.col("w2"), " .\n", body, "\nCOPY BK", ((k * 3) % 200).cast("string"), ".").alias("text"))
    return files, library


@query
def copy_replacing(spark, d):
    """Lines of each source after copying, by where they come from, with a digest."""
    lines, _ = rewrite.expand_books(*book_sources(spark, d))
    own = F.array_sort(F.collect_list(F.struct("seq", "origin", "line", "text")))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("origin").alias("origins"), F.sha2(F.array_join(F.transform(own, lambda x: F.concat_ws("|", x["origin"], x["line"].cast("string"), x["text"])), "\n"), 256).alias("digest"))


@query
def copy_problems(spark, d):
    """Copy statements by what came of them."""
    _, copies = rewrite.expand_books(*book_sources(spark, d))
    return copies.groupBy("origin", "name", F.coalesce("problem", F.lit("expanded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def fixed_sources(spark, d):
    """(file, line, text): documents' lines as fixed-format ones, with comments, continuations and literals over several lines."""
    lines = L.to_lines(_docs(spark, d).filter("text IS NOT NULL").select("doc_id", "text"), "doc_id", "text")
    k = F.col("line")
    mark = F.when((k + F.col("file")) % 11 == 0, "*").when((k % 6).isin(2, 3), "-").when(k % 17 == 0, "d").otherwise(" ")
    body = F.substring("text", 1, 50)
    area = F.when(k % 6 == 1, _t(body, " 'it is ")).when(k % 6 == 2, _t("   '", body)).when(k % 6 == 3, _t("  ' done' ", body)).when(k % 6 == 4, _t(body, " ''*>'' \"*> in\" *> not")).when(k % 29 == 0, "  EJECT.").otherwise(body)
    return lines.select("file", "line", _t(F.lpad(k.cast("string"), 6, "0"), mark, area).alias("text"))


@query
def fixed_lines(spark, d):
    """Logical lines of fixed-format sources."""
    made = rewrite.code_lines(fixed_sources(spark, d))
    return made.select("file", "line", "last", F.sha2("text", 256).alias("digest"))


def block_sources(spark, d):
    """(file, text): documents' words in EXEC blocks before and behind PROCEDURE DIVISION."""
    docs = _docs(spark, d).filter("text IS NOT NULL")
    text = _t("WORKING.\n EXEC SQL INCLUDE ", F.col("w0"), "\n END-EXEC.\nPROCEDURE  DIVISION.\n", F.array_join(F.slice("whole", 1, 4), "\n"), "\nexec cics READ\n  FILE('", F.col("w1"), "')\n\n END-EXEC. MOVE A TO B.\nNON-EXEC SQL X END-EXEC.\n EXEC DLI ", F.col("w2"), " END-EXEC\n", F.array_join("whole", " "))
    return docs.select(F.col("doc_id").alias("file"), text.alias("text"))


@query
def embedded_blocks(spark, d):
    """EXEC blocks with the lines that they span, and a digest of what is left of the source."""
    made = block_sources(spark, d).select("file", rewrite.masked_blocks(F.col("text")).alias("made"))
    rows = made.select("file", F.col("made.blocks").alias("blocks"), F.sha2("made.masked", 256).alias("digest"))
    return rows.select("file", "digest", F.posexplode("blocks").alias("k", "b")).select("file", (F.col("k") + 1).alias("block"), "b.kind", "b.first", "b.last", "b.text", "digest")

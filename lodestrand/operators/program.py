"""Facts inside programs: data hierarchy, copied text, values, layouts, calls and arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.sources.scratch import Grown, cut


def data_items(lines: DataFrame, *more: Column) -> DataFrame:
    """(file, line, level, name, picture, occurs, value) of data description lines, and more columns of these."""
    t = F.upper(F.trim("text"))
    some = lambda p: F.when(F.regexp_extract(t, p, 1) != "", F.regexp_extract(t, p, 1))
    return lines.filter(t.rlike(r"^[0-9]{2}\s+[A-Z0-9-]+")).select(
        "file", "line", F.regexp_extract(t, r"^([0-9]{2})", 1).cast("int").alias("level"), F.regexp_extract(t, r"^[0-9]{2}\s+([A-Z0-9-]+)", 1).alias("name"),
        some(r"\sPIC(?:TURE)?\s+(?:IS\s+)?([^\s]+?)\.?(?:\s|$)").alias("picture"), some(r"\sOCCURS\s+([0-9]+)").cast("int").alias("occurs"), some(r"\sVALUE\s+(?:IS\s+)?('[^']*'|[0-9.]*[0-9])").alias("value"), *more)


def parents(items: DataFrame, levels: list[int]) -> DataFrame:
    """Adds the line of each item's group: the nearest line above with a smaller level. 77 and 01 have none; 88 belongs to the item above.

    `levels` are those in use (at most 49): one running last value for each, no self-join.
    """
    before = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    plain = [n for n in sorted(levels) if n not in (66, 77, 88)]
    last = F.array(*[F.struct(F.last(F.when(F.col("level") == n, F.col("line")), ignorenulls=True).over(before).alias("line"), F.lit(n).alias("level")) for n in plain])  # a stale line of a level is never the nearest: its own successors are nearer
    nearest = F.array_max(F.transform(F.filter("_last", lambda x: (x["level"] < F.col("level")) & x["line"].isNotNull()), lambda x: x["line"]))
    return items.withColumn("_last", last).withColumn("parent", F.when(~F.col("level").isin(1, 66, 77), nearest)).drop("_last")


def expand_copies(lines: DataFrame, library: DataFrame, most: int = 16) -> DataFrame:
    """(file, order, text): lines with `COPY NAME.` replaced by the book's lines, again and again; unknown books and recursion deeper than `most` stay as they are.

    lines: (file, line, text); library: (book, line, text). `order` is an array of line numbers by depth.
    """
    now = lines.select("file", F.array("line").alias("order"), "text", F.array().cast("array<string>").alias("inside"))
    book = F.upper(F.regexp_extract("text", r"(?i)^\s*COPY\s+([A-Z0-9-]+)\s*\.", 1))
    done = None
    for _ in range(most):
        now = now.withColumn("book", book)
        here = now.join(library.select("book", F.col("line").alias("_line"), F.col("text").alias("_text")), "book", "left")
        open_ = F.col("_text").isNotNull() & ~F.array_contains("inside", F.col("book"))
        closed = here.filter(~open_).select("file", "order", "text").distinct()
        done = closed if done is None else done.unionByName(closed)
        now = cut(here.filter(open_).select("file", F.concat("order", F.array("_line")).alias("order"), F.col("_text").alias("text"), F.concat("inside", F.array("book")).alias("inside")), "copies")
        if now.isEmpty():
            return done
    return done.unionByName(now.select("file", "order", "text"))


def values(moves: DataFrame, literals: DataFrame) -> DataFrame:
    """(field, value): what a field may hold by literals (field, value) and chains of moves (source, target), cycles included."""
    start = literals.select("field", "value").distinct()
    found = Grown(moves.sparkSession, start.schema, "values")
    moves, fresh = cut(moves.select("source", "target").distinct(), "moves"), found.add(start)
    while True:
        known = found.read()
        step = fresh.join(moves, fresh["field"] == moves["source"]).select(F.col("target").alias("field"), "value").distinct()
        fresh = found.add(step.join(known, ["field", "value"], "left_anti"))
        if fresh.isEmpty():
            return known


def layout(fields: DataFrame, size: Column) -> DataFrame:
    """Adds start and bytes of each field (record, seq, occurs) laid out one after another."""
    bytes_ = size * F.coalesce("occurs", F.lit(1))
    order = W.partitionBy("record").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return fields.withColumn("bytes", bytes_).withColumn("start", F.coalesce(F.sum("bytes").over(order), F.lit(0).cast("long")))


def chains(types: DataFrame) -> DataFrame:
    """(type, ancestor, least distance) with each type itself at 0, however long a chain is; types: (type, super). A cycle ends where it closes."""
    start = types.select("type", F.col("type").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    found = Grown(types.sparkSession, start.schema, "chains")
    up = cut(types.filter("super IS NOT NULL").select(F.col("type").alias("ancestor"), F.col("super").alias("next")).distinct(), "supers")
    last = found.add(start)
    while True:
        known = found.read()
        step = last.join(up, "ancestor").groupBy("type", F.col("next").alias("ancestor")).agg((F.min("distance") + 1).alias("distance"))
        last = found.add(step.join(known, ["type", "ancestor"], "left_anti"))
        if last.isEmpty():
            return known


def resolve_calls(calls: DataFrame, chain: DataFrame, methods: DataFrame) -> DataFrame:
    """(call, owner): the nearest ancestor whose method takes the arguments (all of its overloads); null where there is none.

    calls: (call, type, name, args); methods: (owner, name, arity, varargs).
    """
    found = calls.join(chain, "type").join(methods.withColumnRenamed("owner", "ancestor"), ["ancestor", "name"]).filter((F.col("arity") == F.col("args")) | (F.col("varargs") & (F.col("args") >= F.col("arity") - 1)))
    best = found.withColumn("k", F.rank().over(W.partitionBy("call").orderBy("distance"))).filter("k = 1").select("call", F.col("ancestor").alias("owner")).distinct()
    return calls.select("call").distinct().join(best, "call", "left")


def arguments(calls: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds to calls (file, line, field) the literal last moved to the field on an earlier line: an as-of lookup by one window over both."""
    both = calls.select("file", "line", "field", F.lit(None).cast("string").alias("literal"), F.lit(1).alias("call")).unionByName(moves.select("file", "line", "field", "literal", F.lit(0).alias("call")))
    before = W.partitionBy("file", "field").orderBy("line").rangeBetween(W.unboundedPreceding, -1)
    return both.withColumn("argument", F.last("literal", ignorenulls=True).over(before)).filter("call = 1").select("file", "line", "field", "argument")


def flow_parts(statement: Column) -> dict[str, Column]:
    """senders and receivers (arrays) of MOVE, COMPUTE, ADD, SUBTRACT, MULTIPLY and DIVIDE statements."""
    s = F.regexp_replace(F.upper(F.trim(statement)), r"\.$", "")
    names = lambda part: F.filter(F.regexp_extract_all(part, F.lit(r"(?<![A-Z0-9'-])([A-Z][A-Z0-9-]*)(?![A-Z0-9'-])"), 1), lambda x: ~x.isin("ROUNDED", "TO", "FROM", "BY", "INTO", "GIVING", "OF", "IN", "REMAINDER"))
    cut_at = lambda word, k: F.regexp_extract(s, rf"^\w+\s+(.*?)\s+{word}\s+(.*)$", k)
    giving = s.rlike(r"\sGIVING\s")
    word = {"MOVE": "TO", "ADD": "TO", "SUBTRACT": "FROM", "MULTIPLY": "BY", "DIVIDE": "INTO"}
    send, receive = F.when(s.startswith("COMPUTE "), names(F.regexp_extract(s, r"=(.*)$", 1))), F.when(s.startswith("COMPUTE "), names(F.regexp_extract(s, r"^COMPUTE\s+(.*?)=", 1)))
    for verb, w in word.items():
        is_ = s.startswith(verb + " ")
        if verb != "MOVE":
            send = send.when(is_ & giving, names(cut_at("GIVING", 1)))
            receive = receive.when(is_ & giving, names(cut_at("GIVING", 2)))
            send = send.when(is_, F.array_union(names(cut_at(w, 1)), names(cut_at(w, 2))))
        else:
            send = send.when(is_, names(cut_at(w, 1)))
        receive = receive.when(is_, names(cut_at(w, 2)))
    return {"senders": send, "receivers": receive}


def host_variables(sql: Column) -> dict[str, Column]:
    """reads and writes: names behind colons; those of an INTO list are written."""
    into = F.regexp_extract(sql, r"(?i)\bINTO\s+(:[A-Z0-9-]+(?:\s*,\s*:[A-Z0-9-]+)*)", 1)
    names = lambda part: F.array_distinct(F.transform(F.regexp_extract_all(part, F.lit(r":([A-Za-z0-9-]+)"), 1), F.upper))
    return {"reads": names(F.regexp_replace(sql, r"(?i)\bINTO\s+:[A-Z0-9-]+(?:\s*,\s*:[A-Z0-9-]+)*", " ")), "writes": names(into)}


def qualified(references: DataFrame, items: DataFrame) -> DataFrame:
    """Adds target and reason to references (ref, name, qualifiers array): the only item (id, name, path array) whose path holds all qualifiers.

    Items with one name and path, and references with one name and qualifiers, are taken together: how many items there are and the least of them is all that a reference asks for.
    """
    parts = lambda c: F.array_sort(F.array_distinct(c))
    kinds = items.groupBy("name", parts(F.coalesce("path", F.array().cast("array<string>"))).alias("path")).agg(F.count("id").alias("n"), F.min("id").alias("first"))
    asked = references.select("ref", "name", parts(F.col("qualifiers")).alias("asked"))
    each = asked.select("name", "asked").distinct()
    fits = F.col("n").isNotNull() & (F.size(F.array_except("asked", "path")) == 0)
    found = each.join(kinds, "name", "left").groupBy(F.col("name").alias("_name"), F.col("asked").alias("_asked")).agg(F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("n"), F.min(F.when(fits, F.col("first"))).alias("target"))
    n = asked.join(found, F.col("name").eqNullSafe(F.col("_name")) & F.col("asked").eqNullSafe(F.col("_asked"))).groupBy("ref").agg(F.sum("n").alias("n"), F.min("target").alias("target"))
    return n.select("ref", F.when(F.col("n") == 1, F.col("target")).alias("target"), F.when(F.col("n") == 0, "not found").when(F.col("n") > 1, "ambiguous").alias("reason"))


def replay(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(test, field, was, now) of fields that differ; both: (test, output map). Missing runs and fields differ from all values."""
    long = lambda df, v: df.select("test", F.explode("output").alias("field", v))
    joined = long(expected, "was").join(long(actual, "now"), ["test", "field"], "full")
    return joined.filter(~F.col("was").eqNullSafe(F.col("now")))

"""Building a typed dependency graph from fact tables: joins that keep unresolved targets visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.program import values


def merge_nodes(nodes: DataFrame, rank: str = "rank") -> DataFrame:
    """Of nodes seen several times, the first sighting."""
    rest = [c for c in nodes.columns if c not in ("id", rank)]
    return nodes.groupBy("id").agg(*[F.min_by(c, rank).alias(c) for c in rest])


def merge_edges(edges: DataFrame, rank: str = "rank") -> DataFrame:
    """Of edges with one key, the last one written."""
    rest = [c for c in edges.columns if c not in ("key", rank)]
    return edges.groupBy("key").agg(*[F.max_by(c, rank).alias(c) for c in rest])


def resolve(references: DataFrame, targets: DataFrame, on: str, reason: str) -> DataFrame:
    """Every reference, with `resolved`, its `target` (a stub where there is none) and the reason. `targets` has one row for each `on`."""
    known = targets.select(F.col(on).alias("_known")).distinct()
    joined = references.join(known, references[on] == F.col("_known"), "left")
    found = F.col("_known").isNotNull()
    name = F.coalesce(F.col(on).cast("string"), F.lit("?"))
    return joined.select(
        *references.columns, found.alias("resolved"), F.when(found, name).otherwise(F.concat(F.lit("unresolved:"), name)).alias("target"),
        F.when(~found, F.lit(reason)).alias("reason"),
    )


def ranked_fallback(references: DataFrame, candidates: DataFrame, on: list[str], near: list[str], order: list[str], key: list[str]) -> DataFrame:
    """For each reference (`key`), the `order` columns of its best candidate: the first by them of those that have its `on` and `near` columns, else of all that have its `on` columns; references without candidates stay, with nulls.

    The best are found before they meet the references, so that none of these is joined with more than two.
    """
    given = candidates.dropna(subset=order)
    first = lambda by, name: given.groupBy(*by).agg(F.min(F.struct(*order)).alias(name))
    found = references.join(first([*on, *near], "_near"), [*on, *near], "left").join(first(on, "_far"), on, "left")
    best = found.groupBy(*key).agg(F.min("_near").alias("_near"), F.min("_far").alias("_far"))
    return best.select(*key, *[F.coalesce("_near", "_far")[c].alias(c) for c in order])


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Adds the prefix table's columns for the longest prefix of each row's text, nulls where none fits.

    A join by equality: rows are expanded by the lengths that prefixes have (few), not compared with every prefix.
    """
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).distinct().collect())  # as many rows as prefixes have lengths
    distinct = rows.select(F.col(text).alias("_text")).distinct()
    pieces = distinct.select("_text", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("_text"))).alias("_n"))
    hits = pieces.withColumn(prefix, F.substring(F.col("_text"), F.lit(1), F.col("_n"))).join(prefixes, prefix)
    best = hits.groupBy("_text").agg(*[F.max_by(c, "_n").alias(c) for c in prefixes.columns])
    return rows.join(best, rows[text] == best["_text"], "left").drop("_text")


def crossings(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends belong to different components; owners: (id, component)."""
    a, b = owners.select(F.col("id").alias("src"), F.col("component").alias("src_component")), owners.select(F.col("id").alias("dst"), F.col("component").alias("dst_component"))
    return edges.join(a, "src").join(b, "dst").filter(F.col("src_component") != F.col("dst_component"))


def shared_by(uses: DataFrame) -> DataFrame:
    """Resources that several components use: (resource, components, users); uses: (resource, component)."""
    return uses.distinct().groupBy("resource").agg(F.array_sort(F.collect_set("component")).alias("components"), F.count(F.lit(1)).alias("users")).filter("users > 1")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by kind, and of unresolved edges."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "kind", "n").unionByName(
        edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "kind", "n")).unionByName(
        edges.filter(~F.col("resolved")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unresolved").alias("what"), "kind", "n"))


def cited_lines(lines: DataFrame, citations: DataFrame) -> DataFrame:
    """citations (file, first, last, word, ...) with `ok`: some line of `file` between first and last contains the word. A join by line, as a citation names few."""
    cited = citations.filter("first <= last").select("*", F.explode(F.sequence("first", "last")).alias("_line"))
    hit = cited.join(lines.select("file", F.col("line").alias("_line"), "text"), ["file", "_line"]).filter(F.contains("text", "word"))
    hit = hit.select(*[F.col(c).alias(f"_{c}") for c in citations.columns], F.lit(True).alias("_hit")).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in citations.columns if c != "file"]
    return citations.join(hit, [F.col("file") == F.col("_file"), *same], "left").select(*citations.columns, F.coalesce("_hit", F.lit(False)).alias("ok"))


def overlapping(changes: DataFrame, hunks: DataFrame, width: int = 64) -> DataFrame:
    """changes (file, id, first, last) that touch no changed hunk (file, begin, end) of their file: a join by file and block of `width` lines, in which ranges are compared."""
    block = lambda first, last: F.explode(F.sequence(F.floor(first / width), F.floor(last / width))).alias("_block")
    a = changes.select("file", "id", "first", "last", block(F.col("first"), F.col("last")))
    b = hunks.select("file", "begin", "end", block(F.col("begin"), F.col("end")))
    touched = a.join(b, ["file", "_block"]).filter((F.col("begin") <= F.col("last")) & (F.col("first") <= F.col("end"))).select("file", "id").distinct()
    return changes.join(touched, ["file", "id"], "left_anti")


def assemble(nodes: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph from sightings of nodes (id, kind, name, rank) and references (key, rank, src, kind, target_kind, target, where).

    A reference leads to the node of its kind and name, or to a stub `unresolved:kind:name`, which becomes a node. An edge is
    known by the fact (key) that it comes from: two statements make two edges, and of a fact that is written twice the last counts.
    """
    known = merge_nodes(nodes)
    by_name = known.groupBy(F.col("kind").alias("target_kind"), F.col("name").alias("target")).agg(F.min("id").alias("_id"))
    stub = F.concat_ws(":", F.lit("unresolved"), "target_kind", F.coalesce("target", F.lit("?")))
    joined = merge_edges(references).join(by_name, ["target_kind", "target"], "left")
    edges = joined.select("key", "src", F.coalesce("_id", stub).alias("dst"), "kind", F.col("_id").isNotNull().alias("resolved"), "target_kind", "target", "where")
    stubs = edges.filter("NOT resolved").select(F.col("dst").alias("id"), F.col("target_kind").alias("kind"), F.col("target").alias("name")).distinct()
    return known.select("id", "kind", "name").unionByName(stubs), edges.drop("target_kind", "target")


def dynamic_calls(calls: DataFrame, values: DataFrame, programs: DataFrame) -> DataFrame:
    """(src, dst, resolved, probable) of calls (src, field, literal): a literal's program for sure; a field's programs by the values (field, value) that it may hold, as probable ones; a stub where neither is known. programs: (name, id)."""
    fixed = calls.filter("literal IS NOT NULL").select("src", F.col("literal").alias("name"), F.lit(False).alias("probable"))
    held = calls.filter("literal IS NULL").join(values, "field", "left").select("src", F.coalesce(F.trim("value"), F.concat(F.lit("?"), "field")).alias("name"), F.col("value").isNotNull().alias("probable"))
    named = fixed.unionByName(held).distinct().join(programs, "name", "left")
    return named.select("src", F.coalesce("id", F.concat(F.lit("unresolved:program:"), "name")).alias("dst"), F.col("id").isNotNull().alias("resolved"), "probable")


def procedures(wanted: DataFrame, paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds `found` to wanted (ref, program, name, section, in_section): the paragraph of that name, one in the caller's section first, else the section of that name.

    paragraphs: (program, section, seq, name, id); sections: (program, seq, name, id). With `in_section` (a qualified name) only that section's paragraphs count. The first in the program's order is taken.
    """
    p = paragraphs.select("program", "name", F.col("section").alias("_section"), F.col("seq").alias("_seq"), F.col("id").alias("_id"))
    near = wanted.join(p, ["program", "name"]).filter(F.col("in_section").isNull() | F.col("_section").eqNullSafe(F.col("in_section")))
    first = near.groupBy("ref").agg(F.min(F.struct((~F.col("_section").eqNullSafe(F.col("section"))).alias("far"), "_seq", "_id")).alias("p")).select("ref", F.col("p._id").alias("_paragraph"))
    s = sections.groupBy("program", "name").agg(F.min_by("id", "seq").alias("_whole"))
    return wanted.join(first, "ref", "left").join(s, ["program", "name"], "left").withColumn("found", F.coalesce("_paragraph", "_whole")).drop("_paragraph", "_whole")


def jump_edges(jumps: DataFrame, paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """(key, src, dst, kind, resolved, thru) of PERFORM and GO TO statements (key, program, src, kind, target, thru, section, in_section): one edge for each statement, with its THRU end beside it.

    What no paragraph or section has the name of is a stub; an unknown THRU end stays the name that it is.
    """
    ask = lambda name: jumps.select(F.col("key").alias("ref"), "program", F.col(name).alias("name"), "section", "in_section").filter("name IS NOT NULL")
    to = procedures(ask("target"), paragraphs, sections).select(F.col("ref").alias("key"), F.col("found").alias("_dst"))
    end = procedures(ask("thru"), paragraphs, sections).select(F.col("ref").alias("key"), F.col("found").alias("_thru"))
    found = jumps.join(to, "key", "left").join(end, "key", "left")
    known = F.col("_dst").isNotNull()
    dst = F.coalesce("_dst", F.concat(F.lit("unresolved:paragraph:"), F.coalesce("target", F.lit("?"))))
    return found.select("key", "src", dst.alias("dst"), "kind", known.alias("resolved"), F.when(known, F.coalesce("_thru", "thru")).alias("thru"))


def shared_through(edges: DataFrame, shared: DataFrame, owners: DataFrame) -> DataFrame:
    """(resource, components, users): resources (id) that several components reach, directly or through other nodes that no component owns. edges: (src, dst); owners: (id, component).

    What reaches a resource is pushed along edges between such nodes until nothing is new; a round joins only what was new in the one before.
    """
    into = edges.join(shared.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct()
    direct = into.join(owners.select(F.col("id").alias("src"), "component"), "src").select(F.col("dst").alias("field"), F.col("component").alias("value"))
    between = into.join(owners.select(F.col("id").alias("src")), "src", "left_anti").filter("src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return shared_by(values(between, direct).select(F.col("field").alias("resource"), F.col("value").alias("component")))


def flow_edges(statements: DataFrame, items: DataFrame) -> DataFrame:
    """(src, dst, resolved) from each source to each target of statements (sources and targets, arrays of names); items: (name, id). What is unknown is a stub."""
    pairs = statements.select("*", F.explode("sources").alias("_source")).select("*", F.explode("targets").alias("_target"))
    a, b = items.select(F.col("name").alias("_source"), F.col("id").alias("_a")), items.select(F.col("name").alias("_target"), F.col("id").alias("_b"))
    stub = lambda name: F.concat(F.lit("unresolved:data:"), F.col(name))
    found = pairs.join(a, "_source", "left").join(b, "_target", "left")
    return found.select(F.coalesce("_a", stub("_source")).alias("src"), F.coalesce("_b", stub("_target")).alias("dst"), (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("resolved"))


def bindings(dds: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, step): a program's file bound to a step's dataset where its assigned name, without device prefixes, is the DD's. dds: (step, program, dd, dataset); files: (program, assigned, id)."""
    named = files.select("program", F.regexp_replace(F.upper("assigned"), r"^([A-Z]{2}-)*(S-)?", "").alias("dd"), "id")
    return dds.join(named, ["program", "dd"]).select(F.col("id").alias("src"), F.concat(F.lit("dataset:"), F.col("dataset")).alias("dst"), "step").distinct()

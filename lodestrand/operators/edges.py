"""Edges of jobs, transactions, files and copied books, each known by the fact that it comes from.

All functions give (key, src, dst, kind, resolved, reason, and what the kind adds); a target that the tree hasn't got is a stub `unresolved:kind:name`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Commands of transactions by what their option names.
FILE_COMMANDS = ("READ", "READNEXT", "READPREV", "STARTBR", "WRITE", "REWRITE", "DELETE", "UNLOCK", "ENDBR", "RESETBR")
SCREEN_COMMANDS = ("SEND", "RECEIVE")
TRANSACTION_COMMANDS = ("START", "RETURN")
REGIONS = ("DFSRRC00",)


def _t(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _edges(df: DataFrame, key: Column, src: Column, dst: Column, kind: str, *more: Column) -> DataFrame:
    return df.select(key.alias("key"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(True).alias("resolved"), F.lit(None).cast("string").alias("reason"), *more)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def known_or_stub(df: DataFrame, name: str, known: DataFrame, kind: str, reason: str) -> DataFrame:
    """Rows with dst, resolved and reason for the target `name`: kind:name where known (name) has it, else a stub. A null name has no row."""
    hit = known.select(F.col("name").alias(name), F.lit(True).alias("_hit")).distinct()
    found = F.coalesce("_hit", F.lit(False))
    return df.filter(F.col(name).isNotNull()).join(hit, name, "left").withColumns({
        "dst": F.when(found, _t(f"{kind}:", F.col(name))).otherwise(_t(f"unresolved:{kind}:", F.col(name))), "resolved": found, "reason": F.when(~found, reason)}).drop("_hit")


def job_edges(steps: DataFrame, runs: DataFrame, dds: DataFrame, programs: DataFrame, procs: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of jobs: contains, runs, runs-proc, dd and binds.

    steps: (job, job_kind, step, program, proc); runs: (job, step, program), further programs that a step's input or region
    names; dds: (job, step, dd, dataset, disp); programs and procs: (name); files: (program, assigned, id).
    A step without a program runs its procedure. A file is bound to the dataset of the DD that its assigned name, without device prefixes, is.
    """
    step = _t("step:", F.col("job"), ".", F.col("step"))
    keep = ("key", "src", "dst", "kind", "resolved", "reason")
    contains = _edges(steps, _t("contains>", step), _t(F.lower("job_kind"), ":", F.col("job")), step, "contains")
    main = known_or_stub(steps, "program", programs, "program", "program not in the analyzed code").withColumns({"key": _t("runs>", step), "src": step, "kind": F.lit("runs")}).select(*keep)
    via = F.when(F.col("_main").isin(*REGIONS), "ims-region").otherwise("tso-run")
    named = runs.join(steps.select("job", "step", F.col("program").alias("_main")), ["job", "step"])
    more = known_or_stub(named, "program", programs, "program", "program not in the analyzed code").withColumns({"key": _t("runs>", step, ">", F.col("program")), "src": step, "kind": F.lit("runs"), "via": via}).select(*keep, "via").dropDuplicates(["key"])
    called = known_or_stub(steps.filter("program IS NULL"), "proc", procs, "proc", "procedure not in the analyzed code").withColumns({"key": _t("runs>", step), "src": step, "kind": F.lit("runs-proc")}).select(*keep)
    given = dds.filter("dataset IS NOT NULL")
    dataset = _t("dataset:", F.col("dataset"))
    data = _edges(given, _t("dd>", step, ">", F.col("dd")), step, dataset, "dd", F.col("dd").alias("ddname"), "disp")
    owners = steps.select("job", "step", "program").unionByName(runs.select("job", "step", "program")).filter("program IS NOT NULL").distinct()
    assigned = files.select("program", F.regexp_replace(F.upper("assigned"), r"^([A-Z]{2}-)*(S-)?", "").alias("dd"), F.col("id").alias("_file"))
    bound_ = given.join(owners, ["job", "step"]).join(assigned, ["program", "dd"])
    binds = _edges(bound_, _t("binds>", step, ">", F.col("dd")), F.col("_file"), dataset, "binds", step.alias("step"), F.col("dd").alias("ddname")).groupBy("key", "dst", "kind", "resolved", "reason", "step", "ddname").agg(F.min("src").alias("src"))
    return _all([contains, main, more, called, data, binds])


def definition_edges(definitions: DataFrame, programs: DataFrame) -> DataFrame:
    """Edges of resource definitions (kind, name, options map): a transaction starts its program, a file has its dataset."""
    starts = definitions.filter("kind = 'TRANSACTION'").select(_t("transaction:", F.col("name")).alias("src"), F.col("options")["PROGRAM"].alias("program"))
    first = known_or_stub(starts, "program", programs, "program", "program not in the analyzed code").select(_t("starts>", F.col("src")).alias("key"), "src", "dst", F.lit("starts").alias("kind"), "resolved", "reason")
    files = definitions.filter("kind = 'FILE'").select(_t("cics-file:", F.col("name")).alias("src"), F.col("options")["DSNAME"].alias("dataset")).filter("dataset IS NOT NULL")
    return _all([first, _edges(files, _t("dsname>", F.col("src")), F.col("src"), _t("dataset:", F.col("dataset")), "cics-dataset")])


def transaction_edges(commands: DataFrame, values: DataFrame, programs: DataFrame) -> DataFrame:
    """Edges of commands (key, program, src, command, options map): calls, cics-file, uses-screen and starts-transaction.

    An option is a literal (`program`, `file`, `mapset`, `map`, `transid`) or a field that holds one (`program_ref` and so on): then there is an edge
    for each of its values (program, field, value), `from_field` being set, and a stub where it has none.
    """
    c = F.col("command")
    o = lambda name: F.col("options")[name]
    has = lambda name: o(name).isNotNull() | o(f"{name}_ref").isNotNull()
    what = F.when(c.isin("LINK", "XCTL") & has("program"), "program").when(c.isin(*FILE_COMMANDS) & has("file"), "file").when(c.isin(*SCREEN_COMMANDS) & has("mapset"), "mapset").when(c.isin(*SCREEN_COMMANDS) & o("map").isNotNull(), "map").when(c.isin(*TRANSACTION_COMMANDS) & has("transid"), "transid")
    asked = commands.withColumn("what", what).filter("what IS NOT NULL").withColumns({"literal": F.col("options")[F.col("what")], "field": F.col("options")[F.concat("what", F.lit("_ref"))]})
    fixed = asked.filter("literal IS NOT NULL").withColumns({"value": F.col("literal"), "several": F.lit(1).cast("long"), "from_field": F.lit(None).cast("string")})
    held = asked.filter("literal IS NULL").join(values.select("program", "field", F.upper(F.trim("value")).alias("value")).distinct(), ["program", "field"], "left")
    counts = held.groupBy("key").agg(F.count("value").alias("several"))
    by_field = held.join(counts, "key").withColumn("from_field", F.col("field"))
    names = ["key", "program", "src", "command", "what", "field", "value", "several", "from_field"]
    every = fixed.select(*names).unionByName(by_field.select(*names))
    kind = F.when(F.col("what") == "program", "calls").when(F.col("what") == "file", "cics-file").when(F.col("what").isin("mapset", "map"), "uses-screen").otherwise("starts-transaction")
    node = F.when(F.col("what") == "file", "cics-file").when(F.col("what").isin("mapset", "map"), "mapset").otherwise("transaction")
    key = F.when(F.col("several") > 1, _t(F.col("key"), ">", F.col("value"))).otherwise(F.col("key"))
    named = every.withColumn("kind", kind).join(programs.select(F.col("name").alias("value"), F.lit(True).alias("_hit")).distinct(), "value", "left")
    is_call, none = F.col("kind") == "calls", F.col("value").isNull()
    resolved = ~none & (~is_call | F.coalesce("_hit", F.lit(False)))
    dst = F.when(none, _t("unresolved:dynamic:", F.col("field"))).when(is_call, F.concat(F.when(resolved, "program:").otherwise("unresolved:program:"), F.col("value"))).otherwise(F.concat(node, F.lit(":"), F.col("value")))
    reason = F.when(none, "dynamic target with no VALUE or MOVE of a literal").when(~resolved, "program not in the analyzed code")
    via = F.when(is_call, _t("cics-", F.lower("command")))
    return named.select(key.alias("key"), "src", dst.alias("dst"), "kind", resolved.alias("resolved"), reason.alias("reason"), via.alias("via"), F.when(~is_call, F.col("command")).alias("command"), "from_field")


def book_edges(copies: DataFrame, library: DataFrame) -> DataFrame:
    """Edges from programs to the books that they copy (key, program, name, problem): includes; library: (name). A book that is known but wasn't brought in keeps its problem."""
    made = known_or_stub(copies, "name", library, "copybook", "copybook not found")
    return made.select("key", _t("program:", F.col("program")).alias("src"), "dst", F.lit("includes").alias("kind"), "resolved", F.coalesce("reason", "problem").alias("reason"))

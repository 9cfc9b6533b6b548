"""Facts from source lines, folded with windows inside each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_lines(files: DataFrame, file: str, text: str) -> DataFrame:
    """(file, line, text): lines from 1."""
    return files.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), "text")


def fold(lines: DataFrame, begins: Column, join: str = " ") -> DataFrame:
    """(file, statement, first, last, text): lines up to the next one that begins a statement, joined. Lines before the first are left out."""
    order = W.partitionBy("file").orderBy("line")
    numbered = lines.withColumn("statement", F.sum(F.when(begins, 1).otherwise(0)).over(order)).filter("statement > 0")
    folded = numbered.groupBy("file", "statement").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("parts"))
    return folded.select("file", "statement", "first", "last", F.array_join(F.transform("parts", lambda p: p["text"]), join).alias("text"))


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the last non-null value at or above each line of its file."""
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy("file").orderBy("line")))


def jcl(lines: DataFrame) -> DataFrame:
    """(file, statement, first, name, kind, operands): job control statements with continuations folded and in-stream data left out.

    A DD * statement opens in-stream data, up to a line that begins with /* or //.
    """
    order = W.partitionBy("file").orderBy("line")
    text = F.col("text")
    code = text.startswith("//") & ~text.startswith("//*")
    opens = code & text.rlike(r"^//\S+\s+DD\s+\*")
    state = F.when(opens, 1).when(code | text.startswith("/*"), 0)
    open_before = F.coalesce(F.last(state, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = lines.filter(code | ~text.startswith("/")).withColumn("data", (open_before == 1) & ~code).filter("NOT data").filter(code)
    statements = fold(kept, text.rlike(r"^//\S"))
    flat = F.regexp_replace("text", r"\s*//\s+", "")
    return statements.select(
        "file", "statement", "first", F.regexp_extract("text", r"^//(\S+)", 1).alias("name"), F.regexp_extract("text", r"^//\S+\s+(JOB|EXEC|DD|PROC|PEND)\b", 1).alias("kind"),
        F.regexp_extract(flat, r"^//\S+\s+\w+\s+(\S+)", 1).alias("operands"))


def operand(operands: Column, key: str) -> Column:
    """The value of KEY= in an operand field, null where it is missing; parentheses are kept."""
    value = F.regexp_extract(operands, rf"(?:^|,){key}=(\([^)]*\)|[^,]*)", 1)
    return F.when(value != "", value)


def disposition(operands: Column) -> Column:
    """DISP's first part; missing means NEW."""
    return F.coalesce(F.regexp_extract(operand(operands, "DISP"), r"\(?([A-Z]+)", 1), F.lit("NEW"))


#: Programs that run what their input names.
TSO = ("IKJEFT01", "IKJEFT1A", "IKJEFT1B")


def tso_runs(lines: DataFrame) -> DataFrame:
    """(file, line, first, program) of RUN PROGRAM(NAME) in the input behind an EXEC of a TSO program, up to the next EXEC, JOB or PROC; `first` is that EXEC's line. Comment lines don't count."""
    opens = F.col("text").rlike(r"^//\S*\s+(EXEC|JOB|PROC)\b")
    placed = carried(lines, F.when(opens, F.struct(F.col("line").alias("first"), F.col("text").rlike(rf"^//\S*\s+EXEC\b.*\bPGM=(?:{'|'.join(TSO)})\b").alias("exec"))), "_step")
    named = F.upper(F.regexp_extract(F.substring("text", 1, 72), r"(?i)\bRUN\s+PROG(?:RAM)?\s*\(\s*([A-Z0-9@#$]+)\s*\)", 1))
    return placed.filter(~F.col("text").startswith("//*") & ~opens & F.col("_step.exec")).select("file", "line", F.col("_step.first").alias("first"), named.alias("program")).filter("program <> ''")


def region_program(program: Column, parm: Column) -> Column:
    """The program that a region controller's PARM names as its second field, null for other programs and regions."""
    fields = F.split(F.regexp_replace(F.upper(parm), r"[()']", ""), ",")
    return F.when((program == "DFSRRC00") & F.get(fields, F.lit(0)).isin("BMP", "DLI", "DBB"), F.get(fields, F.lit(1)))


def job_entities(statements: DataFrame) -> DataFrame:
    """(file, id, kind, name, program, dataset, disp) of jobs, steps and DD statements from jcl(), so that two versions can be compared by id."""
    job = F.col("kind").isin("JOB", "PROC")
    placed = carried(carried(statements.withColumn("line", F.col("first")), F.when(job, F.struct(F.lower("kind").alias("kind"), F.col("name").alias("name"))), "_job"), F.when(F.col("kind") == "EXEC", F.col("name")), "_step")
    step = F.concat_ws(".", "_job.name", "_step")
    id_ = F.when(job, F.concat_ws(":", "_job.kind", "_job.name")).when(F.col("kind") == "EXEC", F.concat(F.lit("jcl-step:"), step)).otherwise(F.concat(F.lit("jcl-dd:"), step, F.lit("."), F.col("name")))
    kind = F.when(job, F.concat(F.lit("jcl-"), F.lower("kind"))).when(F.col("kind") == "EXEC", "jcl-step").otherwise("jcl-dd")
    dataset = F.upper(F.regexp_replace(F.coalesce(operand(F.col("operands"), "DSN"), operand(F.col("operands"), "DSNAME")), r"\([^)]*\)$", ""))
    return placed.filter(job | F.col("kind").isin("EXEC", "DD")).select("file", id_.alias("id"), kind.alias("kind"), "name", F.upper(operand(F.col("operands"), "PGM")).alias("program"), dataset.alias("dataset"), F.when(F.col("kind") == "DD", operand(F.col("operands"), "DISP")).alias("disp"))


def without_separators(text: Column) -> Column:
    """Commas and semicolons before white space or the end become spaces, but in quoted strings."""
    parts = F.regexp_extract_all(text, F.lit(r"""('[^']*'|"[^"]*"|[^'"]+|['"])"""), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("""^['"]"""), p).otherwise(F.regexp_replace(p, r"[,;](?=\s|$)", " "))), "")


EXEC_BLOCK = r"(?is)\bEXEC\s+(SQL|CICS|DLI)\s+(.*?)\s*END-EXEC"


def exec_blocks(text: Column) -> dict[str, Column]:
    """blocks (kind and text with single spaces) of EXEC ... END-EXEC in a program's text, and the text with each block replaced: by CONTINUE behind PROCEDURE DIVISION, by nothing before it."""
    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    whole = F.regexp_extract_all(text, F.lit(EXEC_BLOCK), 0)
    blocks = F.transform(whole, lambda x: F.struct(F.upper(F.regexp_extract(x, EXEC_BLOCK, 1)).alias("kind"), clean(F.regexp_extract(x, EXEC_BLOCK, 2)).alias("text")))
    at = F.regexp_instr(text, F.lit(r"(?i)\bPROCEDURE\s+DIVISION\b"))
    head, tail = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")
    return {"blocks": blocks, "masked": F.concat(F.regexp_replace(head, EXEC_BLOCK, ""), F.regexp_replace(tail, EXEC_BLOCK, "CONTINUE"))}


def definitions(lines: DataFrame) -> DataFrame:
    """(file, statement, kind, name, options map) of DEFINE KIND(NAME) OPTION(VALUE)...; the first value of an option wins."""
    folded = fold(lines, F.col("text").rlike(r"^\s*DEFINE\s"))
    pairs = F.regexp_extract_all("text", F.lit(r"(\w+)\(([^)]*)\)"), 0)
    entry = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)", 1).alias("key"), F.regexp_extract(p, r"\(([^)]*)\)", 1).alias("value")))
    first = F.aggregate(F.slice(entry, F.lit(2), F.greatest(F.size(entry) - 1, F.lit(0))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))))
    return folded.select("file", "statement", entry[0]["key"].alias("kind"), entry[0]["value"].alias("name"), first.alias("options"))


def procedure_facts(lines: DataFrame) -> DataFrame:
    """(file, line, paragraph, kind, target, source) of PERFORM, GO TO, CALL and MOVE in fixed-format program lines; comments (column 7) are left out.

    Unparsed statements are no facts; the caller can count lines without facts as gaps.
    """
    code = lines.filter(~F.substring("text", 7, 1).isin("*", "/")).withColumn("code", F.trim(F.substring("text", 8, 65)))
    label = F.when(F.substring("text", 8, 1).rlike("[A-Z0-9]") & F.col("code").rlike(r"^[A-Z0-9-]+\.$"), F.regexp_replace("code", r"\.$", ""))
    placed = carried(code.withColumn("label", label), F.col("label"), "paragraph")
    kind = (F.when(F.col("label").isNotNull(), "paragraph").when(F.col("code").startswith("PERFORM "), "performs").when(F.col("code").startswith("GO TO "), "goes-to")
            .when(F.col("code").startswith("CALL "), "calls").when(F.col("code").startswith("MOVE "), "flows-to"))
    target = (F.when(F.col("label").isNotNull(), F.col("label")).when(F.col("code").startswith("CALL "), F.regexp_extract("code", r"^CALL\s+'?([A-Z0-9-]+)'?", 1))
              .when(F.col("code").startswith("MOVE "), F.regexp_extract("code", r"\sTO\s+([A-Z0-9-]+)", 1)).otherwise(F.regexp_extract("code", r"^(?:PERFORM|GO TO)\s+([A-Z0-9-]+)", 1)))
    source = F.when(F.col("code").startswith("MOVE "), F.regexp_extract("code", r"^MOVE\s+('[^']*'|[A-Z0-9-]+)", 1))
    return placed.select("file", "line", "paragraph", kind.alias("kind"), target.alias("target"), source.alias("source")).filter("kind IS NOT NULL")


def files(spark, path: str, pattern: str) -> DataFrame:
    """(file, text) of all files under a path whose names fit a glob, however deep."""
    return spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))

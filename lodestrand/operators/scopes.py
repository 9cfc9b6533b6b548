"""Names in nested scopes: types, supertypes in search order, fields, and calls whose receivers may be calls.

types: (fqn, outer, module, supers array of written names); imports: (module, simple, fqn);
wildcards: (module, at, package). A name is looked up as it stands, then as a type nested in the
scope or in one that encloses it, then through imports, the package and wildcards; the first
hit counts. Each way of looking up is an equi-join, and the ways' results are ranked. Loops
take one level of supertypes, or one link of chained calls, a round, and join only what the
round before has found. Nulls resolve to nothing; cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.operators.program import chains
from lodestrand.sources.scratch import Grown, cut


class Scopes:
    """The type names of a source tree, ready for look-ups; its tables are written once to the shared folder."""

    def __init__(self, types: DataFrame, imports: DataFrame, wildcards: DataFrame) -> None:
        self.types = cut(types.select("fqn", "outer", "module", "supers"), "types")
        self.names = self.types.select(F.col("fqn").alias("_name")).distinct()
        self.enclosing = cut(chains(self.types.select(F.col("fqn").alias("type"), F.col("outer").alias("super"))), "enclosing")  # (type, ancestor, distance)
        outermost = self.enclosing.groupBy("type").agg(F.max_by("ancestor", "distance").alias("top"))
        package = F.when(F.col("top").contains("."), F.regexp_replace("top", r"\.[^.]*$", "")).otherwise("")
        self.places = cut(self.types.join(outermost, F.col("fqn") == F.col("type")).select(F.col("fqn").alias("context"), "module", package.alias("package")), "places")
        self.imports, self.wildcards = imports, wildcards
        self.parents = cut(self._parents(), "parents")
        self.above = self._above()
        first = F.struct(F.lit(0).alias("level"), F.array().cast("array<int>").alias("path"))
        own = self.types.select(F.col("fqn").alias("type"), F.col("fqn").alias("owner"), first.alias("place"))
        #: (type, owner, place): a type and its supertypes, nearest first.
        self.chain = cut(own.unionByName(self.above.select("type", F.col("ancestor").alias("owner"), F.struct("level", "path").alias("place"))), "chain")
        out = self.enclosing.select(F.col("type").alias("_from"), F.col("ancestor").alias("type"), F.col("distance").alias("away")).join(self.chain, "type")
        #: (type, owner, place): whose members a bare name reaches: the type's chain, then those of enclosing types.
        self.visible = cut(out.groupBy(F.col("_from").alias("type"), "owner").agg(F.min(F.struct("away", "place.level", "place.path")).alias("place")), "visible")

    def resolve(self, refs: DataFrame) -> DataFrame:
        """(ref, type) of the names (ref, written, context) that mean a known type."""
        written = F.split(F.regexp_replace("written", r"\.\.\.$", ""), r"\[")[0]
        r = cut(refs.select("ref", written.alias("w"), "context").filter("w IS NOT NULL AND w <> ''").withColumns({"head": F.split("w", r"\.")[0], "rest": F.when(F.col("w").contains("."), F.regexp_replace("w", r"^[^.]*\.", "")).otherwise("")}), "references")
        rank = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"))
        ways = [r.select("ref", "rest", F.col("w").alias("name"), rank(0, F.lit(0)).alias("rank"), F.lit(True).alias("exact"))]
        scoped = r.join(self.enclosing.withColumnRenamed("type", "context"), "context")
        ways.append(scoped.select("ref", "rest", F.concat("ancestor", F.lit("."), "head").alias("name"), rank(1, F.col("distance")).alias("rank"), F.lit(False).alias("exact")))
        placed = r.join(self.places, "context")
        given = self.imports.select("module", F.col("simple").alias("head"), F.col("fqn").alias("name"))
        ways.append(placed.join(given, ["module", "head"]).select("ref", "rest", "name", rank(2, F.lit(0)).alias("rank"), F.lit(False).alias("exact")))
        in_package = F.when(F.col("package") == "", F.col("head")).otherwise(F.concat("package", F.lit("."), "head"))
        ways.append(placed.select("ref", "rest", in_package.alias("name"), rank(3, F.lit(0)).alias("rank"), F.lit(False).alias("exact")))
        wild = self.wildcards.select("module", "at", F.col("package").alias("_p"))
        ways.append(placed.join(wild, "module").select("ref", "rest", F.concat("_p", F.lit("."), "head").alias("name"), rank(4, F.col("at")).alias("rank"), F.lit(False).alias("exact")))
        every = ways[0]
        for way in ways[1:]:
            every = every.unionByName(way)
        hit = every.join(self.names, F.col("name") == F.col("_name"), "left_semi")
        best = hit.groupBy("ref").agg(F.min(F.struct("rank", "name", "rest", "exact")).alias("b")).select("ref", "b.name", "b.rest", "b.exact")
        deeper = F.when(~F.col("exact") & (F.col("rest") != ""), F.concat("name", F.lit("."), "rest"))
        return best.withColumn("_deeper", deeper).join(self.names, F.col("_deeper") == F.col("_name"), "left").select("ref", F.coalesce("_name", "name").alias("type"))

    def _parents(self) -> DataFrame:
        written = self.types.select("fqn", F.posexplode("supers").alias("at", "written"))
        found = self.resolve(written.select(F.struct("fqn", "at").alias("ref"), "written", F.col("fqn").alias("context")))
        return found.select("ref.fqn", "ref.at", F.col("type").alias("parent"))

    def _above(self) -> DataFrame:
        """(type, ancestor, level, path): supertypes in the order in which a search by levels meets them, each at its first place."""
        start = self.parents.filter("parent <> fqn").groupBy(F.col("fqn").alias("type"), F.col("parent").alias("ancestor")).agg(F.lit(1).alias("level"), F.array(F.min("at")).alias("path"))
        found = Grown(start.sparkSession, start.schema, "above")
        last, level = found.add(start), 1
        while not last.isEmpty():
            level += 1
            up = last.join(self.parents.select(F.col("fqn").alias("ancestor"), F.col("parent").alias("_next"), "at"), "ancestor").filter("_next <> type")
            step = up.groupBy("type", F.col("_next").alias("ancestor")).agg(F.lit(level).alias("level"), F.min(F.concat("path", F.array("at"))).alias("path"))
            last = found.add(step.join(found.read().select("type", "ancestor"), ["type", "ancestor"], "left_anti"))
        return found.read()

    def fields(self, uses: DataFrame, fields: DataFrame) -> DataFrame:
        """(use, field) of uses (use, caller, name, receiver): the first field (owner, name, field) along the chain that the receiver gives."""
        bare = F.col("receiver").isNull() | (F.col("receiver") == "this")
        named = self.resolve(uses.filter(~bare).select(F.col("use").alias("ref"), F.col("receiver").alias("written"), F.col("caller").alias("context")))
        far = uses.join(named.withColumnRenamed("ref", "use"), "use").join(self.chain, "type").select("use", "name", "owner", F.struct(F.lit(0).alias("away"), "place.level", "place.path").alias("place"))
        near = uses.filter(bare).join(self.visible.withColumnRenamed("type", "caller"), "caller").select("use", "name", "owner", "place")
        hits = near.unionByName(far).join(fields, ["owner", "name"])
        return hits.groupBy("use").agg(F.min(F.struct("place", "field")).alias("b")).select("use", "b.field")

    def calls(self, calls: DataFrame, methods: DataFrame) -> DataFrame:
        """(call, target, tag, reason): what calls (call, caller, name, receiver, receiver_type, receiver_call, args) land on.

        methods: (id, owner, at, name, arity, varargs, returns). The first type along a call's chain that has a method of the name and number of
        arguments (any, where args is null) gives all its overloads, tagged `arity` if there are several. A constructor without
        one of its own lands on the type. A call of a method of the tree whose receiver isn't known is a stub with its reason; other calls of unknown receivers have no row.
        """
        methods = cut(methods.select("id", "owner", "at", "name", "arity", "varargs", "returns"), "methods")
        returned = cut(self.resolve(methods.select(F.col("id").alias("ref"), F.col("returns").alias("written"), F.col("owner").alias("context"))).select(F.col("ref").alias("id"), F.col("type").alias("result")), "returned")
        calls = cut(calls, "calls")
        typed = self.resolve(calls.filter("receiver_call IS NULL AND receiver_type IS NOT NULL").select(F.col("call").alias("ref"), F.col("receiver_type").alias("written"), F.col("caller").alias("context")))
        made = F.col("name") == "<init>"
        bare = ~made & (F.col("receiver").isNull() | (F.col("receiver") == "this"))
        on_super = F.coalesce(F.col("receiver") == "super", F.lit(False))
        first = calls.filter("receiver_call IS NULL")
        wide = lambda place: F.struct(F.lit(0).alias("away"), F.col(f"{place}.level").alias("level"), F.col(f"{place}.path").alias("path"))
        own = F.struct(F.lit(0).alias("away"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("path"))
        above = self.above.select(F.col("type").alias("caller"), F.col("ancestor").alias("owner"), F.struct(F.lit(0).alias("away"), "level", "path").alias("place"))
        nearest = above.groupBy("caller").agg(F.min(F.struct("place", "owner")).alias("b")).select("caller", "b.owner", "b.place")
        named = first.filter(~bare & ~on_super & ~(made & F.coalesce(F.col("receiver") == "this", F.lit(False)))).join(typed.withColumnRenamed("ref", "call"), "call")
        rows = [
            first.filter(bare).join(self.visible.withColumnRenamed("type", "caller"), "caller").select("call", "owner", "place"),
            first.filter(~made & on_super).join(above, "caller").select("call", "owner", "place"),
            first.filter(made & on_super).join(nearest, "caller").select("call", "owner", "place"),
            first.filter(made & (F.col("receiver") == "this")).select("call", F.col("caller").alias("owner"), own.alias("place")),
            named.filter(made).select("call", F.col("type").alias("owner"), own.alias("place")),
            named.filter(~made).join(self.chain, "type").select("call", "owner", wide("place").alias("place")),
        ]
        spread = rows[0]
        for more in rows[1:]:
            spread = spread.unionByName(more)
        known = first.filter(bare | on_super | (made & (F.col("receiver") == "this"))).select("call").unionByName(named.select("call")).distinct()
        landed = Grown(calls.sparkSession, calls.select("call", F.lit("").alias("target"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("several")).schema, "landed")
        settled = Grown(calls.sparkSession, calls.select("call", F.lit("").alias("result")).schema, "settled")
        while True:
            spread = cut(spread, "spread")
            hits = calls.select("call", "name", "args").join(spread, "call").join(methods.select("id", "owner", "at", "name", "arity", "varargs"), ["owner", "name"])
            fits = hits.filter(accepts(F.col("arity"), F.col("varargs"), F.col("args")))
            best = fits.withColumn("_k", F.rank().over(W.partitionBy("call").orderBy("place", "owner"))).filter("_k = 1")
            ordered = best.withColumns({"rank": F.row_number().over(W.partitionBy("call").orderBy("at", "id")).cast("long"), "several": F.count(F.lit(1)).over(W.partitionBy("call"))})
            targets = landed.add(ordered.select("call", F.col("id").alias("target"), "rank", "several"))
            begin = spread.groupBy("call").agg(F.min(F.struct("place", "owner")).alias("b")).select("call", F.col("b.owner").alias("_first"))
            types = known.join(calls.select("call", "name"), "call").join(begin, "call", "left").join(targets.filter("rank = 1").select("call", F.col("target").alias("id")), "call", "left").join(returned, "id", "left")
            new = settled.add(types.select("call", F.when(made, F.col("_first")).otherwise(F.col("result")).alias("result")))
            ends = calls.filter("receiver_call IS NOT NULL").join(new.filter("result IS NOT NULL").select(F.col("call").alias("receiver_call"), F.col("result").alias("type")), "receiver_call")
            spread = ends.join(self.chain, "type").select("call", "owner", wide("place").alias("place"))
            known = cut(ends.select("call"), "known")
            if known.isEmpty():
                break
        done = settled.read()
        hits = landed.read().select("call", "target", F.when(F.col("several") > 1, "arity").alias("tag"), F.lit(None).cast("string").alias("reason"))
        without = done.join(landed.read().select("call"), "call", "left_anti").join(calls.filter(made).select("call"), "call").filter("result IS NOT NULL")
        built = without.select("call", F.concat(F.lit("class:"), "result").alias("target"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("reason"))
        lost = calls.filter(~made).join(done.select("call"), "call", "left_anti").join(methods.select("name").distinct(), "name")
        stubs = lost.select("call", F.concat(F.lit("unresolved:method:"), "name").alias("target"), F.lit(None).cast("string").alias("tag"), F.lit("receiver type not known").alias("reason"))
        return hits.unionByName(built).unionByName(stubs)


def accepts(arity: Column, varargs: Column, args: Column) -> Column:
    """Whether a method takes so many arguments; a last variable one takes none or more, and null (a method reference) fits all."""
    return args.isNull() | (varargs & (args >= arity - 1)) | (~varargs & (args == arity))

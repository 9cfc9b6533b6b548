"""Exact dedup by a tree-merge of digest runs.

Every leaf partition holds a run of (digest, best row so far, count). Runs travel in
binomial rounds: in round k each partition deals its run to itself and to the one partner
whose number differs in bit k only, by bit k of the digests' home partition. What a
partition then has from both is sorted by digest, and equal neighbours are merged into one,
with the best row and the sum of counts. After log2(partitions) rounds each digest is in
its home partition alone. A group of copies, however large, halves its places each round and
is merged on the way, so no partition ever gets more of it than two partners have left.
Only digests travel, never texts, and the partition of each row is set directly, so that a
round is one exchange and Spark adds none for the merge.

Kept rows are verified at every level: entries merge by SHA-256, length and a second 64-bit
hash of the normalised text together, so rows that differ in any of them never meet.

Null texts count as empty; all empty texts are copies of each other. Among equally long
originals the smallest id stays, null ids last. Repeated rows are copies like others. An
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import documents, id_and_text, id_key, one_each, stored

#: The characters that normalisation deletes: x20 and x09 to x0D.
SPACES = " \t\n\u000b\u000c\r"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the normalised text), chars (code points of the original), size and second hash of the normalised text."""
    text = F.coalesce("text", F.lit(""))
    kept = F.translate(text, SPACES, "")
    return id_and_text(df, id_col, text_col).select(
        "id", F.char_length(text).alias("chars"), kept.alias("kept")
    ).select("id", "chars", F.unhex(F.sha2("kept", 256)).alias("digest"), F.octet_length("kept").alias("size"), F.xxhash64("kept").alias("second"))


def merged(leaves: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each digest: best (struct; its `id` stays) and count. partitions: of the exchange (raised to a power of two), as many as leaves unless given."""
    rounds = max(0, (partitions or leaves.rdd.getNumPartitions()) - 1).bit_length()
    key = ["digest", "size", "second"]
    best = F.struct((-F.col("chars")).alias("shorter"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    place, home = F.pmod(F.spark_partition_id(), F.lit(1 << rounds)), F.pmod(F.col("second"), F.lit(1 << rounds)).cast("int")
    runs = leaves.select(*key, best.alias("best"), F.lit(1).cast("long").alias("count"), place.cast("int").alias("place"))
    for bit in (1 << k for k in range(rounds)):
        partner = F.col("place").bitwiseAND(~bit).bitwiseOR(home.bitwiseAND(bit))
        met = runs.withColumn("place", partner).repartitionById(1 << rounds, "place")
        runs = met.sortWithinPartitions("place", *key).groupBy("place", *key).agg(F.min("best").alias("best"), F.sum("count").alias("count"))
    if not rounds:
        runs = runs.coalesce(1).groupBy("place", *key).agg(F.min("best").alias("best"), F.sum("count").alias("count"))
    return runs.drop("place")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `df`: id, keep_id, group_size, kept, digest (hex). Of rows that repeat the kept id, all equal ones are kept."""
    leaves = stored(digests(df, id_col, text_col), "digests")
    groups = merged(leaves)
    key = ["digest", "size", "second"]
    best = groups.select(*key, F.col("best.id").alias("keep_id"), F.col("best.shorter").alias("shorter"), "count")
    return leaves.join(best, key).select(
        "id", "keep_id", F.col("count").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == -F.col("shorter"))).alias("kept"), F.lower(F.hex("digest")).alias("digest"),
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay (one of each group), with all their columns; of rows that repeat the kept id, one."""
    kept = exact_groups(df, id_col, text_col).filter("kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = lambda c: {"_kept_digest": c}
    key = id_key(F.col("id")) | digest(F.col("digest"))
    own = id_key(F.col(id_col)) | digest(F.sha2(F.translate(text, SPACES, ""), 256))
    return one_each(df, own, kept.select(*[c.alias(k) for k, c in key.items()]), [], [F.char_length(text).desc(), F.col(text_col)])


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of exact_groups over all documents."""
    return exact_groups(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

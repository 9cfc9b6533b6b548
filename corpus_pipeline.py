"""A corpus pipeline of five operators: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is
written as Parquet before the next begins. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import exact_dedup, language, near_dedup, packing, secrets
from lodestrand.llm.common import documents, stored

#: A document is in none of the learned languages if fewer of its 4-grams than this are known to the best one.
LEAST_KNOWN = 0.3
#: A document of so many 4-grams is in several languages if the best one's lead over the next is less than this share of what it is in texts of one language alone.
#: Shorter documents can't be told, nor can languages that are nearly the same (where that lead is small).
MIXED_FROM, LEAST_LEAD, LEAST_APART = 100, 0.3, 0.15


def _in_one_language(found: dict[str, np.ndarray]) -> np.ndarray:
    mixed = (found["grams"] >= MIXED_FROM) & (found["lead"] < LEAST_LEAD * found["apart"]) & (found["apart"] >= LEAST_APART)
    return (found["lang_pred"] != "und") & (found["known"] >= LEAST_KNOWN) & ~mixed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, those in none of the learned languages and those in several; where nothing can be learned, nothing is dropped."""
    model = language.trained_on(docs)
    return language.in_language(docs, model, _in_one_language) if model.languages else docs


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, keeps the longest original, then the smallest id."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dedup.keep_representatives(docs, words=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document goes."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of 2048 tokens."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

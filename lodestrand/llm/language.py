"""Language identification by language-bitmask n-gram filters.

Training counts the byte 4-grams of a bounded sample of labelled texts in Spark and keeps
each language's most frequent ones, the same number for every language. They go into one
Bloom filter whose slots are bit-sliced: slot j holds a mask with a bit for each language,
so ANDing the slots of an n-gram gives all languages that contain it at once. For a text,
the bits are counted by language over its n-grams; from each count goes what a language's
filter would answer falsely, and the largest share of n-grams decides.

Defined results: `und` with score 0 where the text is null or has no letter; otherwise a
learned language always. Ties go to the language that sorts first. Rows with null language
or null text teach nothing. Repeated rows are answered one by one; other columns are left
out; an empty table gives an empty result. With nothing learned at all, all rows are `und`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_map, documents, id_and_text, parts, utf8

#: Bounds of training: labelled rows of each language that are read, and n-grams kept of each.
SAMPLE, GRAMS = 1500, 12_000
SLOTS_LOG2, HASHES = 19, 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def grams(text: np.ndarray) -> np.ndarray:
    """The 4-gram that begins at each byte, case of A-Z and kind of white space put aside, as 32-bit integers."""
    b = _LOWER[text].astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.uint32)
    return b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's 4-grams, each text between spaces, and the range of each text's own."""
    body, at = utf8(column)
    n = len(at) - 1
    spaced = np.insert(np.insert(body, at[1:], 32), np.concatenate((at[:-1] + np.arange(n),)).clip(0), 32) if n else body
    begin = at[:-1] + 2 * np.arange(n)
    end = begin + np.diff(at) + 2 - 3  # no 4-gram reaches into the next text
    return grams(spaced), begin, np.maximum(end, begin)


@dataclass(frozen=True)
class Model:
    """languages; masks by slot (one array for each 8 languages); the share of n-grams that each filter answers falsely."""

    languages: tuple[str, ...]
    masks: tuple[np.ndarray, ...]
    false: np.ndarray
    apart: np.ndarray  # [a, b]: the share of a's n-grams, as often as they occur, that b hasn't


def _slots(keys: np.ndarray) -> list[np.ndarray]:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    keep, width = np.uint64((1 << SLOTS_LOG2) - 1), np.uint64(SLOTS_LOG2)
    return [((x >> (width * np.uint64(k))) & keep).astype(np.int32) for k in range(HASHES)]


def build(sets: dict[str, np.ndarray], counts: dict[str, np.ndarray] | None = None) -> Model:
    """The bit-sliced filter of {language: its n-grams}; counts: how often each n-gram of a language occurs (once unless given)."""
    languages = tuple(sorted(sets))
    masks = [np.zeros(1 << SLOTS_LOG2, np.uint8) for _ in range(0, len(languages), 8)]
    for k, language in enumerate(languages):
        for slots in _slots(sets[language]):
            masks[k // 8][slots] |= np.uint8(1 << k % 8)
    fill = [np.mean(masks[k // 8] >> (k % 8) & 1) for k in range(len(languages))]
    apart = np.zeros((len(languages), len(languages)))
    for i, a in enumerate(languages):
        n = counts[a] if counts else np.ones(len(sets[a]))
        for j, b in enumerate(languages):
            apart[i, j] = n[~np.isin(sets[a], sets[b])].sum() / max(n.sum(), 1)
    return Model(languages, tuple(masks), np.array(fill, float) ** HASHES, apart)


def learn(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: int = GRAMS) -> Model:
    """Learns from labelled rows: about `sample` rows of each language (chosen by a hash of the id), `keep` n-grams of each."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return build({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("id", "text", "lang")

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        langs, ranges = np.array(batch.column(2).to_pylist(), object), _joined(batch.column(1))
        g, begin, end = ranges
        out = {"lang": [], "gram": [], "n": []}
        for lang in sorted(set(langs)):
            own = [g[begin[i] : end[i]] for i in np.flatnonzero(langs == lang)]
            keys, n = np.unique(np.concatenate(own), return_counts=True)
            out["lang"] += [lang] * len(keys)
            out["gram"].append(keys.astype(np.int64))
            out["n"].append(n)
        return {"lang": out["lang"], "gram": pa.array(np.concatenate(out["gram"])), "n": pa.array(np.concatenate(out["n"]))}

    counted = arrow_map(chosen, each, "lang string, gram long, n long", mb=1).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= keep)
    sets: dict[str, list[tuple[int, int]]] = {lang: [] for lang in counts}
    for r in top.select("lang", "gram", "n").collect():  # `keep` rows a language at most
        sets[r["lang"]].append((r["gram"], r["n"]))
    return build({lang: np.array([g for g, _ in x], np.uint32) for lang, x in sets.items()}, {lang: np.array([n for _, n in x], np.int64) for lang, x in sets.items()})


def judged(column: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """lang_pred, score (the share of the winner among all corrected counts), known (the share of n-grams that the winner knows), lead (the winner's corrected count less the runner-up's, as a share of the winner's), apart (what that lead is in texts of one of the two languages alone, the smaller of both) and grams (how many n-grams there are) of each text."""
    import regex

    names, letter = model.languages, regex.compile(r"\p{L}")
    g, begin, end = _joined(column)
    n = len(column)
    slots = _slots(g)
    hits = np.zeros((len(names), n))
    for plane, table in enumerate(model.masks):
        mask = table[slots[0]]
        for s in slots[1:]:
            mask &= table[s]
        for k in range(min(8, len(names) - 8 * plane)):
            total = np.concatenate(([0], np.cumsum(mask >> k & 1, dtype=np.int64)))
            hits[8 * plane + k] = total[end] - total[begin]
    many = np.maximum(end - begin, 1)
    best, whole, top, second, apart = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    if len(names):
        right = np.maximum((hits - many * model.false[:, None]) / (1 - model.false[:, None]), 0)
        best, whole, top = right.argmax(0), right.sum(0), right.max(0)
        if len(names) > 1:
            order = np.argsort(right, 0, kind="stable")
            second, apart = right[order[-2], np.arange(n)], np.minimum(model.apart, model.apart.T)[order[-1], order[-2]]
    some = np.array([t is not None and letter.search(t) is not None for t in column.to_pylist()], bool) & bool(names)
    return {
        "lang_pred": np.array([names[b] if s else "und" for b, s in zip(best, some, strict=True)], object), "score": np.where(some & (whole > 0), top / np.maximum(whole, 1e-9), 0.0),
        "known": np.where(some, np.minimum(top / many, 1.0), 0.0), "lead": np.where(some, (top - second) / np.maximum(top, 1e-9), 0.0), "apart": apart, "grams": end - begin,
    }


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and those of judged(), one row for each row of `df`."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        return {"id": batch.column(0), **{k: pa.array(v) for k, v in judged(batch.column(1), model).items()}}

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, lang_pred string, score double, known double, lead double, apart double, grams long", mb=1)


def in_language(df: DataFrame, model: Model, keep: Callable[[dict[str, np.ndarray]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all their columns, that `keep` says yes to, given what judged() has of their texts. Nothing is shuffled, and each row is judged for itself."""
    place, names = df.columns.index(text_col), df.columns

    def run(batches):
        for whole in batches:
            named = whole.rename_columns([("text" if i == place else f"c{i}") for i in range(len(names))])
            for part in parts(named, 1 << 20):
                mask = pa.array(keep(judged(part.column(place), model)))
                yield pa.RecordBatch.from_arrays(part.columns, schema=whole.schema).filter(mask)

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_on(df: DataFrame, id_col: str = "doc_id") -> Model:
    return learn(df.filter(~held_out(id_col)), id_col=id_col)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: predictions for all documents by a model of the rows that are not held out."""
    docs = documents(spark, sf_dir)
    found = identify(docs, trained_on(docs))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "known")

"""Substring dedup by compressed FM-indexes, one a shard.

A window is `size` consecutive words. Each window elects the one of its GRAM-word runs with
the least hash; windows that repeat elect the same run, whatever document they are in.
Neighbouring windows with one elected run form a stretch. A run that occurs in one document
only (or only in documents with the same words) holds nothing that repeats, and goes no
further; that decision shuffles hashes only. The stretches of the other runs are streamed
to shards, all of one run to one shard. A shard builds an FM-index of its stretches and
streams each of them through it: backward search in a wavelet matrix gives matching
statistics, that is, how far the words before each place go on like those of a document
with a smaller id (the least owner in the suffix interval tells whether there is one).
Where a statistic reaches `size`, the window that ends there is repeated. Runs in more than
HOT documents are dealt out window by window instead, and of each of their windows one
copy only, with the smallest id that has it, so that no shard grows with one of them.

Of documents with the same words (by SHA-256), all but the smallest id lose all words (if
they have a window at all), and only the smallest id's stretches are looked at.

Null and empty texts have no words. Documents with fewer than `size` words lose none.
Repeated rows with one id are the same document, and none of them repeats the other (with
one id and several texts, each text is judged for itself, against smaller ids); rows with a
null id are neither compared nor cut. An empty table gives an empty result; other columns
are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_map, documents, id_and_text, stored, utf8
from lodestrand.llm.fm_index import FmIndex

GRAM = 4
#: Windows of a stretch at most; documents from which a run is dealt out by windows; words of a shard (about); buckets of a group of documents with the same words.
RUN, HOT, SHARD, SALTS = 32, 4000, 100_000, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(column: pa.Array) -> list[list[bytes]]:
    body, at = utf8(column)
    raw = body.tobytes()
    return [raw[a:b].split() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]  # of bytes: ASCII white space parts words


def _mark(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def elected(words: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of all texts: (text, elected run's hash, first window, last window)."""
    n = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    total = len(flat)
    empty = np.zeros(0, np.int64)
    if total < size:
        return empty, empty, empty, empty
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, total)
    m = total - GRAM + 1
    mixed = np.zeros(m, np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + h[k : k + m]
    low, width = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), 1
    span = size - GRAM + 1  # runs of a window
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    begin = np.cumsum(n) - n
    text = np.repeat(np.arange(len(words)), n)[: len(low)]
    inside = np.arange(len(low)) + size <= (begin + n)[text]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, empty
    low, text, window = low[at].view(np.int64), text[at], at - begin[text[at]]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    since = np.arange(len(low)) - np.repeat(first, np.diff(np.concatenate((first, [len(low)]))))
    first = np.flatnonzero(since % RUN == 0)
    last = np.concatenate((first[1:], [len(low)])) - 1
    return text[first], low[first], window[first], window[last]


def summaries(raw: DataFrame, size: int) -> DataFrame:
    """id, n (words), sha (SHA-256 of the words joined by a space), mark (its first 8 bytes) and the distinct elected runs of each row."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        words = _words(batch.column(1))
        text, key, _, _ = elected(words, size)
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
        text, key = text[new], key[new]
        at = np.searchsorted(text, np.arange(len(words) + 1)).astype(np.int32)
        sha = [hashlib.sha256(b" ".join(w)).digest() for w in words]
        return {"id": batch.column(0), "n": [len(w) for w in words], "sha": sha, "mark": [_mark(x) for x in sha], "runs": pa.ListArray.from_arrays(pa.array(at), pa.array(key))}

    return arrow_map(raw, each, "id long, n long, sha binary, mark long, runs array<long>")


def stretches(texts: DataFrame, size: int) -> DataFrame:
    """The stretches of (id, text, mark, runs, hot) whose run is in `runs`, equal ones of a row in one row: id, mark, firsts (where they begin), deal (what tells the shard), digest (of windows of hot runs) and part (the words)."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"id": [], "mark": [], "firsts": [], "deal": [], "digest": [], "part": []}
        words = _words(batch.column(1))
        text, key, first, last = elected(words, size)
        at = np.searchsorted(text, np.arange(len(words) + 1)).tolist()
        key, first, last = key.tolist(), first.tolist(), last.tolist()
        for i, w, mark, runs, hots, lo, hi in zip(batch.column(0).to_pylist(), words, *(batch.column(k).to_pylist() for k in (2, 3, 4)), at, at[1:], strict=False):
            if mark != _mark(hashlib.sha256(b" ".join(w)).digest()):
                continue  # another text with the same id
            runs, hots = set(runs), set(hots)
            seen: dict[bytes, list[int]] = {}
            for p in range(lo, hi):
                k = key[p]
                if k not in runs:
                    continue
                hot = k in hots
                for a, b in [(x, x) for x in range(first[p], last[p] + 1)] if hot else [(first[p], last[p])]:
                    part = b" ".join(w[a : b + size])
                    if part in seen:
                        seen[part].append(a)
                        continue
                    seen[part] = [a]
                    digest = hashlib.blake2b(part, digest_size=16).digest() if hot else None
                    out["id"].append(i)
                    out["mark"].append(mark)
                    out["firsts"].append(seen[part])
                    out["deal"].append(_mark(digest) if hot else k)
                    out["digest"].append(digest)
                    out["part"].append(part)
        return out

    return arrow_map(texts, each, "id long, mark long, firsts array<int>, deal long, digest binary, part binary", mb=1)


def _expand(begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): begin[k], begin[k] + 1, ... (many[k] of them) for each k."""
    which = np.repeat(np.arange(len(many)), many)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + begin[which]


def search(table: pa.Table, size: int) -> pa.Table:
    """One shard: where the windows of its rows repeat those of a smaller id (id, mark, starts), and for windows of hot runs the smallest id (digest, least)."""
    parts = table.column("part").combine_chunks().cast(pa.binary()).to_pylist()
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(p, len(numbers)) for p in parts])
    ids, rank = np.unique(table.column("id").to_numpy(), return_inverse=True)
    rank = rank.astype(np.int32)
    owner, latest = np.full(len(numbers), len(ids), np.int32), np.full(len(numbers), -1, np.int32)
    np.minimum.at(owner, which, rank)
    np.maximum.at(latest, which, rank)
    split = [p.split(b" ") for p in numbers]
    names = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    n = np.array([len(w) for w in split])
    begin = np.cumsum(n + 1) - n - 1
    text = np.zeros(int((n + 1).sum()), np.int32)
    for a, words in zip(begin.tolist(), split, strict=True):
        text[a : a + len(words)] = [names[w] for w in words]
    index = FmIndex(text, len(names) + 1, int(n.max()) + 1, np.repeat(owner, n + 1))
    windows = n - size + 1
    of, end = _expand(begin + size, windows)
    # a statistic is against documents before the latest that has the stretch; each of its rows is then held to its own id
    length, least = index.statistics(text, begin[of], end, latest[of], size)
    least = np.where(length >= size, least, len(ids))
    first_window = np.cumsum(windows) - windows
    plain = np.flatnonzero(table.column("digest").is_null().to_numpy(zero_copy_only=False))
    firsts = table.column("firsts").combine_chunks().take(pa.array(plain))
    row = np.repeat(plain, np.diff(firsts.offsets.to_numpy()))
    place = np.asarray(firsts.values)[firsts.offsets[0].as_py() : firsts.offsets[-1].as_py()]
    source, window = _expand(first_window[which[row]], windows[which[row]])
    repeated = least[window] < rank[row[source]]
    source, window = source[repeated], window[repeated]
    start = place[source] + window - first_window[which[row[source]]]
    rows, many = np.unique(row[source], return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pa.array(start.astype(np.int32)))
    hot = np.setdiff1d(np.arange(len(parts)), plain)
    given = table.select(["id", "mark", "digest"]).combine_chunks()
    mine = given.take(pa.array(rows))
    theirs = given.take(pa.array(hot))
    none = lambda kind, many: pa.nulls(many, kind)
    return pa.table({
        "id": pa.concat_arrays([mine.column("id").combine_chunks(), none(pa.int64(), len(hot))]),
        "mark": pa.concat_arrays([mine.column("mark").combine_chunks(), none(pa.int64(), len(hot))]),
        "starts": pa.concat_arrays([lists, none(lists.type, len(hot))]),
        "digest": pa.concat_arrays([none(pa.binary(), len(rows)), theirs.column("digest").combine_chunks().cast(pa.binary())]),
        "least": pa.concat_arrays([none(pa.int64(), len(rows)), pa.array(ids[np.minimum(least[first_window[which[hot]]], rank[hot])])]),
    })


def repeated_windows(raw: DataFrame, all_: DataFrame, same: DataFrame, size: int = 13) -> DataFrame:
    """id, mark and starts (of the repeated windows) of the documents that have some. raw: id and text; all_: their stored summaries; same: the stored groups of documents with the same words."""
    text = F.col("mark")
    keyed = all_.filter("id IS NOT NULL").select(text.alias("of"), F.explode("runs").alias("run"))
    if not same.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # then only the SHA-256 tells those apart
        text = F.col("sha")
        keyed = all_.filter("id IS NOT NULL").select(text.alias("of"), F.explode("runs").alias("run"))
    shared = keyed.groupBy("run").agg(F.min("of").alias("a"), F.max("of").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select("run", (F.col("n") > HOT).alias("hot"))
    found = keyed.join(shared, "run").groupBy("of").agg(F.collect_set("run").alias("runs"), F.collect_set(F.when(F.col("hot"), F.col("run"))).alias("hot"))
    found = found.join(same.select(text.alias("of"), F.col("first").alias("id"), "mark"), "of").drop("of")
    rows = stored(stretches(raw.join(found, "id").select("id", "text", "mark", "runs", "hot"), size), "stretches")
    shards = max(1, rows.count() * (size + RUN // 8) // SHARD)
    plain, hot = rows.filter("digest IS NULL"), rows.filter("digest IS NOT NULL")
    once = hot.groupBy("digest").agg(F.min(F.struct("id", "mark", "firsts", "deal", "part")).alias("row")).select("row.*", "digest")
    shard = F.pmod(F.xxhash64("deal"), F.lit(shards)).alias("shard")
    columns = [shard, "id", "mark", "firsts", "digest", "part"]
    sharded = plain.select(*columns).unionByName(once.select(*columns))
    answers = stored(sharded.groupBy("shard").applyInArrow(lambda t: search(t, size), "id long, mark long, starts array<int>, digest binary, least long"), "answers")
    least = answers.filter("digest IS NOT NULL").select("digest", "least")
    of_hot = hot.select("id", "mark", "firsts", "digest").join(least, "digest").filter("least < id").select("id", "mark", F.col("firsts").alias("starts"))
    starts = answers.filter("digest IS NULL").select("id", "mark", "starts").unionByName(of_hot)
    return starts.groupBy("id", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the kept words joined by a space) and kept (the joined words; null where nothing was removed), one row for each row of `df`."""
    raw = id_and_text(df, id_col, text_col)
    all_ = stored(summaries(raw, size), "summaries")
    groups = all_.filter(F.col("id").isNotNull() & (F.col("n") >= size)).groupBy("sha")
    same = stored(groups.agg(F.min("mark").alias("mark"), F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "same")
    starts = repeated_windows(raw, all_, same, size)

    def remove(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"id": [], "mark": [], "n_removed": [], "kept": [], "kept_sha": []}
        for i, words, mark, own in zip(batch.column(0).to_pylist(), _words(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if mark != _mark(hashlib.sha256(b" ".join(words)).digest()):
                continue
            change = np.zeros(len(words) + 1, np.int64)
            a = np.unique(np.array(own, np.int64))
            change[a] += 1
            change[a + size] -= 1
            gone = np.cumsum(change)[:-1] > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            out["id"].append(i)
            out["mark"].append(mark)
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(kept.decode())
            out["kept_sha"].append(hashlib.sha256(kept).digest())
        return out

    cut = arrow_map(raw.join(starts, "id").select("id", "text", "mark", "starts"), remove, "id long, mark long, n_removed long, kept string, kept_sha binary")
    cut = cut.groupBy("id", "mark").agg(*[F.min(c).alias(c) for c in ("n_removed", "kept", "kept_sha")])  # of repeated rows, one
    first = same.filter("copies > 1").select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = all_.select("id", "n", "sha", "mark", F.coalesce(F.pmod(F.xxhash64("id"), F.lit(SALTS)), F.lit(0)).cast("int").alias("salt"))
    out = salted.join(first, ["sha", "salt"], "left").join(cut, ["id", "mark"], "left")
    whole = (F.col("id") > F.col("first")) & (F.col("n") >= size)
    return out.select(
        "id", F.col("n").alias("n_words"), F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"), F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of without_repeats over all documents."""
    return without_repeats(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")

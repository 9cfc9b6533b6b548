"""Exact, near and substring dedup against brute force."""

import collections
import hashlib
import random
import re

from lodestrand.llm import exact_dedup, fm_index, near_dedup, substring_dedup


def test_exact_groups(docs, empty, texts):
    norm = {k: re.sub(r"[\x20\x09-\x0D]", "", t or "") for k, t in texts}
    groups = collections.defaultdict(list)
    for k, t in texts:
        groups[norm[k]].append((-len(t or ""), k))
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        own = groups[norm[r["id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"], r["digest"]) == (min(own)[1], len(own), r["id"] == min(own)[1], hashlib.sha256(norm[r["id"]].encode()).hexdigest())
    assert exact_dedup.exact_groups(empty).count() == 0


def test_tree_merge_gives_one_row_a_digest_for_any_number_of_partitions(docs):
    leaves = exact_dedup.digests(docs)
    want = {(bytes(r["digest"]), r["n"]) for r in leaves.groupBy("digest").count().withColumnRenamed("count", "n").collect()}
    for partitions in (1, 2, 3, 8):
        got = exact_dedup.merged(leaves, partitions).collect()
        assert {(bytes(r["digest"]), r["count"]) for r in got} == want and len(got) == len(want)


def test_a_round_is_one_exchange_with_partners_only(spark):
    leaves = exact_dedup.digests(spark.range(0, 64, 1, 8).selectExpr("id AS doc_id", "CAST(id % 20 AS string) AS text"))
    plan = exact_dedup.merged(leaves, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3


def sets_of(texts, words):
    out = {}
    for k, t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        n = min(words, len(w))
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    return out


def test_near_groups(docs, empty, texts):
    sets = sets_of(texts, 2)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_groups(docs).collect()
    assert {(r["id"], r["n"], r["component"]) for r in got} == {(k, len(sets[k]), root(k)) for k in sets}
    assert len(got) == len(texts)
    assert near_dedup.near_groups(empty).count() == 0


def test_buckets_and_components_that_are_hard_go_by_rare_shingles(spark, docs, texts, monkeypatch):
    want = {(r["id"], r["n"], r["component"]) for r in near_dedup.near_groups(docs).collect()}
    monkeypatch.setattr(near_dedup, "HARD", 0)
    assert {(r["id"], r["n"], r["component"]) for r in near_dedup.near_groups(docs).collect()} == want
    r, rows, at = random.Random(23), [], 0
    for size in (6, 12, 40, 150):  # families on both sides of the threshold
        for edits in (1, max(1, size // 20), size // 16 + 1, size // 10 + 1):
            base = [f"w{r.randrange(10**6)}" for _ in range(size)]
            for _ in range(8):
                words = list(base)
                for _ in range(edits):
                    words[r.randrange(size)] = f"v{r.randrange(10**6)}"
                rows.append((at, " ".join(words)))
                at += 1
    sets, parent = sets_of(rows, 2), {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: root(k) for k in sets} and len(set(got.values())) < len(got)


def test_a_boilerplate_family_below_the_threshold(spark, monkeypatch):
    """Documents of one form with words of their own among it: most share a bucket with many others and none is linked."""
    monkeypatch.setattr(near_dedup, "HARD", 10_000)
    r = random.Random(5)
    form, rows = [f"f{k}" for k in range(160)], []
    for k in range(1200):
        words = list(form)
        at = r.randrange(130)
        words[at : at + 24] = [f"o{r.randrange(10**7)}" for _ in range(24)]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near_dedup.near_groups(df).filter("id <> component").count() == 0


def planted_pairs(count, low, high):
    """Pairs of sets with a similarity between low and high, and the similarity of each."""
    import numpy as np

    rng, out, similarity = np.random.default_rng(17), [], []
    while len(similarity) < count:
        size = int(rng.integers(40, 160))
        both = int(rng.integers(size // 2, size + 1))
        extra = int(rng.integers(0, 30))
        j = both / (size + extra)
        if low <= j < high:
            values = rng.integers(0, 2**64, size + extra, np.uint64)
            out += [np.sort(values[:size]), np.sort(np.concatenate((values[:both], values[size:])))]
            similarity.append(j)
    return out, similarity


def test_recall_of_bands_and_sketches_just_above_the_threshold():
    import numpy as np

    sets, similarity = planted_pairs(10_000, 0.80, 0.85)
    bands = np.concatenate([near_dedup.bands_of(sets[k : k + 2000], near_dedup.BANDS, near_dedup.ROWS) for k in range(0, len(sets), 2000)])
    assert (bands[::2] == bands[1::2]).any(1).sum() == 10_000 and 0.80 <= min(similarity) < 0.805
    bits = near_dedup.bits_of(sets[:2000])
    assert (np.bitwise_count((bits[::2] ^ bits[1::2]).view(np.uint64)).sum(1) <= near_dedup._most_different(0.8)).all()


def test_near_and_exact_groups_of_rows_without_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(None, text), (None, text), (4, text), (9, text + " x"), (None, None), (7, "")], "doc_id long, text string")
    near = collections.Counter((r["id"], r["component"]) for r in near_dedup.near_groups(df).collect())
    assert near == collections.Counter([(None, None), (None, None), (None, None), (4, 4), (9, 4), (7, 7)])
    exact = collections.Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect())
    assert exact == collections.Counter([(None, 4, 3, False), (None, 4, 3, False), (4, 4, 3, True), (9, 9, 1, True), (None, 7, 2, False), (7, 7, 2, True)])


def test_a_chain_is_one_component(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(30)] + [(99, " ".join(words[:20] + words[300:380]))]
    got = {r["id"]: r["component"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k in range(30)} | {99: 99}


def cut(texts, size):
    first, out = {}, {}
    for k, t in sorted({(k, t or "") for k, t in texts}):
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            owner = first.setdefault(tuple(w[i : i + size]), k)
            if owner < k:
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(docs, empty, texts):
    got = substring_dedup.without_repeats(docs).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == cut(texts, 13)
    assert len(got) == len(texts)
    assert substring_dedup.without_repeats(empty).count() == 0


def test_frequent_runs_are_dealt_by_windows(spark, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    monkeypatch.setattr(substring_dedup, "SHARD", 200)
    df = spark.createDataFrame([x for x in texts if x[0] != 80], "doc_id long, text string")
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.without_repeats(df).collect()}
    assert got == cut([x for x in texts if x[0] != 80], 13)


def test_matching_statistics_against_earlier_documents():
    import numpy as np

    r = random.Random(8)
    documents = [[r.choice([1, 1, 2, 3, 4, 5]) for _ in range(r.randint(1, 90))] for _ in range(12)]
    text = np.array([x for d in documents for x in [*d, 0]], np.int32)
    owners = np.array([k for k, d in enumerate(documents) for _ in range(len(d) + 1)], np.int32)
    index = fm_index.FmIndex(text, 6, 100, owners)
    begin = np.cumsum([0] + [len(d) + 1 for d in documents])[:-1]
    places = [(k, e) for k, d in enumerate(documents) for e in range(1, len(d) + 1)]
    own = np.array([k for k, _ in places])
    for size in (1, 3, 7):
        length, least = index.statistics(text, begin[own], begin[own] + [e for _, e in places], own.astype(np.int32), size)
        for (k, e), n, m in zip(places, length.tolist(), least.tolist(), strict=True):
            d = documents[k]
            has = lambda part: [j for j, x in enumerate(documents) if any(x[i : i + len(part)] == part for i in range(len(x) - len(part) + 1))]  # noqa: E731, B023
            assert n == max(i for i in range(e + 1) if i == 0 or has(d[e - i : e])[0] < k)
            assert n < size or m == has(d[e - size : e])[0]


def test_substring_dedup_of_rows_without_id_and_of_one_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(None, a), (None, a), (5, a), (5, a), (7, b), (7, f"{c} x {a}"), (9, f"{b} y {c}"), (10, f"{b}  y {c}")]
    got = collections.Counter((r["id"], r["n_words"], r["n_removed"]) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(None, 30, 0), (None, 30, 0), (5, 30, 0), (5, 30, 0), (7, 30, 0), (7, 61, 30), (9, 61, 60), (10, 61, 61)])

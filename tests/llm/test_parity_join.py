"""The parity-sketch join against brute force over all pairs."""

import random

import numpy as np
import pytest

from lodestrand.llm import parity_join
from lodestrand.llm.near_dedup import shingles


def sets_of(texts, words):
    out = {}
    for k, t in texts:
        w = [x.lower() for x in (t or "").encode().split()]
        n = min(words, len(w))
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    return out


def components_of(sets, percent):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def check(df, texts, words=4, percent=85):
    sets = sets_of(texts, words)
    want = components_of(sets, percent)
    got = parity_join.linked_groups(df, words=words, percent=percent).collect()
    assert len(got) == df.count()
    assert {(r["id"], r["n"], r["component"]) for r in got} == {(k, len(sets[k]), want[k]) for k in sets}


def family(r, size, edits, copies, first):
    base = [f"w{r.randrange(10**6)}" for _ in range(size)]
    out = []
    for k in range(copies):
        words = list(base)
        for _ in range(edits):
            words[r.randrange(size)] = f"v{r.randrange(10**6)}"
        out.append((first + k, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def families():
    """Families on both sides of the threshold, of sizes that lie in and across bands, and one passage that all share."""
    r = random.Random(11)
    out, at = [], 0
    for size in (4, 5, 8, 12, 20, 33, 64, 66, 130, 250, 260, 700):
        for edits in (0, 1, max(1, size // 60), max(1, size // 40), size // 20 + 1):
            out += family(r, size, edits, 6, at)
            at += 6
    passage = " ".join(f"p{k}" for k in range(60))
    for text in [t for _, t in out[:200]]:
        out.append((at, text[: r.randrange(20, 2000)].rsplit(" ", 1)[0] + " " + passage))
        at += 1
    r.shuffle(out)
    return out


def test_odd_rows(docs, empty, texts):
    check(docs, texts)
    check(docs, texts, words=2, percent=60)
    assert parity_join.linked_groups(empty).count() == 0


def test_rows_without_id_stand_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = parity_join.linked_groups(df).collect()
    assert sorted((r["id"], r["n"], r["component"]) for r in got if r["id"]) == [(1, 3, 1), (2, 3, 1)]
    assert sorted((r["n"], r["component"]) for r in got if r["id"] is None) == [(0, None), (3, None)]


def test_families_around_the_threshold(spark, families):
    check(spark.createDataFrame(families, "doc_id long, text string").repartition(4), families)


def test_keys_that_are_hard_go_by_rare_shingles(spark, families, monkeypatch):
    monkeypatch.setattr(parity_join, "HARD", 0)
    check(spark.createDataFrame(families, "doc_id long, text string").repartition(4), families)


def test_every_linked_pair_has_a_key_in_common_and_its_sketches_pass():
    r = np.random.default_rng(5)
    for n in [*range(1, 80), 127, 128, 129, 255, 256, 300, 511, 520, 1500, 6000]:
        for _ in range(8):
            a = r.integers(0, 2**63, n, np.uint64)
            lost = int(r.integers(0, n * 15 // 100 + 1))
            most = max(m for m in range(n + 2) if 100 * (n - lost) >= 85 * (n + m))
            b = np.concatenate([a[lost:], r.integers(0, 2**63, most, np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if lost or most:
                one, two = parity_join.keys_of(a, 85), parity_join.keys_of(b, 85)
                often = {}
                for k in (int(x) for keys, _ in one + two for x in keys):
                    often[k] = int(r.integers(2, 50))  # whatever the frequencies
                kept = [{k for keys, spare in made for k in sorted(map(int, keys), key=lambda k: (-often[k], -k))[spare:]} for made in (one, two)]
                assert kept[0] & kept[1]
            for longs in (8, 1):
                differ = np.bitwise_count((parity_join.folded(parity_join.sketch_of(a), longs) ^ parity_join.folded(parity_join.sketch_of(b), longs)).view(np.uint64)).sum()
                assert differ <= lost + most <= parity_join.most_different(len(a), len(b), 85)


def test_sketch_parts_bound_the_difference():
    a, b = shingles(b"one two three four five six seven", 2), shingles(b"one two three four five six eight", 2)
    for top in (7, 127, 500):
        x, y = parity_join.parts_of(a, top, 85), parity_join.parts_of(b, top, 85)
        assert sum(int(v).bit_count() for v in x ^ y) <= 2


def test_sets_without_a_common_shingle_share_no_key(spark):
    """A part with few shingles has few bits set, so its bits alone are the same in many unrelated sets."""
    r = np.random.default_rng(9)
    made = [parity_join.keys_of(np.unique(r.integers(0, 2**63, n, np.uint64)), 85) for n in (70, 128, 300, 900) for _ in range(300)]
    keys = np.concatenate([k for bands in made for k, _ in bands])
    assert len(np.unique(keys)) == len(keys)
    texts = [(k, " ".join(f"w{r.integers(10**9)}" for _ in range(150))) for k in range(300)]
    known = parity_join.signatures(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 4, 85)
    assert parity_join.shared_keys(known, known.select("id")).count() == 0


def test_a_boilerplate_family_below_the_threshold(spark):
    """Documents of one form with a fifth of words of their own: they share keys and none is linked."""
    r = random.Random(3)
    form = [f"f{k}" for k in range(200)]
    texts = []
    for k in range(600):
        words = list(form)
        at = r.randrange(120)
        words[at : at + 40] = [f"o{r.randrange(10**6)}" for _ in range(40)]
        texts.append((k, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert parity_join.linked_groups(df).filter("id <> component").count() == 0

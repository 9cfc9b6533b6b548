"""Encoders, token counts and packing against the libraries."""

import base64
import collections
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

from lodestrand.llm import byte_bpe, packing, token_counts, word_tokens

ALPHABET = "ab \t\n'sS tdTmlrve12!?é 　\x1c\x85ñ漢字😀ΣσİßA<|>"


def fuzz(n):
    r = random.Random(9)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["<|endoftext|>a<|startoftext|>", "don't 'tis we'll 12", "q" * 700]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ranked():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_odd_texts(library):
    batch = fuzz(3000)
    want = [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]
    assert token_counts.count_batch(batch, token_counts.default_vocabulary()).tolist() == want


def test_counts_when_the_table_is_full(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 2_000)
    r = random.Random(2)
    batch = [" ".join("".join(r.choice("abcdefghijkl") for _ in range(9)) for _ in range(300)) for _ in range(4)]
    assert token_counts.count_batch(batch, token_counts.default_vocabulary()).tolist() == [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]


def test_chunks_of_any_size_agree():
    machine = token_counts.transducer(token_counts.default_vocabulary())
    batch = [token_counts.normal(t) for t in fuzz(200)]
    want = token_counts.counted(machine, batch, 1 << 20).tolist()
    for chunk in (1, 2, 3, 17, 256):
        assert token_counts.counted(machine, batch, chunk).tolist() == want


def test_maps_of_chunks_inside_long_words_compose(library):
    r = random.Random(12)
    machine = token_counts.transducer(token_counts.default_vocabulary())
    batch = ["".join(r.choice(letters) for _ in range(n)) for letters, n in (("abcdefghij", 3000), ("aab", 1500), ("th", 900), ("漢字仮名ab", 700), ("q", 5000))] + ["x " + "lantern" * 300 + " y"]
    want = [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)]
    for chunk in (5, 16, 64, 256, 1 << 20):
        assert token_counts.counted(machine, [token_counts.normal(t) for t in batch], chunk).tolist() == want


def test_an_endless_word_keeps_the_table_bounded(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 9_000)
    monkeypatch.setattr(token_counts, "SEGMENT", 2_000)
    r = random.Random(13)
    text = "".join(r.choice("abcdefghijklmnop") for _ in range(30_000))
    machine = token_counts.transducer(token_counts.default_vocabulary())
    ids = library.encode(text, add_special_tokens=False).ids
    assert token_counts.count_batch([text], token_counts.default_vocabulary()).tolist() == [len(ids)]
    assert len(machine.state) < 14_000
    assert word_tokens.ids_of([text], token_counts.default_vocabulary()) == [np.array(ids, "<u4").tobytes()]
    assert len(machine.state) < 14_000


def test_ids_of_odd_texts(library):
    batch = fuzz(3000)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(batch, add_special_tokens=False)]
    assert word_tokens.ids_of(batch, token_counts.default_vocabulary()) == want


def test_token_counts(docs, empty, texts, library):
    got = collections.Counter((r["id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect())
    assert got == collections.Counter((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in texts)
    assert token_counts.count_tokens(empty).count() == 0


def test_byte_bpe_of_odd_texts(ranked):
    batch = fuzz(3000)
    coder = byte_bpe.coder(byte_bpe.default_vocabulary(), byte_bpe.default_pattern())
    assert [np.frombuffer(x, "<i4").tolist() for x in coder.encode(batch)] == ranked.encode_ordinary_batch(batch)


def test_byte_bpe_round_trip(docs, empty, texts, ranked):
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert collections.Counter((r["id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == collections.Counter((k, tuple(ranked.encode_ordinary(t or "")), (t or "").encode()) for k, t in texts)
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0


def test_perfect_hash_is_minimal():
    from lodestrand.llm.perfect_hash import PerfectHash

    keys = [str(k).encode() for k in range(5000)]
    assert sorted(PerfectHash(keys).numbers(keys).tolist()) == list(range(5000))


def test_ids_of_long_texts_in_stretches(library, monkeypatch):
    monkeypatch.setattr(word_tokens, "STRETCH", 40, raising=False)
    batch = [*fuzz(300), " ".join(fuzz(200)), "a" * 300 + "\u3000b<|endoftext|> " + "c d\xa0" * 100, "", " ", "\x1c \x1f"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(batch, add_special_tokens=False)]
    assert word_tokens.ids_of(batch, token_counts.default_vocabulary()) == want
    assert word_tokens.ids_of([], token_counts.default_vocabulary()) == [] and word_tokens.ids_of(["", " "], token_counts.default_vocabulary()) == [b"", b""]


def test_new_pieces_of_known_words_cost_no_python_call_each(library):
    r = random.Random(8)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    words = ["".join(r.choice(syllables) for _ in range(3)) for _ in range(3000)]
    path, calls = token_counts.default_vocabulary(), 0
    word_tokens.ids_of([" ".join(words)], path)
    pieces = [f"{r.choice(words)}!{r.choice(words)}" for _ in range(20_000)]

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = word_tokens.ids_of([" ".join(pieces)], path)
    finally:
        sys.setprofile(None)
    assert found == [np.array(library.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4").tobytes()]
    assert calls < len(pieces)


def test_packing(docs, empty, texts, library):
    got = packing.packed(docs, size=256).collect()
    want = collections.Counter()
    for k, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((k, i, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, a in enumerate(range(0, len(ids), 256)) if (p := ids[a : a + 256]))
    assert collections.Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(b, b[1:], strict=False)) and sum(n for _, n in b) <= 256
    first_fit: list[int] = []
    for n in sorted((r["length"] for r in got), reverse=True):
        k = next((k for k, room in enumerate(first_fit) if room >= n), None)
        if k is None:
            first_fit.append(256 - n)
        else:
            first_fit[k] -= n
    assert len(bins) <= len(first_fit)
    assert packing.packed(empty).count() == 0


def test_fillings_use_every_piece_once():
    r = random.Random(1)
    counts = {r.randint(1, 100): r.randint(1, 9) for _ in range(40)}
    used = collections.Counter()
    for bin_, times in packing.fillings(counts, 100):
        assert sum(n * m for n, m in bin_.items()) <= 100
        for n, m in bin_.items():
            used[n] += m * times
    assert used == counts
    full = packing.fillings({60: 2, 50: 2, 40: 1, 25: 2}, 100)
    assert sum(t for _, t in full) == 4 and ({60: 1, 40: 1}, 1) in full


def test_memory_of_workers_follows_neither_number_nor_length_of_keys():
    from lodestrand.llm.common import Memory

    r = random.Random(2)
    memory = Memory(1000)
    for _ in range(60):
        keys = ["".join(chr(0x4E00 + r.randrange(2000)) for _ in range(r.choice((2, 5, 63, 64, 65, 4000)))) for _ in range(300)]
        keys += keys[:20]
        assert memory.of(keys, lambda new: [k.encode() for k in new]) == [k.encode() for k in keys]
        held = [*memory.young.items(), *memory.old.items()]
        assert all(len(k) <= Memory.LONGEST for k, _ in held) and sum(len(k) + len(v) for k, v in held) < 3 * 128 * 1000


def test_text_without_spaces_leaves_little_behind():
    import public_tokenizers

    from lodestrand.llm import byte_bpe, word_tokens

    r = random.Random(6)
    coder = byte_bpe.Coder(byte_bpe.default_vocabulary(), byte_bpe.default_pattern())
    words = word_tokens.Words(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(4):
        batch = ["".join(chr(0x4E00 + r.randrange(5000)) for _ in range(20_000)) for _ in range(6)]
        coder.encode(batch)
        words.ids(batch[:1])
    for memory in (coder.stretches, coder.pieces, words.pieces, words.words):
        assert sum(len(k) + len(v) for held in (memory.young, memory.old) for k, v in held.items()) < 100_000

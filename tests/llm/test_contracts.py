"""All contract columns of the ten query functions over a small folder, against expressions written here and the public libraries."""

import base64
import collections
import hashlib
import re
import struct
import zlib

import public_tokenizers
import pytest

from lodestrand.llm import queries

Q = queries.queries()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contract"))
    one = docs.dropDuplicates(["doc_id"]).selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    one.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def got(spark, folder, name):
    rows = Q[name](spark, folder).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) or name == "op10_best_fit_packing"
    return {r["doc_id"]: r for r in rows} if name != "op10_best_fit_packing" else rows


def test_op1(spark, folder, rows):
    found = got(spark, folder, "op1_mpeg_audio")
    assert found.keys() == rows.keys()
    for k, r in found.items():
        raw = (rows[k]["text"] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > len(payload) and re.fullmatch("[0-9a-f]{64}", r["media_sha256"]) and r["feature"]
    by_text = collections.defaultdict(set)
    for k, r in found.items():
        by_text[rows[k]["text"] or ""].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_op2(spark, folder, rows):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for k, r in rows.items()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            first.setdefault(tuple(words[k][i : i + 13]), k)
    for k, r in got(spark, folder, "op2_substring_dedup").items():
        w, gone = words[k], set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone |= set(range(i, i + 13))
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op3(spark, folder, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, r in got(spark, folder, "op3_byte_bpe").items():
        ids = library.encode_ordinary(rows[k]["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(rows[k]["text"] or ""))


def test_op4(spark, folder, rows):
    groups = collections.defaultdict(list)
    for k, r in rows.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), k))
    for k, r in got(spark, folder, "op4_exact_dedup").items():
        own = re.sub(r"[\x20\x09-\x0D]", "", rows[k]["text"] or "")
        keep = min(groups[own])[1]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(groups[own]), k == keep, sha(own))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_op5(spark, folder, rows, library):
    for k, r in got(spark, folder, "op5_token_counts").items():
        n = len(library.encode(rows[k]["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((rows[k]["text"] or "").encode()), n, n > 2048)


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_op6(spark, folder, rows):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    for k, r in got(spark, folder, "op6_personal_data").items():
        base = [(name, m.start(), m.end()) for name, form, ok in kinds for m in re.finditer(form, rows[k]["text"] or "") if ok(m[0])]
        count = collections.Counter(x[0] for x in base)
        assert [r[f"n_{name}"] for name, _, _ in kinds] == [count[name] for name, _, _ in kinds] and r["base_sha256"] == sha(listed(base))
        assert set(listed(base).split(",")) <= set(r["spans"].split(","))


def test_op7(spark, folder, rows):
    for k, r in got(spark, folder, "op7_language_id").items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == "und" if not any(c.isalpha() for c in rows[k]["text"] or "") else r["lang_pred"] in ("en", "de")


def test_op7_learns_nothing_from_held_out_rows_or_other_columns(spark, folder, tmp_path):
    found = {k: (r["lang_pred"], r["score"]) for k, r in got(spark, folder, "op7_language_id").items()}
    changed = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang", "'other' AS source", "n_chars")
    changed.write.parquet(f"{tmp_path}/documents.parquet")
    assert {k: (r["lang_pred"], r["score"]) for k, r in got(spark, str(tmp_path), "op7_language_id").items()} == found


def test_op8(spark, folder, rows):
    kinds = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    for k, r in got(spark, folder, "op8_secret_scan").items():
        found = sorted((m.start(), n, m.end()) for n, (_, form, group, least) in enumerate(kinds) for m in re.finditer(form, rows[k]["text"] or "", re.A) if len(m[group]) >= least)
        base = [(kinds[n][0], a, b) for a, n, b in found]
        count = collections.Counter(x[0] for x in base)
        assert [r[f"n_{x[0]}"] for x in kinds] == [count[x[0]] for x in kinds] and r["base_sha256"] == sha(listed(base)) and set(listed(base).split(",")) <= set(r["spans"].split(","))


def test_op9(spark, folder, rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, r in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower))
        sets[k] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    while True:
        before = dict(label)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    for k, r in got(spark, folder, "op9_near_dedup").items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[k]), label[k], k == label[k])


def test_op10(spark, folder, rows, library):
    ids = {k: library.encode(r["text"] or "", add_special_tokens=False).ids + [0] for k, r in rows.items()}
    found = got(spark, folder, "op10_best_fit_packing")
    by_document, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_document[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_document.keys() == ids.keys()
    for k, own in by_document.items():
        own.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(i, a, min(2048, len(ids[k]) - a)) for i, a in enumerate(range(0, len(ids[k]), 2048))]
        assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[k][r["start"] : r["start"] + r["length"]])) for r in own)
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 2048) + 1

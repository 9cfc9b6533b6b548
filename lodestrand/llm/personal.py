"""Personal data: fixed base expressions, and a semi-Markov conditional random field that adds spans.

The field labels stretches of tokens around digits and at-signs. A segmentation's score is
the sum over its segments of weights of whole-span features (shape, number of digits, check
digit, value of groups, neighbouring words, length), with segments of a kind bounded to
MOST tokens; dynamic programming finds boundaries and kinds together. Weights are trained
by gradient steps on the log-likelihood (forward and backward sums over all segmentations)
of a bounded sample of stretches labelled by the base expressions; in two of three steps
their entities are rewritten as people write them elsewhere (numbers without plus and country,
other separators, addresses in words), or into what looks alike and is none (dates, numbers
whose check digit is wrong, versions), so that the field knows more forms than the base has.
Added spans need odds of at least SURE against no entity and never overlap base spans.

Null and empty texts have no spans. Repeated rows are answered one by one; an empty table
gives an empty result (and trains nothing); other columns are left out.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import arrow_map, documents, id_and_text, utf8

KINDS = ("email", "ip", "card", "phone")
#: Longest segment in tokens, longest stretch of training and tokens of a decoding step, and log odds from which a span is added.
MOST, STRETCH, SURE = 14, 160, 2.0
#: Bounds of training: documents that are read for it (chosen by a hash), stretches, passes over them.
SAMPLE, STRETCHES, PASSES = 4000, 800, 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starting at a run's first digit, and possessive, is the same and takes linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((a, end))
        at = text.find("@", max(at + 1, end))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|[\w]")
_SEED = re.compile(r"[0-9]+|@|\b(?:at|AT)\b")
_WORDED = r"\b(?:dot|DOT)\b|[(\[](?:at|AT)[)\]]"
#: What an address in words has for signs, and one that is read with signs put there.
_AT, _DOT = re.compile(r"\s*[(\[]?\b(?:at|AT)\b[)\]]?\s*|\s*@\s*"), re.compile(r"\s+(?:dot|DOT)\s+")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_RUN = re.compile(r"[0-9]+")
_SHAPE = re.compile(r"[0-9]+|[^\W\d_]+|\s+")


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Token offsets of the stretches that may hold an entity: seeds with some tokens around them."""
    out: list[tuple[int, int]] = []
    for m in _SEED.finditer(text):
        a, b = max(0, m.start() - 40), min(len(text), m.end() + 40)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    made = []
    for a, b in out:
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
        if sum(text[s].isdigit() for s, _ in tokens) >= 3 or "@" in text[a:b] or re.search(_WORDED, text[a:b]):
            made.append(tokens)
    return made


def _clean(word: str) -> str:
    return word.lower()[:12]


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, list[str]]]:
    """All segments of the lattice: (first token, token behind, kind or -1, features)."""
    out = []
    n = len(tokens)
    what = [("9" if text[a].isdigit() else "a" if text[a].isalpha() else text[a]) for a, _ in tokens]
    for i, (a, b) in enumerate(tokens):
        size = min(b - a, 6) if what[i] == "9" else 0
        out.append((i, i + 1, -1, [f"o:{what[i]}{size}", f"o:{what[i]}:{what[i - 1] if i else '^'}"]))
        if what[i] not in "9a+(":
            continue
        digits = marks = 0
        for j in range(i, min(n, i + MOST)):
            c = what[j]
            if j > i and tokens[j][0] - tokens[j - 1][1] > 1 or c not in "9a+(@).-[]/ ":
                break
            if c == "9":
                digits += tokens[j][1] - tokens[j][0]
            elif c == "@" or c == "a" and text[tokens[j][0] : tokens[j][1]].lower() == "at":
                marks += 1
            if c not in "9a" or digits > 24:
                continue
            kinds = [0] if marks == 1 and j - i >= 4 else [] if marks or what[i] == "a" or c == "a" else [k for k, ok in ((1, 4 <= digits <= 12 and j - i == 6 and what[i + 1 : j : 2] == ["."] * 3), (2, 13 <= digits <= 19), (3, 7 <= digits <= 15)) if ok]
            if not kinds or kinds != [0] and "a" in what[i : j + 1]:
                continue
            whole = text[a : tokens[j][1]]
            bare = _SHAPE.sub(lambda m: str(min(len(m[0]), 9)) if m[0][0].isdigit() else "a" if m[0][0].isalpha() else " ", whole)
            left = _clean(text[tokens[i - 1][0] : tokens[i - 1][1]]) if i else "^"
            right = what[j + 1] if j + 1 < n else "$"
            for k in kinds:
                d = _digits(whole)
                f = [f"{k}:bias", f"{k}:shape:{bare[:28]}", f"{k}:groups:{'-'.join(str(len(x)) for x in _RUN.findall(whole)[:6]) if k else ''}", f"{k}:digits:{digits}", f"{k}:left:{left}", f"{k}:right:{right}", f"{k}:tokens:{j - i + 1}", f"{k}:first:{what[i]}"]
                if k == 1:
                    f.append(f"1:octets:{all(int(x) <= 255 for x in re.findall('[0-9]+', whole))}:{whole.count('.')}")
                if k == 2:
                    f.append(f"2:check:{_luhn(d)}")
                if k == 0:
                    read = _AT.sub("@", _DOT.sub(".", whole))
                    f += [f"0:reads:{bool(_ADDRESS.fullmatch(read))}"] * (j - i + 2)  # once, and once for each token that would else be none
                    f.append(f"0:mark:{'@' in whole}:{'dot' in whole.lower() or '.' in whole.split('@')[-1]}")
                out.append((i, j + 1, k, f))
    return out


def _other_form(kind: int, whole: str, way: int) -> tuple[str, bool]:
    """An entity in another form, or something that looks alike; and whether it is an entity still."""
    d = _digits(whole)
    if kind == 3 and len(d) >= 10:
        x, y, z = d[-10:-7], d[-7:-4], d[-4:]
        return [(f"({x}) {y}-{z}", True), (f"{x}-{y}-{z}", True), (f"{x}.{y}.{z}", True), (f"{x} {y} {z}", True), (f"({x}) {y} {z}", True), (f"20{x[:2]}-0{y[0]}-1{z[0]}", False), (f"{x[:2]}.0{y[0]}.20{z[:2]}", False), (f"{x},{y},{z[:3]}.{z[2:]}", False)][way % 8]
    if kind == 2:
        four = [d[k : k + 4] for k in range(0, len(d), 4)]
        wrong = d[:-1] + str((int(d[-1]) + 1) % 10)
        return [(".".join(four), True), ("/".join(four), True), (". ".join(four), True), (whole, True), (wrong, False), (".".join(wrong[k : k + 4] for k in range(0, len(d), 4)), False), (f"{d[:2]}/{d[2:4]}/{d[4:8]}", False)][way % 7]
    if kind == 0 and "@" in whole:
        local, _, domain = whole.partition("@")
        return [(f"{local} at {domain.replace('.', ' dot ')}", True), (f"{local} (at) {domain}", True), (f"{local} [at] {domain.replace('.', ' dot ')}", True), (whole, True), (f"{local} at {domain.partition('.')[0]}", False)][way % 5]
    if kind == 1:
        return [(whole, True), (whole, True), (whole.rpartition(".")[0], False)][way % 3]
    return whole, True


def rewritten(text: str, spans: list[tuple[int, int, int]], way: int) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(text, tokens, spans) with entities in other forms."""
    out, found, at, size = [], [], 0, 0
    for n, (kind, a, b) in enumerate(sorted(spans, key=lambda x: x[1])):
        if a < at:
            continue
        form, is_one = _other_form(kind, text[a:b], way + n)
        out += [text[at:a], form]
        size += a - at
        if is_one:
            found.append((kind, size, size + len(form)))
        at, size = b, size + len(form)
    whole = "".join([*out, text[at:]])
    return whole, [(m.start(), m.end()) for m in _TOKEN.finditer(whole)], found


def _sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _scores(lattice, weights: dict[str, float]) -> list[float]:
    return [sum(weights.get(f, 0.0) for f in s[3]) for s in lattice]


def train(examples: list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]], passes: int = PASSES, rate: float = 0.3, shrink: float = 1e-3) -> dict[str, float]:
    """Weights from (text, tokens, base spans): stochastic gradient of the segmentations' log-likelihood."""
    weights: dict[str, float] = {}
    for turn in range(passes):
        for number, (text, tokens, spans) in enumerate(examples):
            if way := (turn + number) % 3:
                text, tokens, spans = rewritten(text, spans, number // 3 + 3 * turn + way)
            lattice = segments(text, tokens)
            gold = {(a, b): k for k, a, b in spans}
            right, taken, covered = set(), [], set()
            for s, (i, j, k, _) in enumerate(lattice):
                if k >= 0 and gold.get((tokens[i][0], tokens[j - 1][1])) == k:
                    right.add(s)
                    taken.append((i, j))
            for i, j in taken:
                covered.update(range(i, j))
            right |= {s for s, (i, _, k, _) in enumerate(lattice) if k < 0 and i not in covered}
            score = _scores(lattice, weights)
            n = len(tokens)
            ending: list[list[int]] = [[] for _ in range(n + 1)]
            begin: list[list[int]] = [[] for _ in range(n + 1)]
            for s, (i, j, _, _) in enumerate(lattice):
                ending[j].append(s)
                begin[i].append(s)
            ahead = [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = _sum([ahead[lattice[s][0]] + score[s] for s in ending[j]])
            back = [0.0] * (n + 1)
            for i in range(n - 1, -1, -1):
                back[i] = _sum([back[lattice[s][1]] + score[s] for s in begin[i]])
            step = rate / (1 + turn)
            for s, (i, j, _, features) in enumerate(lattice):
                g = (s in right) - math.exp(ahead[i] + score[s] + back[j] - ahead[n])
                if abs(g) > 1e-4:
                    for f in features:
                        w = weights.get(f, 0.0)
                        weights[f] = w + step * (g - shrink * w)
    return {f: round(w, 4) for f, w in weights.items() if abs(w) > 1e-3}


def decode(text: str, tokens: list[tuple[int, int]], weights: dict[str, float], block: int = STRETCH) -> list[tuple[int, int, int]]:
    """The best segmentation's entities that are sure enough: (kind, start, end).

    The lattice is made for `block` first tokens at a time and scores are carried on, so that entities may lie over block ends.
    """
    n = len(tokens)
    none = [0.0] * (n + 1)  # the score of no entity up to a token
    best, how = [0.0] + [-math.inf] * n, [(-1, -1)] * (n + 1)
    reach = 0  # where the last segment ends that was begun before a block
    for lo in range(0, n, block):
        hi, base = min(n, lo + block), max(0, lo - 1)
        lattice = [(i + base, j + base, k, f) for i, j, k, f in segments(text, tokens[base : min(n, hi + MOST)]) if i + base >= lo]
        if reach <= lo and all(k < 0 for i, _, k, _ in lattice if i < hi):  # no segment lies over the block's ends, so its score is the same for all segmentations
            best[hi], how[lo + 1 : hi + 1] = best[lo], [(i, -1) for i in range(lo, hi)]
            continue
        score = _scores(lattice, weights)
        for s, (i, j, k, _) in enumerate(lattice):
            if k < 0:
                none[j] = none[i] + score[s]
        for s, (i, j, k, _) in enumerate(lattice):
            if i >= hi or k >= 0 and score[s] - (none[j] - none[i]) < SURE:
                continue
            v = best[i] + score[s]
            if v > best[j] + 1e-9:  # so that rounding decides nothing
                best[j], how[j] = v, (i, k)
            if k >= 0:
                reach = max(reach, j)
    out, j = [], n
    while j:
        i, k = how[j]
        if k >= 0:
            out.append((k, tokens[i][0], tokens[j - 1][1]))
        j = i
    return out[::-1]


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = STRETCHES) -> dict[str, float]:
    """Trains on at most `most` stretches of about `sample` documents."""
    rows = id_and_text(df, id_col, text_col).filter("text IS NOT NULL")
    total = rows.count()
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(total, 1))))

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        out = {"key": [], "part": [], "spans": []}
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = base_spans(text)
            for tokens in (run[k : k + STRETCH] for run in stretches(text) for k in range(0, len(run), STRETCH)):
                a, b = tokens[0][0], tokens[-1][1]
                own = [x for k, s, e in spans if a <= s and e <= b for x in (k, s - a, e - a)]
                out["key"].append(hash((i, a)) & 0x7FFFFFFF if i is not None else a)
                out["part"].append(text[a:b])
                out["spans"].append(own)
        return out

    found = arrow_map(chosen, each, "key long, part string, spans array<int>")
    examples = []
    for r in found.orderBy(F.size("spans").desc(), F.xxhash64("part"), "part").limit(most // 2).collect() + found.filter(F.size("spans") == 0).orderBy(F.xxhash64("part"), "part").limit(most // 2).collect():
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(r["part"])][:STRETCH]
        s = r["spans"]
        if tokens:
            examples.append((r["part"], tokens, [(s[k], s[k + 1], s[k + 2]) for k in range(0, len(s), 3)]))
    order = sorted(range(len(examples)), key=lambda k: (k * 7919) % 10_007)
    return train([examples[k] for k in order])


def find_personal(df: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans array<struct<kind, start, end, text, base>>, by kind as listed and then start, one row for each row of `df`."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        column = batch.column(1)
        body, at = utf8(column)
        seeds = np.concatenate(([0], np.cumsum((body - 48 < 10) | (body == 64), dtype=np.int64)))
        worded = pc.fill_null(pc.match_substring_regex(column, _WORDED), False).to_numpy(zero_copy_only=False)
        rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i in np.flatnonzero((seeds[at[1:]] > seeds[at[:-1]]) | worded):  # no span does without a digit, an at-sign or, beside the word at, the word dot
            text = column[int(i)].as_py()
            base = base_spans(text)
            found = [(k, a, b, True) for k, a, b in base]
            for tokens in stretches(text):
                found += [(k, a, b, False) for k, a, b in decode(text, tokens, weights) if not any(a < y and x < b for _, x, y in base)]
            rows[i] = [{"kind": KINDS[k], "start": a, "end": b, "text": text[a:b], "base": own} for k, a, b, own in sorted(found, key=lambda s: s[:2])]
        return {"id": batch.column(0), "spans": rows}

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, spans array<struct<kind string, start long, end long, text string, base boolean>>")


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns of find_personal over all documents."""
    docs = documents(spark, sf_dir)
    found = find_personal(docs, learn(docs))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda keep: F.array_join(F.transform(F.filter("spans", keep), text), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(of(lambda s: s["base"]), 256).alias("base_sha256"), of(lambda s: F.lit(True)).alias("spans"))

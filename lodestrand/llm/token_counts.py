"""Token counts by a compiled finite-state transducer.

The tokenizer (lower case, white space dropped, pre-tokens by pattern, BPE with word ends)
becomes a deterministic transducer over bytes. A state holds, for the last bytes that can
still belong to a token not yet complete, which token BPE would end with there and how many
tokens that takes; a transition's annotation is how many more tokens the text has with the
byte than without it. It rests on the fact that BPE's encoding of a prefix ends in the only
token that may follow the encoding of what stands before it (two tokens may stand side by
side if their joined bytes are encoded as just these two). A word's last byte is a symbol
of its own, after which the state is the start state again and the sum of annotations is
the word's count. Transitions are compiled when they are first met and kept by the worker.

Texts are cut into chunks of equal size, whatever stands at the cuts. A chunk's map of
states is constant behind its first word end; before that (its front), or all through it if
a word spans it, it depends on the state that enters. Chunks run side by side from their
first word on. A chunk inside a word has its map taken at the state that a run-up of
WARM bytes leads to (only the last bytes matter, so that state is nearly always the right
one); maps of neighbours compose where one's exit is the other's entry, which a scan of
doubling spans finds for all chunks at once, and only where they don't fit a map is taken
again at the true state. Then all fronts are counted.

A worker's table is bounded: when it is full it is dropped, and the batch is halved. A text
that is one endless word is run in segments, with the state carried by value over the drop.

Null and empty texts have no tokens. Strings of special tokens inside a text count as one
token each, as the library has it. Repeated rows are answered one by one; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import HELD, arrow_map, documents, id_and_text, texts

#: Bytes of a chunk and of a run-up, states at which a worker drops what it has compiled and begins again, and bytes of an endless word between looks at that bound.
CHUNK, WARM, STATES, SEGMENT = 256, 64, 240_000, 32_768
SPACE, LETTER, DIGIT, OTHER, MARK = range(5)  # kinds of characters; MARK stands for a special token's string
_WS = "\t-\r \x85\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


_SPACES = re.compile(f"[{_WS}]")
_BEYOND = re.compile("[\u1c89-\U0010ffff]")  # where letters newer than Python's tables begin


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_NOWHERE = (None, 0)


class Full(Exception):
    """The table has reached its bound."""


class Transducer:
    """Symbols are bytes, plus 256 for the last byte of a word. State 0 is the start."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(end) and len(token) > len(end)
            s = [letters[c] for c in (token[: -len(end)] if last else token)]
            return (*s[:-1], s[-1] + 256) if last else tuple(s)

        self.spelled: dict[tuple[int, ...], int] = {}
        self.tokens: list[tuple[int, ...]] = []
        self.ids: list[int] = []
        for t in model["vocab"]:
            if t not in self.special:
                self.spelled[symbols(t)] = len(self.tokens)
                self.tokens.append(symbols(t))
                self.ids.append(model["vocab"][t])
        number = lambda t: self.spelled[symbols(t)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merge = {(number(a), number(b)): (k, number(a + b)) for k, (a, b) in enumerate(merges)}
        self.real = [True] * len(self.tokens)  # does BPE make the token from its own bytes?
        self.made = [(-1, 0, 0)] * len(self.tokens)  # rank and parts of a token's last merge
        # a trie of the tokens, each node with its parent's longest suffix node (as in multi-pattern search)
        self.child: list[dict[int, int]] = [{}]
        self.depth, self.token_at = [0], [-1]
        for k, t in enumerate(self.tokens):
            if len(t) > 1:
                self.real[k] = self.encode(t) == [k]
                if not self.real[k]:
                    continue
                self.made[k] = self.final
            node = 0
            for s in t:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                node = self.child[node][s]
            self.token_at[node] = k
        self.fail, self.begins = [0] * len(self.child), {}
        todo = list(self.child[0].values())
        for node in todo:
            for s, to in self.child[node].items():
                f = self.fail[node]
                while f and s not in self.child[f]:
                    f = self.fail[f]
                self.fail[to] = self.child[f].get(s, 0) if node else 0
                todo.append(to)
        self.reset()

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """BPE of a few symbols: the first of the lowest merges, until there is none."""
        parts = [self.spelled[(s,)] for s in symbols]
        while len(parts) > 1:
            found = [(m[0], i, m[1]) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (m := self.merge.get(pair))]
            if not found:
                break
            rank, i, new = min(found)
            self.final = (rank, parts[i], parts[i + 1])
            parts[i : i + 2] = [new]
        return parts

    def beside(self, a: int, b: int) -> bool:
        """Whether BPE leaves two tokens side by side: going back in time, the later of both last merges is undone, and what then stands at the border must not have merged before it."""
        merge, made, before = self.merge.get, self.made, len(self.merge)
        while True:
            m = merge((a, b))
            if m is not None and m[0] < before:
                return False
            if made[a][0] > made[b][0]:
                before, _, a = made[a]
            elif made[b][0] >= 0:
                before, b = made[b][0] + 1, made[b][1]  # of equal ranks the left one merges first
            else:
                return True

    def reset(self) -> None:
        """Forgets all compiled states."""
        start = (0, ((-1, 0),))
        self.number: dict[tuple, int] = {start: 0}
        self.state: list[tuple] = [start]
        self.table(1 << 16)
        self.filled = 0

    def entry(self, state: tuple) -> int:
        """The number of a state that is given by value."""
        if state not in self.number:
            self.number[state] = len(self.state)
            self.state.append(state)
        return self.number[state]

    def table(self, size: int) -> None:
        """Transitions by code (state * 512 + symbol) in an open-addressing table: next state, tokens more, the token that ends with the symbol."""
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.code = np.full(size, -1, np.int64)
        self.next, self.emit = np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.last = np.zeros(size, np.uint16 if len(self.tokens) < 65_536 else np.int32)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code's slot (or the free slot where its search ended), and which ones are missing."""
        at = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        there = self.code[at]
        other = np.flatnonzero((there != codes) & (there >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.code) - 1)
            there[other] = self.code[at[other]]
            other = other[(there[other] != codes[other]) & (there[other] >= 0)]
        return at, there < 0

    def slots(self, codes: np.ndarray, bounded: bool) -> np.ndarray:
        """The slots of codes; missing transitions are compiled first."""
        at, missing = self.find(codes)
        if missing.any():
            self.compile(np.unique(codes[missing]), bounded)
            at, _ = self.find(codes)
        return at

    def compile(self, codes: np.ndarray, bounded: bool) -> None:
        """Adds transitions that are not there yet."""
        if bounded and len(self.state) > STATES:
            raise Full
        made = []
        for code in codes.tolist():
            to, more, last = self._step(self.state[code >> 9], code & 511)
            made.append((self.entry(to), more, last))
        add = codes, *(np.array(x) for x in zip(*made, strict=True))
        self.filled += len(codes)
        if self.filled * 5 > len(self.code) * 2:
            old = self.code >= 0
            add = tuple(np.concatenate(x) for x in zip(add, (self.code[old], self.next[old], self.emit[old], self.last[old]), strict=True))
            self.table(len(self.code) * 4)
        codes, rest = add[0], np.arange(len(add[0]))
        while len(rest):  # of those that want one free slot, one gets it
            at, _ = self.find(codes[rest])
            _, first = np.unique(at, return_index=True)
            at, now = at[first], rest[first]
            self.code[at], self.next[at], self.emit[at], self.last[at] = codes[now], add[1][now], add[2][now], add[3][now]
            rest = np.delete(rest, first)

    def _step(self, state: tuple, symbol: int) -> tuple[tuple, int, int]:
        """state: (trie node, for each of the places from the node's begin to now: (last token or -1 at a word's begin or None, tokens less now's))."""
        node, places = state
        while node and symbol not in self.child[node]:
            node = self.fail[node]
        node = self.child[node].get(symbol, 0)
        if not node:
            raise ValueError(f"no token for symbol {symbol}")
        depth, places = self.depth[node], places[len(places) - self.depth[node] :]
        at, last = node, None
        while at:
            t = self.token_at[at]
            if t >= 0:
                before = places[depth - self.depth[at]]
                if before[0] is not None and (before[0] == -1 or self.beside(before[0], t)):
                    last = t
                    break
            at = self.fail[at]
        if last is None:
            raise ValueError("no token may follow here")
        more = before[1] + 1
        if symbol >= 256:
            return self.state[0], more, last
        if node not in self.begins:  # only places where a token may begin that reaches beyond now
            kept, at = [False] * depth, node
            while at:
                kept[depth - self.depth[at]] = True
                at = self.fail[at]
            self.begins[node] = kept
        rest = [(p[0], p[1] - more) if k else _NOWHERE for k, p in zip(self.begins[node], places, strict=True)]
        return (node, (*rest, (last, 0))), more, last


_MADE: dict[str, Transducer] = {}
HELD["transducer"] = _MADE.clear


def transducer(path: str) -> Transducer:
    """One for each worker and vocabulary."""
    if path not in _MADE:
        _MADE[path] = Transducer(path)
    return _MADE[path]


_KINDS: list[np.ndarray] = []
_NEWER: dict[int, str] = {}  # lower case of letters that are newer than Python's tables


def kinds() -> np.ndarray:
    """The kind of each code point by the pattern's classes. The library is asked about letters and digits that Python's tables don't have yet."""
    if not _KINDS:
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(default_vocabulary())
        newer = regex.compile(r"[\p{L}\p{N}]")
        table = np.full(0x110000, OTHER, np.uint8)
        for k in range(0x110000):
            c = unicodedata.category(x := chr(k))
            if c[0] in "LN":
                table[k] = LETTER if c[0] == "L" else DIGIT
            elif c == "Cn" and newer.match(x):
                pieces = [len(library.pre_tokenizer.pre_tokenize_str(s)) for s in ("a" + x, "!" + x)]
                table[k] = LETTER if pieces[0] == 1 else DIGIT if pieces[1] == 2 else OTHER
                if (low := library.normalizer.normalize_str(x)) != x:
                    _NEWER[k] = low
        for m in _SPACES.finditer("".join(map(chr, range(0x3001)))):
            table[ord(m[0])] = SPACE
        _KINDS.append(table)
    return _KINDS[0]


def class_of(kind: int) -> str:
    """The characters of a kind as ranges for a character class."""
    at = np.flatnonzero(np.diff(np.concatenate(([0], kinds() == kind, [0]))))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(at[::2], at[1::2], strict=True))


def normal(text: str) -> str:
    """Composed and in lower case, character by character (str.lower() looks at a sigma's neighbours)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if _BEYOND.search(text):
        kinds()
        text = text.translate(_NEWER)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


def words(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All normal texts in one: bytes without white space, whether a word ends at each, and the first byte of each text (one more than texts)."""
    kind_of = kinds()
    joined = " ".join(batch)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = kind_of[points]
    before = np.concatenate(([SPACE], kind[:-1])).astype(np.uint8)
    begins = (kind != before) | (kind == DIGIT)
    quote = np.flatnonzero((points == 39) & (before != OTHER))
    if len(quote):
        padded = np.concatenate((points, np.zeros(2, np.uint32)))
        one, two = padded[quote + 1], padded[quote + 2]
        pair = lambda a, b: (one == ord(a)) & (two == ord(b))
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        size = np.where(pair("r", "e") | pair("v", "e") | pair("l", "l"), 3, size)
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False  # a contraction is one word, and what follows is another
        begins[quote[size == 3] + 2] = False
        after = quote + size
        begins[after[after < len(points)]] = True
    body = np.frombuffer(joined.encode(), np.uint8)
    lead = np.flatnonzero((body & 0xC0) != 0x80)
    text_of = np.concatenate(([0], np.cumsum([len(t) + 1 for t in batch])))  # in code points
    keep = np.repeat(kind != SPACE, np.diff(np.concatenate((lead, [len(body)]))))
    first = np.zeros(len(body) + 1, bool)
    first[lead] = begins
    first[len(body)] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    # a word ends where the next byte that is kept or not begins another run
    ends = first[1:][keep]
    starts = place[np.concatenate((lead, [len(body)]))[np.minimum(text_of, len(lead))]]
    return body[keep], ends, starts


def run(machine: Transducer, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, bounded: bool, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs lanes of symbols side by side from the given states: (states, tokens) at their ends. last: takes the token that ends with each symbol, and then tokens aren't counted."""
    order = np.argsort(-length, kind="stable")
    by_length, at, s = length[order], begin[order].copy(), state[order].astype(np.int64)
    total = np.zeros(len(order), np.int64)
    live = np.searchsorted(-by_length, -np.arange(int(by_length[0]) if len(order) else 0), side="left")
    for n in live:
        slot = machine.slots(s[:n] * 512 + symbols[at[:n]], bounded)
        if last is None:
            total[:n] += machine.emit[slot]
        else:
            last[at[:n]] = machine.last[slot]
        s[:n] = machine.next[slot]
        at[:n] += 1
    states, tokens = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
    states[order], tokens[order] = s, total
    return states, tokens


def run_endless(machine: Transducer, symbols: np.ndarray, last: np.ndarray | None = None) -> int:
    """The tokens of one sequence of symbols from the start state, whatever its length, with a table that stays bounded."""
    state, total = machine.state[0], 0
    for lo in range(0, len(symbols), SEGMENT):
        if len(machine.state) > STATES - 2 * SEGMENT:
            machine.reset()
        one = np.array([min(SEGMENT, len(symbols) - lo)])
        at, tokens = run(machine, symbols, np.array([lo]), one, np.array([machine.entry(state)]), False, last)
        state, total = machine.state[int(at[0])], total + int(tokens[0])
    return total


def encoded(machine: Transducer, body: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole words that lie one after another in `body` and end at `stop` (one at least), and how many of them come before each word and in all: the transducer's last tokens, read from each word's end backwards."""
    size = np.diff(stop, prepend=0)
    symbols = body.astype(np.int64)
    symbols[stop - 1] += 256
    last = np.zeros(len(symbols), np.int32)
    if len(stop) == 1:
        run_endless(machine, symbols, last)
    else:
        run(machine, symbols, stop - size, size, np.zeros(len(size), np.int32), True, last)
    if not hasattr(machine, "long"):
        machine.long, machine.id = np.array([len(t) for t in machine.tokens]), np.array(machine.ids, np.uint32)
    # `where` walks back; tokens are written where they begin, so that reading on gives them in order
    begins = np.zeros(len(symbols), bool)
    token = np.zeros(len(symbols), np.int32)
    where, first = stop - 1, stop - size
    while len(where):
        t = last[where]
        begin = where - machine.long[t] + 1
        begins[begin], token[begin] = True, t
        more = begin > first
        where, first = begin[more] - 1, first[more]
    return machine.id[token[begins]].astype("<u4"), np.concatenate(([0], np.cumsum(begins)))[np.concatenate(([0], stop))]


def _same_chain(linked: np.ndarray, span: int) -> np.ndarray:
    """Whether each place from `span` on is linked, step by step, to the one `span` before it."""
    breaks = np.concatenate(([0], np.cumsum(~linked)))
    return breaks[span + 1 :] == breaks[1 : len(breaks) - span]


def counted(machine: Transducer, batch: list[str], chunk: int = CHUNK, bounded: bool = True) -> np.ndarray:
    """The tokens of each normal text without special tokens' strings."""
    body, ends, starts = words(batch)
    n = len(body)
    if not n:
        return np.zeros(len(batch), np.int64)
    symbols = body.astype(np.int64) + 256 * ends
    # chunks of equal size, cut again where a text begins so that sums can be told apart
    cuts = np.unique(np.concatenate((np.arange(0, n, chunk), starts[(starts < n)], [n])))
    begin, length = cuts[:-1], np.diff(cuts)
    end_at = np.flatnonzero(ends)
    k = np.searchsorted(end_at, begin)  # the first word end inside each chunk, if any
    front = np.where(k < len(end_at), end_at[np.minimum(k, len(end_at) - 1)] + 1, n) - begin
    fixed = front <= length  # the map's value after the front doesn't depend on the state before it
    front = np.minimum(front, length)
    word_begins = np.concatenate(([True], ends[begin[1:] - 1]))
    front = np.where(word_begins, 0, front)  # entered in the start state: all of it runs at once
    fixed |= word_begins
    zero = np.zeros(len(begin), np.int32)
    out, tokens = run(machine, symbols, begin + front, length - front, zero, bounded)
    # a chunk that is entered inside a word takes the state that its predecessor leaves
    inner = np.flatnonzero(~word_begins & ~fixed)  # no word end inside: a map from state to state
    if len(inner):
        linked = np.isin(inner - 1, inner)  # behind another such chunk, whose exit isn't known yet
        entry = out[inner - 1].copy()
        warm = np.minimum(WARM, begin[inner[linked]])
        entry[linked] = run(machine, symbols, begin[inner[linked]] - warm, warm, np.zeros(len(warm), np.int32), bounded)[0]
        todo = np.arange(len(inner))
        while len(todo):
            out[inner[todo]], tokens[inner[todo]] = run(machine, symbols, begin[inner[todo]], length[inner[todo]], entry[todo], bounded)
            fits = ~linked | (out[inner - 1] == entry)
            span = 1
            while span < len(inner):  # composed: all maps from a chain's beginning on fit each other
                fits[span:] &= fits[:-span] | ~_same_chain(linked, span)
                span *= 2
            first = np.flatnonzero(~fits & np.concatenate(([True], fits[:-1])))  # of each chain the first that doesn't fit
            entry[first] = out[inner[first] - 1]
            todo = first
    front_of = np.flatnonzero(~word_begins & fixed)
    tokens[front_of] += run(machine, symbols, begin[front_of], front[front_of], out[front_of - 1], bounded)[1]
    sums = np.concatenate(([0], np.cumsum(tokens)))
    return np.diff(sums[np.searchsorted(begin, starts)])


def _summed(machine: Transducer, parts: list[str]) -> np.ndarray:
    """counted() of parts that may need more states than fit: they are halved, at white space within a text, and an endless word runs in segments."""
    try:
        return counted(machine, parts)
    except Full:
        machine.reset()
    if len(parts) > 1:
        half = len(parts) // 2
        return np.concatenate((_summed(machine, parts[:half]), _summed(machine, parts[half:])))
    text = parts[0].strip()
    if m := _SPACES.search(text, len(text) // 2) or _SPACES.search(text):
        return _summed(machine, [text[: m.start()]]) + _summed(machine, [text[m.end() :]])
    body, ends, _ = words([text])
    return np.array([run_endless(machine, body.astype(np.int64) + 256 * ends)])


def count_batch(batch: list[str], path: str) -> np.ndarray:
    """Tokens of each raw text, special tokens' strings counted as one each."""
    machine = transducer(path)
    special = re.compile("|".join(map(re.escape, machine.special))) if machine.special else None
    parts, of, extra = [], [], np.zeros(len(batch), np.int64)
    for i, text in enumerate(batch):
        if special and "<|" in text and (cut := special.split(text)) and len(cut) > 1:
            extra[i] = len(cut) - 1
            for x in cut:
                parts.append(normal(x))
                of.append(i)
        else:
            parts.append(normal(text))
            of.append(i)
    return extra + np.bincount(of, _summed(machine, parts), len(batch)).astype(np.int64)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Columns id, n_bytes (UTF-8) and n_tokens, one row for each row of `df`."""
    path = vocabulary or default_vocabulary()

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        raw = texts(batch.column(1))
        return {"id": batch.column(0), "n_bytes": [len(t.encode()) for t in raw], "n_tokens": pa.array(count_batch(raw, path))}

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, n_bytes long, n_tokens long", mb=2, keeps="transducer")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of count_tokens over all documents."""
    made = count_tokens(documents(spark, sf_dir))
    return made.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))

"""Secret scans by one combined deterministic automaton.

All rules' triggers (what a finding surely begins with) are compiled together, by subset
construction and minimisation, into one transition array, and one pass over the bytes tells
where a trigger of which rule ends. From such a place the trigger's backward automaton goes
to the leftmost beginning, and from there the rule's own automaton to the longest end; so
spans come from automata alone: leftmost, non-overlapping per kind, in code points. Findings
with too few characters are dropped after that, and what they cover isn't tried again.

Null and empty texts have no spans. Repeated rows are answered one by one. Other columns
are left out, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import lanes
from lodestrand.llm.automaton import Dfa, backward_automaton, match_automaton, search_automaton
from lodestrand.llm.common import arrow_map, id_and_text, parts, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `whole` is head and body, of which each finding's body has at least `least` characters; `trigger` is a beginning of each finding. None of them may be longer one way and shorter another from one place (alternatives aren't ranked: the longest counts)."""

    kind: str
    trigger: str
    body: str
    least: int = 1
    head: str = ""
    ignore_case: bool = False  # of trigger and head


_WORDS = r"(password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
#: The base rules come first, in the order in which kinds at one start are listed.
BASE = (
    Rule("assign", _WORDS + r"[A-Za-z0-9+/_.=-]", r"[A-Za-z0-9+/_.=-]+", 6, _WORDS, True),
    Rule("access", r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]+", 24),
)
#: Further shapes of well-known credentials.
MORE = (
    Rule("pem", r"-----BEGIN", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
Span = tuple[int, int, int]  # start, end, rule


@dataclass(frozen=True)
class Scanner:
    """The automata of rules; made once on the driver and sent to tasks (their size follows the rules only)."""

    rules: tuple[Rule, ...]
    search: Dfa
    back: tuple[Dfa, ...]
    head: tuple[Dfa | None, ...]
    body: tuple[Dfa, ...]

    def spans(self, data: bytes, ends: list[int], masks: list[int]) -> list[Span]:
        """The findings in a text's bytes, given where triggers end, by start and then by rule; places are bytes."""
        met: dict[int, list[int]] = defaultdict(list)
        for end, mask in zip(ends, masks, strict=True):
            for k in range(len(self.rules)):
                if mask >> k & 1:
                    met[k].append(end)
        out = []
        for k, own in met.items():
            after = 0
            for trigger_end in own:
                if trigger_end <= after:
                    continue
                start = self.back[k].furthest(data, trigger_end, after, -1)
                if start is None:
                    continue
                begin = start if self.head[k] is None else self.head[k].furthest(data, start, len(data), 1)
                end = self.body[k].furthest(data, begin, len(data), 1) if begin is not None else None
                if end is not None:
                    after = end
                    if end - begin >= self.rules[k].least:
                        out.append((start, end, k))
        return sorted(out, key=lambda s: (s[0], s[2]))

    def scan(self, column: pa.Array, lane: int = 512) -> dict[int, list[Span]]:
        """The findings of the rows of a text column that have some, in code points."""
        nexts, accepts = self.search.nexts, self.search.accepts
        resets = (nexts.reshape(-1, 256) == 0).all(0)
        body, at = utf8(column)
        n = len(column)
        joined = np.insert(body, at[1:], 10)  # a line end after every text
        begin = at[:-1] + np.arange(n)
        place, mask = lanes.scan(joined, lanes.cut(np.flatnonzero(resets[joined]), len(joined), lane), nexts, accepts)
        row = np.searchsorted(begin, place - 1, side="right") - 1
        out = {}
        for i in np.unique(row).tolist():
            lo, hi = np.searchsorted(row, [i, i + 1])
            data = body[at[i] : at[i + 1]].tobytes()
            if spans := self.spans(data, (place[lo:hi] - begin[i]).tolist(), mask[lo:hi].tolist()):
                if not data.isascii():
                    points = np.concatenate(([0], np.cumsum((body[at[i] : at[i + 1]] & 0xC0) != 0x80))).tolist()
                    spans = [(points[a], points[b], k) for a, b, k in spans]
                out[i] = spans
        return out


@cache
def compiled(rules: tuple[Rule, ...] = RULES) -> Scanner:
    search = search_automaton([(r.trigger, r.ignore_case) for r in rules])
    if not (search.nexts.reshape(-1, 256)[:, 10] == 0).all():
        raise ValueError("a trigger crosses lines, by which texts are set apart here")
    return Scanner(
        rules, search, tuple(backward_automaton(r.trigger, r.ignore_case) for r in rules),
        tuple(match_automaton(r.head, r.ignore_case) if r.head else None for r in rules), tuple(match_automaton(r.body) for r in rules),
    )


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, lane: int = 512) -> DataFrame:
    """Columns id and spans array<struct<kind, start, end, text>>, one row for each row of `df`."""
    scanner = compiled(rules)

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i, spans in scanner.scan(batch.column(1), lane).items():
            text = batch.column(1)[i].as_py()
            rows[i] = [{"kind": rules[k].kind, "start": a, "end": b, "text": text[a:b]} for a, b, k in spans]
        return {"id": batch.column(0), "spans": rows}

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, spans array<struct<kind string, start long, end long, text string>>")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All columns of `df`, with every finding in the text replaced by `mark`; overlapping findings are replaced as one. Null stays null."""
    scanner, names, schema = compiled(), df.columns, df.schema
    place = names.index(text_col)

    def run(batches):
        for whole in batches:
            named = whole.rename_columns([("text" if i == place else f"c{i}") for i in range(len(names))])
            for part in parts(named, 4 << 20):
                column = part.column(place)
                hit = scanner.scan(column)
                new = column.to_pylist() if hit else None
                for i, spans in hit.items():
                    new[i] = _masked(new[i], spans, mark)
                arrays = [pa.array(new, type=column.type) if i == place and new is not None else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(arrays, schema=whole.schema)

    return df.mapInArrow(run, schema)


def _masked(text: str, spans: list[Span], mark: str) -> str:
    out, end = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[end:a], mark]
        end = b
    return "".join([*out, text[end:]])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns of find_secrets over all documents."""
    from lodestrand.llm.common import documents

    found = find_secrets(documents(spark, sf_dir))
    base = [r.kind for r in BASE]
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda keep: F.array_join(F.transform(F.filter("spans", keep), text), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in base],
        F.sha2(of(lambda s: s["kind"].isin(base)), 256).alias("base_sha256"),
        of(lambda s: F.lit(True)).alias("spans"),
    )

"""Secret scans: one deterministic automaton for all rules, one pass over the bytes.

The rules' mirror images are compiled together (``automaton.py``), so that a single pass
from the last byte to the first marks, for every rule at once, the places where a match can
begin: repeats are counted to LOOSE there. Leftmost matches are then read off from left to
right, rule by rule, each confirmed and extended to its longest end by the rule's own small
automaton, which counts in full. The rules are such that the longest match is the greedy one.

The transition arrays are compiled on the driver (about two thousand states) and sent with the
task. Rows are independent: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.automaton import compile_rules, linked, longest
from tableops.llm.common import by_value, pick, whole_text


@dataclass(frozen=True)
class Rule:
    """``kind`` and ``pattern``. With ``head``, the value is what follows the head's longest
    match inside the match, and matches whose value is shorter than ``least`` are dropped
    after they have been taken. ``full``: the backward pass counts as the pattern says, so
    that every mark is a match. A rule needs it if a loosened mark can fail far behind its
    first byte; following many such marks would take quadratic time. Marks of the other
    rules fail within the bounded part that LOOSE shortened."""

    kind: str
    pattern: str
    head: str | None = None
    least: int = 0
    full: bool = False


LOOSE = 4
ASSIGN_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: Counts are part of the pattern where a shorter match could not have hidden another one:
#: runs of one alphabet, and the first AKIA of such a run.
BASE_RULES = (
    Rule("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", ASSIGN_HEAD, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]{20,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{20,}"),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", full=True),
)
RULES = BASE_RULES + MORE_RULES


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple:
    """Transition arrays: of all rules backwards, of each rule, of each head."""
    return (compile_rules([r.pattern for r in rules], backwards=True, anywhere=True,
                          loose=[None if r.full else LOOSE for r in rules]),
            [compile_rules([r.pattern]) for r in rules],
            [compile_rules([r.head]) if r.head else None for r in rules])


class Scanner:
    """Linked automata of ``rules``; ``spans`` gives byte spans of one text."""

    def __init__(self, rules: Sequence[Rule], tables: tuple):
        back, forward, heads = tables
        self.rules, self.back = rules, linked(back)[0]
        self.forward = [linked(t)[0] for t in forward]
        self.heads = [linked(t)[0] if t else None for t in heads]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(distance from the end, rules as bits) of all match starts, the last one first."""
        row, out = self.back, []
        for i, b in enumerate(reversed(data), 1):
            row = row[b]
            if row[256]:
                out.append((i, row[256]))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then by rule."""
        marks = self.starts(data)
        free = [0] * len(self.rules)
        out = []
        for back, bits in reversed(marks):
            start = len(data) - back
            while bits:
                k = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if start < free[k]:
                    continue
                end = longest(self.forward[k], data, start)
                if end < 0:
                    continue
                free[k] = end
                if self.heads[k] and free[k] - longest(self.heads[k], data, start) < self.rules[k].least:
                    continue
                out.append((start, k, free[k]))
        return out


def _characters(data: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte place: bytes that do not continue a character."""
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += sum(b & 0xC0 != 0x80 for b in data[at:p])
        at, out[p] = p, n
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text",
                 rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``df``: ``key`` and ``spans``, the places of secrets as (kind,
    start, end) in code points, the end exclusive, by start and then in the rules' order.

    Within a kind, spans are leftmost, longest and do not overlap; spans of different kinds
    may. NULL and empty texts have none. Rows with a NULL key and repeated rows are scanned
    like others, an empty table gives an empty result."""
    rules = tuple(rules)
    tables = compiled(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, tables)
        for batch in batches:
            found = []
            for value in batch.column(1):
                data = value.as_py()
                spans = scanner.spans(data)
                at = _characters(data, [p for s, _, e in spans for p in (s, e)]) if spans else {}
                found.append([{"kind": rules[k].kind, "start": at[s], "end": at[e]} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], names=[key, "spans"])

    base = pick(df, _key=key, _text=text).select("_key", F.encode(whole_text("_text"), "UTF-8").alias("_text"))
    return base.mapInArrow(scan, f"`{key}` {base.schema['_key'].dataType.simpleString()}, spans {SPANS}")


by_value("tableops.llm.automaton")
by_value(__name__)

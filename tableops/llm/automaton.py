"""Regular expressions over bytes compiled into one deterministic automaton.

Patterns are read with the standard library's parser, turned into a nondeterministic
automaton, made deterministic by subset construction and minimised by splitting blocks of
states until no byte tells two states of a block apart. A state is a row of 256 next rows
plus the set of accepted rules as bits, so that a scan is one list lookup a byte.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from collections import defaultdict
from collections.abc import Sequence


class Nfa:
    """States are integers; ``step[s]`` lists (byte set, target), ``free[s]`` empty moves."""

    def __init__(self):
        self.step: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _both_cases(chars: frozenset[int]) -> frozenset[int]:
    return chars | {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()}


def _byte_set(op, arg) -> frozenset[int]:
    if op is C.LITERAL:
        return frozenset([arg])
    if op is C.RANGE:
        return frozenset(range(arg[0], arg[1] + 1))
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    if op is C.NOT_LITERAL:
        return frozenset(range(256)) - {arg}
    if op is C.IN:
        if arg[0][0] is C.NEGATE:
            return frozenset(range(256)).difference(*[_byte_set(*a) for a in arg[1:]])
        return frozenset().union(*[_byte_set(*a) for a in arg])
    raise ValueError(f"not supported in a scan rule: {op}")


def add_pattern(nfa: Nfa, pattern: str, backwards: bool, loose: int | None = None) -> tuple[int, int]:
    """First and last state of ``pattern``, of its mirror image if ``backwards``. ``loose``:
    counts are followed up to that number only, so that more texts match."""

    def chain(items, any_case: bool, at: int) -> int:
        for op, arg in (reversed(list(items)) if backwards else items):
            at = part(op, arg, any_case, at)
        return at

    def part(op, arg, any_case: bool, at: int) -> int:
        if op is C.SUBPATTERN:
            _, on, off, inner = arg
            return chain(inner, (any_case or bool(on & C.SRE_FLAG_IGNORECASE)) and not off & C.SRE_FLAG_IGNORECASE, at)
        if op is C.BRANCH:
            end = nfa.state()
            for option in arg[1]:
                start = nfa.state()
                nfa.free[at].append(start)
                nfa.free[chain(option, any_case, start)].append(end)
            return end
        if op is C.MAX_REPEAT:
            least, most, inner = arg
            if loose is not None:
                least, most = min(least, loose), most if most <= loose else C.MAXREPEAT
            for _ in range(least):
                at = chain(inner, any_case, at)
            if most is C.MAXREPEAT:
                again = nfa.state()
                nfa.free[at].append(again)
                nfa.free[chain(inner, any_case, again)].append(again)
                return again
            ends = [at]
            for _ in range(most - least):
                at = chain(inner, any_case, at)
                ends.append(at)
            out = nfa.state()
            for e in ends:
                nfa.free[e].append(out)
            return out
        chars = _byte_set(op, arg)
        to = nfa.state()
        nfa.step[at].append((_both_cases(chars) if any_case else chars, to))
        return to

    first = nfa.state()
    return first, chain(parser.parse(pattern), False, first)


def _byte_classes(nfa: Nfa) -> tuple[list[int], list[int]]:
    """Class of each byte and one byte of each class; a class's bytes always act alike."""
    sets = list(dict.fromkeys(chars for moves in nfa.step for chars, _ in moves))
    of, sample = {}, []
    classes = []
    for b in range(256):
        mark = tuple(b in s for s in sets)
        if mark not in of:
            of[mark] = len(sample)
            sample.append(b)
        classes.append(of[mark])
    return classes, sample


def _minimised(moves: list[list[int]], accepts: list[int]) -> list[int]:
    """Block of each state in the coarsest partition that keeps accepted sets and moves."""
    block = accepts
    count = len(set(block))
    while True:
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[s], *[block[t] for t in row]), len(names)) for s, row in enumerate(moves)]
        if len(names) == count:
            return block
        count = len(names)


def compile_rules(patterns: list[str], backwards: bool = False, anywhere: bool = False,
                  loose: Sequence[int | None] | None = None) -> list[tuple[list[int], int]]:
    """The minimal automaton of all patterns, as (next state for each byte, accepted rules
    as bits); state 0 is the first. ``anywhere``: a match may begin at every byte. Runs
    counted side by side multiply the states; ``loose`` bounds what is counted, pattern by
    pattern (None: in full)."""
    nfa = Nfa()
    accept: dict[int, int] = defaultdict(int)
    starts = []
    for k, p in enumerate(patterns):
        first, last = add_pattern(nfa, p, backwards, loose[k] if loose else None)
        starts.append(first)
        accept[last] |= 1 << k
    classes, sample = _byte_classes(nfa)
    begin = nfa.closure(starts)
    index, todo, moves = {begin: 0}, [begin], []
    while todo:
        row = []
        for b in sample:
            reach = {t for s in todo[0] for chars, t in nfa.step[s] if b in chars}
            to = nfa.closure(reach | set(starts) if anywhere else reach)
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        moves.append(row)
        todo.pop(0)
    bits = [0] * len(index)
    for states, k in index.items():
        for s in states:
            bits[k] |= accept.get(s, 0)
    block = _minimised(moves, bits)
    out: dict[int, tuple[list[int], int]] = {}
    rename: dict[int, int] = {}
    for s in range(len(moves)):
        rename.setdefault(block[s], len(rename))
    for s in range(len(moves)):
        if rename[block[s]] not in out:
            row = [rename[block[t]] for t in moves[s]]
            out[rename[block[s]]] = ([row[c] for c in classes], bits[s])
    return [out[k] for k in range(len(out))]


def linked(states: list[tuple[list[int], int]]) -> list[list]:
    """Rows that hold the next rows themselves, the accepted bits at place 256 and whether
    the row can lead anywhere but to itself at 257."""
    rows: list[list] = [[] for _ in states]
    for k, (moves, bits) in enumerate(states):
        rows[k] += [rows[t] for t in moves] + [bits, any(t != k for t in moves) or bits != 0]
    return rows


def longest(first: list, data: bytes, start: int) -> int:
    """End of the longest match that begins at ``start``, or -1."""
    row, end = first, start if first[256] else -1
    for i in range(start, len(data)):
        row = row[data[i]]
        if row[256]:
            end = i + 1
        elif not row[257]:
            break
    return end

"""Rules compiled to one deterministic automaton over bytes: subset construction, minimisation, transition arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from re import _parser as parser  # the standard library's regular expression syntax trees
from re import _constants as kinds

import numpy as np


class Nfa:
    """Nodes with byte-set edges and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def node(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, nodes: set[int], stop: frozenset[int] = frozenset()) -> frozenset[int]:
        """All nodes that empty edges reach, without going on from those in `stop`."""
        todo, seen = [n for n in nodes if n not in stop], set(nodes)
        while todo:
            for n in self.empty[now] if (now := todo.pop()) not in stop else ():
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


def _either_case(b: int) -> set[int]:
    return {b, ord(chr(b).swapcase())} if chr(b).isalpha() and b < 128 else {b}


def _byte_set(items, fold: bool) -> frozenset[int]:
    found: set[int] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            span = (value, value)
        elif kind is kinds.RANGE:
            span = value
        else:
            raise ValueError(f"rules are written with ASCII literals and ranges, not {kind}")
        if span[1] > 127:
            raise ValueError("rules are written with ASCII characters")
        for b in range(span[0], span[1] + 1):
            found |= _either_case(b) if fold else {b}
    return frozenset(found)


def _build(nfa: Nfa, tree, start: int, fold: bool) -> int:
    """Add the syntax tree behind `start`; the node at which it ends."""
    for kind, value in tree:
        if kind in (kinds.LITERAL, kinds.IN):
            end = nfa.node()
            nfa.edges[start].append((_byte_set(value if kind is kinds.IN else [(kind, value)], fold), end))
            start = end
        elif kind is kinds.SUBPATTERN:
            start = _build(nfa, value[3], start, bool(fold or value[1] & parser.SRE_FLAG_IGNORECASE))
        elif kind is kinds.BRANCH:
            end = nfa.node()
            for option in value[1]:
                nfa.empty[_build(nfa, option, _after(nfa, start), fold)].append(end)
            start = end
        elif kind is kinds.MAX_REPEAT:
            least, most, body = value
            for _ in range(least):
                start = _build(nfa, body, start, fold)
            if most is kinds.MAXREPEAT:
                loop = _after(nfa, start)
                nfa.empty[_build(nfa, body, loop, fold)].append(loop)
                start = _after(nfa, loop)
            else:
                ends = [start]
                for _ in range(most - least):
                    start = _build(nfa, body, start, fold)
                    ends.append(start)
                start = nfa.node()
                for e in ends:
                    nfa.empty[e].append(start)
        else:
            raise ValueError(f"{kind} has no place in a byte automaton")
    return start


def _after(nfa: Nfa, node: int) -> int:
    new = nfa.node()
    nfa.empty[node].append(new)
    return new


def _byte_classes(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
    """Class of each byte, bytes of a class being in the same edges, and one byte of each class."""
    names: dict[tuple, int] = {}
    sets = list({s for edges in nfa.edges for s, _ in edges})
    of = [names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)]
    return np.array(of, np.uint8), [of.index(c) for c in range(len(names))]


@dataclass(frozen=True)
class Dfa:
    """`step[state][byte class]`; -1 is the end of every match. `marks[state]`: rules that end there."""

    classes: bytes  # a translation table from bytes to classes
    step: list[list[int]]
    marks: list[frozenset[int]]
    start: int


def determinise(nfa: Nfa, first: set[int], ends: dict[int, int], floating: bool) -> Dfa:
    """Subset construction, then merging of states until no two that remain behave alike.

    `ends` maps the final nodes to rules; `floating` lets a match begin at every byte and follows each rule
    only to its first possible end.
    """
    classes, sample = _byte_classes(nfa)
    done = {n: ends[e] for n in range(len(nfa.edges)) for e in nfa.closure({n}) & ends.keys()}
    stop = frozenset(done) if floating else frozenset()
    begin = nfa.closure(first, stop)
    states, todo, step = {begin: 0}, [begin], []
    while todo:
        now = todo.pop(0)
        row = []
        for b in sample:
            to = {t for n in now for s, t in nfa.edges[n] if b in s}
            to = nfa.closure(to | first if floating else to, stop)
            if not to:
                row.append(-1)
                continue
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        step.append(row)
    marks = [frozenset(done[n] for n in s if n in done) for s in states]
    return _minimise(bytes(classes), step, marks)


def _minimise(classes: bytes, step: list[list[int]], marks: list[frozenset[int]]) -> Dfa:
    names: dict = {}
    block = np.array([names.setdefault(m, len(names)) for m in marks])
    table = np.array(step)
    while True:
        to = np.where(table >= 0, block[table], -1)
        _, new = np.unique(np.column_stack((block, to)), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == block.max():
            break
        block = new
    chosen = [int(np.flatnonzero(block == b)[0]) for b in range(block.max() + 1)]
    return Dfa(
        classes, [[int(block[t]) if t >= 0 else -1 for t in step[s]] for s in chosen], [marks[s] for s in chosen], int(block[0])
    )


@dataclass(frozen=True)
class Rule:
    """A named pattern; `accept` looks at the matched bytes and drops what the pattern alone cannot."""

    name: str
    pattern: str
    accept: Callable[[bytes], bool] | None = None


class Scanner:
    """All rules in one pass over the bytes: leftmost longest matches of each rule that do not overlap.

    The combined automaton tells at which byte some rule's match can first end. From there the rule's own
    automata take over: backward, over reversed prefixes of the rule, to the first place from which a match
    is still open, then forward to the longest match from the earliest start that has one.
    """

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = list(rules)
        joint, first, ends = Nfa(), set(), {}
        self.forward, self.backward = [], []
        for k, rule in enumerate(self.rules):
            tree = parser.parse(rule.pattern)
            fold = bool(tree.state.flags & parser.SRE_FLAG_IGNORECASE)
            start = joint.node()
            first.add(start)
            ends[_build(joint, tree, start, fold)] = k
            own = Nfa()
            begin = own.node()
            last = _build(own, tree, begin, fold)
            self.forward.append(determinise(own, {begin}, {last: 0}, floating=False))
            back = Nfa()
            for _ in own.edges:
                back.node()
            for n, edges in enumerate(own.edges):
                for s, t in edges:
                    back.edges[t].append((s, n))
                for t in own.empty[n]:
                    back.empty[t].append(n)
            self.backward.append(determinise(back, set(range(len(own.edges))), {begin: 0}, floating=False))
        joint_dfa = determinise(joint, first, ends, floating=True)
        # States in which a rule ends get the highest numbers, so the pass compares one number per byte.
        order = sorted(range(len(joint_dfa.step)), key=lambda s: bool(joint_dfa.marks[s]))
        place = {s: i for i, s in enumerate(order)}
        self.classes = joint_dfa.classes
        self.table = [[place[t] for t in joint_dfa.step[s]] for s in order]
        self.marks = [tuple(joint_dfa.marks[s]) for s in order]
        self.start = place[joint_dfa.start]
        self.quiet = sum(not m for m in self.marks)

    def spans(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(rule, first byte, end byte) of all matches."""
        table, quiet, state = self.table, self.quiet, self.start
        done = [0] * len(self.rules)
        for i, c in enumerate(data.translate(self.classes)):
            state = table[state][c]
            if state >= quiet:
                for k in self.marks[state]:
                    if i >= done[k]:
                        match = self._match(k, data, done[k], i)
                        if match is None:  # it began inside the match before
                            continue
                        done[k] = match[1]
                        if self.rules[k].accept is None or self.rules[k].accept(data[match[0]:match[1]]):
                            yield k, *match

    def _match(self, k: int, data: bytes, floor: int, at: int) -> tuple[int, int] | None:
        back, state, begins = self.backward[k], self.backward[k].start, []
        for j in range(at, floor - 1, -1):
            state = back.step[state][back.classes[data[j]]]
            if state < 0:
                break
            if back.marks[state]:
                begins.append(j)
        for begin in reversed(begins):
            end = self._longest(k, data, begin)
            if end:
                return begin, end
        return None

    def _longest(self, k: int, data: bytes, begin: int) -> int:
        own, end = self.forward[k], 0
        state = own.start
        for j in range(begin, len(data)):
            state = own.step[state][own.classes[data[j]]]
            if state < 0:
                break
            if own.marks[state]:
                end = j + 1
        return end

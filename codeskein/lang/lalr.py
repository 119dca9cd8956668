"""LALR(1) tables from a grammar text, and a parser over strings of one-character token kinds.

A grammar is lines ``name : alternative | alternative``; a line without a name goes on with the one before. Words
are nonterminals if they have a line, else terminals; a quoted or unknown single character stands for itself.
``x?`` is optional, ``x*`` and ``x+`` are repetitions. The first name is the start. Where two actions compete, a
shift is preferred to a reduction and an earlier production to a later one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

END = "\x00"
_SPLIT = re.compile(r"[^;{}]*[;{}]|[^;{}]+\Z")
_MOST_REMEMBERED = 100_000


@dataclass
class Tables:
    """action[state][kind]: shift to state >= 0, or reduce by production ~x; goto[state][nonterminal]."""

    action: list[dict[str, int]]
    goto: list[dict[str, int]]
    productions: list[tuple[str, int]]
    conflicts: list[str] = field(default_factory=list)


def _productions(text: str) -> tuple[list[tuple[str, tuple[str, ...]]], set[str]]:
    rules: list[tuple[str, list[str]]] = []
    for line in text.strip().splitlines():
        line = line.split(" #")[0].strip()
        if not line:
            continue
        if m := re.match(r"(\w{2,})\s*:(?:\s|$)", line):
            rules.append((m[1], []))
            line = line[m.end() :]
        elif line.startswith("| "):
            line = line[2:]
        rules[-1][1].extend(x.strip() for x in re.split(r"(?:^|\s)\|(?:\s|$)", line))
    names = {n for n, _ in rules}
    found: dict[tuple[str, tuple[str, ...]], None] = {}

    def repeated(symbol: str) -> str:
        name = symbol + "+"
        if name not in names:
            names.add(name)
            found[name, (symbol,)] = None
            found[name, (name, symbol)] = None
        return name

    for name, alternatives in rules:
        for alternative in alternatives:
            forms: list[tuple[str, ...]] = [()]
            for word in alternative.split():
                if word[0] == word[-1] == "'":
                    word = word[1:-1]
                base, mark = (word[:-1], word[-1]) if len(word) > 1 and word[-1] in "?*+" else (word, "")
                symbol = repeated(base) if mark in ("*", "+") and mark else base
                forms = [f + (symbol,) for f in forms] + (list(forms) if mark in ("?", "*") and mark else [])
            for f in forms:
                found.setdefault((name, f), None)
    return [("@start", (rules[0][0],)), *found], names


def build(text: str) -> Tables:
    rules, names = _productions(text)
    by_name: dict[str, list[int]] = {}
    for k, (n, _) in enumerate(rules):
        by_name.setdefault(n, []).append(k)
    nullable: set[str] = set()
    first: dict[str, set[str]] = {n: set() for n in by_name}
    changed = True
    while changed:
        changed = False
        for n, body in rules:
            before = len(first[n]), n in nullable
            for s in body:
                first[n] |= first[s] if s in by_name else {s}
                if s not in nullable:
                    break
            else:
                nullable.add(n)
            changed |= before != (len(first[n]), n in nullable)

    def firsts(body: tuple[str, ...], then: set[str]) -> set[str]:
        out: set[str] = set()
        for s in body:
            out |= first[s] if s in by_name else {s}
            if s not in nullable:
                return out
        return out | then

    # LR(0) states, as their kernels
    def closure0(kernel: frozenset) -> set:
        items, todo = set(kernel), list(kernel)
        while todo:
            k, dot = todo.pop()
            body = rules[k][1]
            if dot < len(body) and body[dot] in by_name:
                for j in by_name[body[dot]]:
                    if (j, 0) not in items:
                        items.add((j, 0))
                        todo.append((j, 0))
        return items

    start = frozenset({(0, 0)})
    states, index, moves = [start], {start: 0}, []
    for kernel in states:
        out: dict[str, set] = {}
        for k, dot in closure0(kernel):
            body = rules[k][1]
            if dot < len(body):
                out.setdefault(body[dot], set()).add((k, dot + 1))
        moves.append({})
        for s in sorted(out):
            target = frozenset(out[s])
            if target not in index:
                index[target] = len(states)
                states.append(target)
            moves[-1][s] = index[target]

    # lookaheads: spontaneous ones and propagation, by a closure with a dummy
    look: dict[tuple[int, tuple[int, int]], set[str]] = {(s, item): set() for s, kernel in enumerate(states) for item in kernel}
    look[0, (0, 0)].add(END)
    passes: dict[tuple[int, tuple[int, int]], list] = {}

    def closure1(seed: dict) -> dict:
        items = {k: set(v) for k, v in seed.items()}
        todo = list(items)
        while todo:
            k, dot = todo.pop()
            body = rules[k][1]
            if dot < len(body) and body[dot] in by_name:
                ahead = firsts(body[dot + 1 :], items[k, dot])
                for j in by_name[body[dot]]:
                    have = items.setdefault((j, 0), set())
                    if not ahead <= have:
                        have |= ahead
                        todo.append((j, 0))
                    elif (j, 0) not in items:
                        todo.append((j, 0))
        return items

    for s, kernel in enumerate(states):
        for item in kernel:
            for (k, dot), ahead in closure1({item: {"#dummy"}}).items():
                body = rules[k][1]
                if dot < len(body):
                    to = moves[s][body[dot]], (k, dot + 1)
                    look[to] |= ahead - {"#dummy"}
                    if "#dummy" in ahead:
                        passes.setdefault((s, item), []).append(to)
    todo = list(look)
    while todo:
        at = todo.pop()
        for to in passes.get(at, ()):
            if not look[at] <= look[to]:
                look[to] |= look[at]
                todo.append(to)

    action: list[dict[str, int]] = []
    goto: list[dict[str, int]] = []
    conflicts = []
    for s, kernel in enumerate(states):
        act = {x: t for x, t in moves[s].items() if x not in by_name}
        goto.append({x: t for x, t in moves[s].items() if x in by_name})
        for (k, dot), ahead in sorted(closure1({item: look[s, item] for item in kernel}).items()):
            if dot == len(rules[k][1]):
                for a in sorted(ahead):
                    if a not in act:
                        act[a] = ~k
                    elif act[a] != ~k:
                        conflicts.append(f"{a!r} after {' '.join(rules[k][1])}: {'shift' if act[a] >= 0 else rules[~act[a]]} before {rules[k]}")
        action.append(act)
    return Tables(action, goto, [(n, len(body)) for n, body in rules], conflicts)


class Parser:
    """Runs the tables. What a stretch up to ``;``, ``{`` or ``}`` does to the stack depends only on the states it
    reads, so it is remembered by them: equal stretches in equal surroundings are derived once."""

    def __init__(self, tables: Tables):
        self.action, self.goto, self.productions = tables.action, tables.goto, tables.productions
        self.depth: dict[tuple[int, str], int] = {}
        self.known: dict[tuple, tuple[int, ...]] = {}

    def error_at(self, kinds: str) -> int:
        """Index of the first kind at which no parse can go on, ``len(kinds)`` for an early end, -1 if all is well."""
        stack, at = [0], 0
        depth, known = self.depth, self.known
        for part in [*_SPLIT.findall(kinds), END]:
            key = stack[-1], part
            d = depth.get(key)
            if d is not None:
                found = known.get((part, *stack[-d:]))
                if found is not None:
                    del stack[-d:]
                    stack.extend(found)
                    at += len(part)
                    continue
            bad = self._step(stack, part, key)
            if bad >= 0:
                return at + bad
            if part is END:
                break
            at += len(part)
        return -1

    def _step(self, stack: list[int], part: str, key: tuple[int, str]) -> int:
        before, low = list(stack), len(stack) - 1
        action, goto, productions = self.action, self.goto, self.productions
        for i, kind in enumerate(part):
            while True:
                act = action[stack[-1]].get(kind)
                if act is None:
                    return i
                if act >= 0:
                    stack.append(act)
                    break
                if act == -1:  # the start production: accepted
                    return -1
                name, n = productions[~act]
                if n:
                    del stack[-n:]
                low = min(low, len(stack) - 1)
                stack.append(goto[stack[-1]][name])
        if part is not END and len(part) < 400:
            if len(self.known) > _MOST_REMEMBERED:
                self.known.clear()
                self.depth.clear()
            d = max(self.depth.get(key, 0), len(before) - low)
            self.depth[key] = d
            self.known[(part, *before[-d:])] = tuple(stack[len(before) - d :] if d <= len(before) else stack)
        return -1

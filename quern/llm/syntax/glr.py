"""Generalised LR recognition from SLR(1) tables.

Grammars are text: "Name = alternatives ;" with 'literal' and UPPER terminals,
Name nonterminals, grouping, X? X* X+ and X % ',' (a separated list). Tables
are built from the LR(0) automaton with FOLLOW look-ahead; cells with several
actions are kept, and the recogniser follows all of them on linked stacks that
merge when they agree. There is no backtracking over tokens.

A grammar must not have hidden left recursion (an empty rule before itself).
"""

from __future__ import annotations

import re
from collections import defaultdict

END = "$end"
_TOKEN = re.compile(r"\s+|#[^\n]*|('(?:[^'\\]|\\.)+'|[A-Za-z_][A-Za-z_0-9]*|[=;|()?*+%])")


class Grammar:
    """Productions of a grammar text, without the shorthand."""

    def __init__(self, text: str, start: str):
        self.prods: list[tuple[str, tuple[str, ...]]] = []
        self.seen: dict[tuple, str] = {}
        self.named: set[str] = set()
        self.start = start
        tokens = self._scan(text)
        self.pos, self.tokens = 0, tokens
        self.prods.append(("$start", (start,)))
        while self.pos < len(tokens):
            name = self._next()
            assert self._next() == "=", name
            for alt in self._alternatives():
                self.prods.append((name, alt))
            assert self._next() == ";", name
        self.prods = list(dict.fromkeys(self.prods))
        self.nonterminals = {a for a, _ in self.prods}
        missing = {n for n in self.named if n not in self.nonterminals and not n.isupper()}
        assert not missing, f"undefined: {missing}"

    @staticmethod
    def _scan(text: str) -> list[str]:
        out, i = [], 0
        while i < len(text):
            m = _TOKEN.match(text, i)
            assert m, text[i : i + 40]
            if m[1]:
                out.append(m[1])
            i = m.end()
        return out

    def _peek(self) -> str:
        return self.tokens[self.pos] if self.pos < len(self.tokens) else ""

    def _next(self) -> str:
        self.pos += 1
        return self.tokens[self.pos - 1]

    def _helper(self, key: tuple, alts: list[tuple[str, ...]], name: str) -> str:
        if key not in self.seen:
            self.seen[key] = name
            self.prods += [(name, a) for a in alts]
        return self.seen[key]

    def _one(self, alts: list[tuple[str, ...]]) -> tuple[str, ...]:
        """A single sequence for the alternatives."""
        if len(alts) == 1:
            return alts[0]
        return (self._helper(("alt", *alts), alts, f"_G{len(self.seen)}"),)

    def _alternatives(self) -> list[tuple[str, ...]]:
        out = self._sequence()
        while self._peek() == "|":
            self._next()
            out += self._sequence()
        return out

    def _sequence(self) -> list[tuple[str, ...]]:
        bodies: list[tuple[str, ...]] = [()]
        while self._peek() not in (";", "|", ")", ""):
            t = self._next()
            if t == "(":
                item = self._alternatives()
                assert self._next() == ")"
            else:
                item = [(t[1:-1] if t[0] == "'" else t,)]
                if t[0] != "'":
                    self.named.add(t)
            while self._peek() in ("?", "*", "+", "%"):
                op = self._next()
                if op == "?":
                    item = [(), *item]
                elif op == "%":
                    sep = self._next()[1:-1]
                    x = self._one(item)
                    name = f"_L{len(self.seen)}"
                    item = [(self._helper(("sep", x, sep), [x, (name, sep, *x)], name),)]
                else:
                    x = self._one(item)
                    name = f"_R{len(self.seen)}"
                    many = (self._helper(("many", x), [x, (name, *x)], name),)
                    item = [many] if op == "+" else [(), many]
            bodies = [b + i for b in bodies for i in item]
        return bodies


class Table:
    """Action and goto tables; an action is a state (shift), ~production (reduce) or a tuple of several."""

    def __init__(self, text: str, start: str):
        g = Grammar(text, start)
        self.lhs = [a for a, _ in g.prods]
        self.size = [len(b) for _, b in g.prods]
        by = defaultdict(list)
        for i, (a, _) in enumerate(g.prods):
            by[a].append(i)
        first, nullable = self._first(g)
        follow = self._follow(g, first, nullable)
        closures: dict[str, frozenset] = {}

        def opened(sym: str) -> frozenset:
            if sym not in closures:
                todo, got = [sym], {sym}
                while todo:
                    for p in by[todo.pop()]:
                        body = g.prods[p][1]
                        if body and body[0] in g.nonterminals and body[0] not in got:
                            got.add(body[0])
                            todo.append(body[0])
                closures[sym] = frozenset((p, 0) for s in got for p in by[s])
            return closures[sym]

        kernel0 = frozenset([(0, 0)])
        states, order = {kernel0: 0}, [kernel0]
        self.action: list[dict] = []
        self.goto: list[dict] = []
        self.chains: dict[tuple[int, int, str], int] = {}
        for kernel in order:
            items = set(kernel)
            for p, d in kernel:
                body = g.prods[p][1]
                if d < len(body) and body[d] in g.nonterminals:
                    items |= opened(body[d])
            moves, acts = defaultdict(set), defaultdict(list)
            for p, d in items:
                a, body = g.prods[p]
                if d < len(body):
                    moves[body[d]].add((p, d + 1))
                elif p == 0:
                    acts[END].append(~0)
                else:
                    for t in follow[a]:
                        acts[t].append(~p)
            goto = {}
            for sym in sorted(moves):
                k = frozenset(moves[sym])
                if k not in states:
                    states[k] = len(order)
                    order.append(k)
                if sym in g.nonterminals:
                    goto[sym] = states[k]
                else:
                    acts[sym].append(states[k])
            self.action.append({t: (x[0] if len(x) == 1 else tuple(sorted(set(x), reverse=True))) for t, x in acts.items()})
            self.goto.append(goto)

    @staticmethod
    def _first(g: Grammar):
        first, nullable, changed = defaultdict(set), set(), True
        while changed:
            changed = False
            for a, body in g.prods:
                before = len(first[a]), a in nullable
                for s in body:
                    if s in g.nonterminals:
                        first[a] |= first[s]
                        if s not in nullable:
                            break
                    else:
                        first[a].add(s)
                        break
                else:
                    nullable.add(a)
                changed |= before != (len(first[a]), a in nullable)
        return first, nullable

    @staticmethod
    def _follow(g: Grammar, first, nullable):
        follow, changed = defaultdict(set), True
        follow["$start"].add(END)
        while changed:
            changed = False
            for a, body in g.prods:
                tail = set(follow[a])
                for s in reversed(body):
                    if s in g.nonterminals:
                        if not tail <= follow[s]:
                            follow[s] |= tail
                            changed = True
                        tail = tail | first[s] if s in nullable else set(first[s])
                    else:
                        tail = {s}
        return follow

    def chain(self, base: int, state: int, token: str) -> int:
        """The state over base after all reductions by single symbols that follow on the token."""
        while True:
            a = self.action[state].get(token)
            if a.__class__ is not int or a >= 0 or a == -1 or self.size[~a] != 1:
                return state
            state = self.goto[base][self.lhs[~a]]

    def advance(self, heads: list, token: str) -> list:
        """The stacks after token; none if it fits nowhere. A stack is (state, rest)."""
        action, goto, size, lhs = self.action, self.goto, self.size, self.lhs
        if len(heads) == 1:
            node = heads[0]
            while True:
                a = action[node[0]].get(token)
                if a is None:
                    return []
                if a.__class__ is tuple:
                    heads = [node]
                    break
                if a >= 0:
                    return [(a, node)]
                if a == -1:
                    return [node]
                p = ~a
                for _ in range(size[p]):
                    node = node[1]
                node = (goto[node[0]][lhs[p]], node)
        out, seen, todo = {}, {(n[0], id(n[1])) for n in heads}, list(heads)
        while todo:
            node = todo.pop()
            acts = action[node[0]].get(token)
            if acts is None:
                continue
            for a in acts if acts.__class__ is tuple else (acts,):
                if a >= 0:
                    out.setdefault((a, id(node)), (a, node))
                elif a == -1:
                    out[(-1, 0)] = node
                else:
                    p, base = ~a, node
                    for _ in range(size[p]):
                        base = base[1]
                    key = (goto[base[0]][lhs[p]], id(base))
                    if key not in seen:
                        seen.add(key)
                        todo.append((key[0], base))
        return list(out.values())


def recognise(table: Table, tokens, insert: str | None = None) -> tuple[int, str] | None:
    """None if the (type, line, may_insert) tokens are a sentence, else the line and type of the first token that fits nowhere.

    insert: a terminal put in before a token with may_insert that fits nowhere.
    While one stack lives it is followed without lists, and runs of reductions
    by single symbols, whose end depends on two states and the token only, are
    remembered.
    """
    action, goto, size, lhs, chains = table.action, table.goto, table.size, table.lhs, table.chains
    node, heads, line = (0, None), None, 1
    for kind, line, may in tokens:
        if heads is None:
            cur = node
            while True:
                state = cur[0]
                a = action[state].get(kind)
                if a.__class__ is not int:
                    break
                if a >= 0:
                    break
                p = ~a
                n = size[p]
                if n == 1:
                    base = cur[1]
                    key = (base[0], state, kind)
                    end = chains.get(key)
                    if end is None:
                        end = chains[key] = table.chain(base[0], state, kind)
                    cur = (end, base)
                else:
                    while n:
                        cur = cur[1]
                        n -= 1
                    cur = (goto[cur[0]][lhs[p]], cur)
            if a.__class__ is int:
                node = (a, cur)
                continue
            nxt = table.advance([cur], kind) if a is not None else []
            before = [node]
        else:
            nxt = table.advance(heads, kind)
            before = heads
        if not nxt and may and insert is not None:
            again = table.advance(before, insert)
            nxt = again and table.advance(again, kind)
        if not nxt:
            return line, kind
        if len(nxt) == 1:
            node, heads = nxt[0], None
        else:
            heads = nxt
    last = [node] if heads is None else heads
    nxt = table.advance(last, END)
    if not nxt and insert is not None:
        again = table.advance(last, insert)
        nxt = again and table.advance(again, END)
    return None if nxt else (line, END)

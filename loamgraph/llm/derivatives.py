"""Memoised parsing with derivatives.

A language is a term: nothing, the empty text, a token, alternatives, a sequence, a repetition, a named rule, or a term
that must not begin with certain tokens. The derivative of a term by a token is the language of what may follow it.
Terms are hash-consed, so equal languages are one number, and derivatives are memoised on (term, token) for the whole life
of a worker: after a while nearly every token of a new file is one dictionary lookup, as if by an automaton that is built as
needed. An empty derivative marks the token at which a text leaves the language; if the last derivative doesn't contain
the empty text, the text was cut off.

Grammars are written in a small notation: `rule = ... ;`, 'x' a token, UPPER a token class, lower a rule, `[x]` optional,
`{x}` any number, `(x | y)`, and `<!'a' 'b'> x` an x that doesn't begin with a or b. No rule may begin with itself.
"""

from __future__ import annotations

import re

EMPTY, EPS = 0, 1
MEMO_LIMIT = 1_500_000  # entries; beyond it they are made again, with the same results

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(<!)|([=|;\[\]{}()>]))")


class Grammar:
    def __init__(self, text: str, start: str) -> None:
        self.source, self.start_rule = text, start
        self.tokens: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.terms: list[tuple] = [("0",), ("1",)]
        self.known: dict[tuple, int] = {("0",): EMPTY, ("1",): EPS}
        self.memo: dict[int, int] = {}
        self.nulls: dict[int, bool] = {EMPTY: False, EPS: True}
        self.rules: dict[str, int] = {}
        self._parse(self.source)
        self.start = self.ref(self.start_rule)

    # terms
    def make(self, key: tuple) -> int:
        i = self.known.get(key)
        if i is None:
            i = self.known[key] = len(self.terms)
            self.terms.append(key)
        return i

    def token(self, name: str) -> int:
        return self.tokens.setdefault(name, len(self.tokens))

    def ref(self, name: str) -> int:
        return self.make(("ref", name))

    def alt(self, parts: list[int]) -> int:
        flat: set[int] = set()
        for p in parts:
            if p != EMPTY:
                t = self.terms[p]
                flat.update(t[1]) if t[0] == "|" else flat.add(p)
        if not flat:
            return EMPTY
        if len(flat) == 1:
            return next(iter(flat))
        return self.make(("|", tuple(sorted(flat))))

    def cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        t = self.terms[a]
        if t[0] == ".":
            return self.cat(t[1], self.cat(t[2], b))
        return self.make((".", a, b))

    def star(self, a: int) -> int:
        return EPS if a in (EMPTY, EPS) else self.make(("*", a))

    # notation
    def _parse(self, text: str) -> None:
        text = re.sub(r"(?m)#\s.*$", "", text)
        items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 40]!r}")
            items.append(m[1] or m[2] or m[3] or m[4])
            at = m.end()
        i = 0
        while i < len(items):
            name = items[i]
            if items[i + 1] != "=":
                raise ValueError(f"grammar: rule {name}")
            body, i = self._alternatives(items, i + 2)
            if items[i] != ";":
                raise ValueError(f"grammar: in {name} near {items[i - 3 : i + 3]}")
            self.rules[name] = self.alt([self.rules[name], body]) if name in self.rules else body
            i += 1

    def _alternatives(self, items: list[str], i: int) -> tuple[int, int]:
        parts = []
        while True:
            seq, i = self._sequence(items, i)
            parts.append(seq)
            if items[i] != "|":
                return self.alt(parts), i
            i += 1

    def _sequence(self, items: list[str], i: int) -> tuple[int, int]:
        parts = []
        while items[i] not in ("|", ";", "]", "}", ")"):
            x = items[i]
            if x == "<!":
                banned = []
                i += 1
                while items[i] != ">":
                    banned.append(self.token(items[i][1:-1]))
                    i += 1
                inner, i = self._item(items, i + 1)
                parts.append(self.make(("!", tuple(sorted(banned)), inner)))
            else:
                term, i = self._item(items, i)
                parts.append(term)
        out = EPS
        for p in reversed(parts):
            out = self.cat(p, out)
        return out, i

    def _item(self, items: list[str], i: int) -> tuple[int, int]:
        x = items[i]
        if x in "[{(":
            inner, i = self._alternatives(items, i + 1)
            return (self.alt([inner, EPS]) if x == "[" else self.star(inner) if x == "{" else inner), i + 1
        if x[0] == "'":
            return self.make(("t", self.token(x[1:-1].replace("\\", "")))), i + 1
        if x.isupper():
            return self.make(("t", self.token(x))), i + 1
        return self.ref(x), i + 1

    # languages
    def nullable(self, i: int) -> bool:
        v = self.nulls.get(i)
        if v is None:
            self.nulls[i] = False
            t = self.terms[i]
            k = t[0]
            if k == "|":
                v = any([self.nullable(x) for x in t[1]])
            elif k == ".":
                v = self.nullable(t[1]) and self.nullable(t[2])
            elif k == "*":
                v = True
            elif k == "ref":
                v = self.nullable(self.rules[t[1]])
            elif k == "!":
                v = self.nullable(t[2])
            else:
                v = False
            self.nulls[i] = v
        return v

    def derive(self, i: int, token: int) -> int:
        key = i << 10 | token
        v = self.memo.get(key)
        if v is not None:
            return v
        t = self.terms[i]
        k = t[0]
        if k == "t":
            v = EPS if t[1] == token else EMPTY
        elif k == ".":
            # walk the nullable front of a sequence without recursion on its tail
            parts, tail = [], i
            while True:
                tt = self.terms[tail]
                if tt[0] != ".":
                    parts.append(self.derive(tail, token))
                    break
                d = self.derive(tt[1], token)
                if d:
                    parts.append(self.cat(d, tt[2]))
                if not self.nullable(tt[1]):
                    break
                tail = tt[2]
            v = self.alt(parts)
        elif k == "|":
            v = self.alt([self.derive(x, token) for x in t[1]])
        elif k == "*":
            v = self.cat(self.derive(t[1], token), i)
        elif k == "ref":
            v = self.derive(self.rules[t[1]], token)
        elif k == "!":
            v = EMPTY if token in t[1] else self.derive(t[2], token)
        else:
            v = EMPTY
        if len(self.memo) > MEMO_LIMIT:  # within one odd file, too, nothing grows without bound but its terms
            self.memo.clear()
        self.memo[key] = v
        return v

    def fresh(self) -> int:
        """The start term; forgets what was memoised when it has grown too large."""
        if len(self.memo) > MEMO_LIMIT:
            self._reset()
        return self.start

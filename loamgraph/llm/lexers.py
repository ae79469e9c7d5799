"""From text to the tokens of `grammars`. A token that is no token of the language is ERR, which no language contains."""

from __future__ import annotations

import re
from collections.abc import Iterator

from loamgraph.llm.grammars import CONTEXTUAL, RESERVED

Token = tuple[str, int]  # kind, place

PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _".split())
PY_TOKEN = re.compile(
    r"[ \t\f]+|(?P<comment>#[^\r\n]*)|(?P<join>\\\r?\n)|(?P<newline>\r\n|\n|\r)|"
    r"(?P<string>(?:[rRuUbBfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?(?:'''|\"\"\"|'|\"))|"
    r"(?P<number>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]?)|"
    r"(?P<name>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])"
)
BLANK_LINE = re.compile(r"([ \t\f]*)(?:#[^\r\n]*)?(\r\n|\n|\r|\Z)")
INDENT = re.compile(r"[ \t\f]*")
MOST_OPEN, MOST_INDENTS = 200, 100  # limits of Python's own tokenizer
AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b|(?![\w])")


class Python:
    """`parts` collects the expressions inside formatted strings, as (start, end)."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.parts: list[tuple[int, int]] = []

    def tokens(self, at: int = 0, end: int | None = None, inside: bool = False) -> Iterator[Token]:
        text = self.text if end is None else self.text[:end]
        n, depth, stack, last = len(text), int(inside), [(0, 0)], "NEWLINE"
        if not inside and text.startswith("﻿"):
            at = 1
        match = PY_TOKEN.match
        fresh = not inside
        if "\0" in text:
            yield "ERR", text.index("\0")
            return
        while True:
            if fresh:
                while at < n:
                    m = BLANK_LINE.match(text, at)
                    if not m:
                        break
                    at = m.end()
                    if m[2] == "":
                        break
                fresh = False
                if at >= n:
                    break
                m = INDENT.match(text, at)
                col = alt = 0
                for c in m[0]:
                    if c == " ":
                        col, alt = col + 1, alt + 1
                    elif c == "\t":
                        col, alt = (col // 8 + 1) * 8, alt + 1
                    else:
                        col = alt = 0
                at = m.end()
                if (col == stack[-1][0]) != (alt == stack[-1][1]) or (col > stack[-1][0]) != (alt > stack[-1][1]):
                    yield "ERR", at
                    return
                if col > stack[-1][0]:
                    if len(stack) >= MOST_INDENTS:
                        yield "ERR", at
                        return
                    stack.append((col, alt))
                    yield "INDENT", at
                while col < stack[-1][0]:
                    stack.pop()
                    if col > stack[-1][0] or (col == stack[-1][0]) != (alt == stack[-1][1]) and col >= stack[-1][0]:
                        yield "ERR", at
                        return
                    yield "DEDENT", at
            if at >= n:
                break
            m = match(text, at)
            if not m:
                yield "ERR", at
                return
            kind = m.lastgroup
            start, at = at, m.end()
            if kind is None or kind == "comment":
                continue
            if kind == "join":
                if at >= n:
                    yield "ERR", start
                    return
                continue
            if kind == "newline":
                if depth == 0:
                    last = "NEWLINE"
                    yield last, start
                    fresh = True
                continue
            if kind == "name":
                w = m[0]
                last = w if w in PY_WORDS else "NAME"
            elif kind == "op":
                last = m[0]
                if last in ("(", "[", "{"):
                    depth += 1
                    if depth > MOST_OPEN + inside:
                        yield "ERR", start
                        return
                elif last in (")", "]", "}") and depth:
                    depth -= 1
            elif kind == "number":
                w = m[0]
                if (len(w) > 1 and w[0] == "0" and w[1] in "0123456789_" and w.strip("0_").isdigit()) or not AFTER_NUMBER.match(text, at):
                    yield "ERR", start
                    return
                last = "NUMBER"
            else:
                at = self.string_end(text, start, m[0])
                if at < 0:
                    yield "ERR", start
                    return
                last = "STRING"
            yield last, start
        if last != "NEWLINE" and not inside and depth == 0:
            yield "NEWLINE", n
        if depth == 0 or inside:
            for _ in stack[1:]:
                yield "DEDENT", n

    def string_end(self, text: str, start: int, opening: str) -> int:
        quote = opening.lstrip("rRuUbBfFtT")
        prefix = opening[: len(opening) - len(quote)].lower()
        i, n = start + len(opening), len(text)
        if "f" in prefix or "t" in prefix:
            return self.formatted_end(text, i, quote, "r" in prefix)
        if len(quote) == 3:
            while True:
                j = text.find(quote, i)
                if j < 0:
                    return -1
                k, slashes = j - 1, 0
                while k >= start + len(opening) and text[k] == "\\":
                    k, slashes = k - 1, slashes + 1
                if slashes % 2 == 0:
                    end = j + 3
                    break
                i = j + 1
        else:
            while i < n:
                c = text[i]
                if c == "\\":
                    i += 3 if text[i + 1 : i + 3] == "\r\n" else 2
                elif c == quote:
                    break
                elif c in "\r\n":
                    return -1
                else:
                    i += 1
            if i >= n:
                return -1
            end = i + 1
        body = text[start + len(opening) : end - len(quote)]
        if "b" in prefix and not body.isascii():
            return -1
        if "\\" in body and "r" not in prefix and re.search(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})" + (r"|u(?![0-9a-fA-F]{4})|U(?!(?:000|0010)[0-9a-fA-F]{4,5})|N(?!\{[^}]+\}))" if "b" not in prefix else ")"), body):
            return -1
        return end

    def formatted_end(self, text: str, i: int, quote: str, raw: bool, spec: bool = False) -> int:
        """The end of a formatted string; in a format specification (`spec`) the place of the closing brace."""
        n = len(text)
        while i < n:
            c = text[i]
            if spec and c == "}":
                return i
            if text.startswith(quote, i):
                return -1 if spec else i + len(quote)
            if c == "\\" and not (raw and text[i + 1 : i + 2] in "{}"):
                i += 2 if raw or text[i + 1 : i + 3] != "N{" else text.find("}", i) + 1 - i if text.find("}", i) > 0 else 2
                continue
            if c in "\r\n" and len(quote) == 1:
                return -1
            if c == "}":
                if not text.startswith("}}", i):
                    return -1
                i += 2
                continue
            if c == "{":
                if not spec and text.startswith("{{", i):
                    i += 2
                    continue
                i = self.replacement_end(text, i + 1, quote, raw)
                if i < 0:
                    return -1
                continue
            i += 1
        return -1

    def replacement_end(self, text: str, i: int, quote: str, raw: bool) -> int:
        start, depth, n = i, 0, len(text)
        while i < n:
            c = text[i]
            if c in "([{":
                depth += 1
            elif c in ")]" or (c == "}" and depth):
                depth -= 1
                if depth < 0:
                    return -1
            elif c in "'\"":
                m = re.compile(r"'''|\"\"\"|'|\"").match(text, i)
                k = i
                while k > start and text[k - 1] in "rRuUbBfFtT":
                    k -= 1
                opening = text[k : m.end()] if k == start or not (text[k - 1].isalnum() or text[k - 1] == "_") else m[0]
                i = self.string_end(text, m.end() - len(opening), opening)
                if i < 0:
                    return -1
                continue
            elif c == "#":
                return -1
            elif depth == 0 and c == "!" and text[i + 1 : i + 2] != "=":
                self.parts.append((start, i))
                m = re.compile(r"\s*[sra]\s*").match(text, i + 1)
                if not m or text[m.end() : m.end() + 1] not in (":", "}"):
                    return -1
                if text[m.end()] == "}":
                    return m.end() + 1
                j = self.formatted_end(text, m.end() + 1, quote, raw, True)
                return j + 1 if j >= 0 else -1
            elif depth == 0 and c == ":":
                self.parts.append((start, i))
                j = self.formatted_end(text, i + 1, quote, raw, True)
                return j + 1 if j >= 0 else -1
            elif depth == 0 and c == "}":
                self.parts.append((start, i))
                return i + 1
            elif depth == 0 and c == "=" and re.compile(r"=\s*[!:}]").match(text, i) and text[i - 1] not in "=!<>":
                self.parts.append((start, i))
                m = re.compile(r"=\s*").match(text, i)
                rest = text[m.end()]
                if rest == "}":
                    return m.end() + 1
                start = -1
                if rest == "!":
                    m2 = re.compile(r"!\s*[sra]\s*").match(text, m.end())
                    if not m2 or text[m2.end() : m2.end() + 1] not in (":", "}"):
                        return -1
                    if text[m2.end()] == "}":
                        return m2.end() + 1
                    j = self.formatted_end(text, m2.end() + 1, quote, raw, True)
                else:
                    j = self.formatted_end(text, m.end() + 1, quote, raw, True)
                return j + 1 if j >= 0 else -1
            i += 1
        return -1


JSON_TOKEN = re.compile(r'[ \t\r\n]+|(?P<string>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<word>true|false|null)(?!\w)|(?P<op>[\[\]{},:])')


def json_tokens(text: str) -> Iterator[Token]:
    at, n = (1 if text.startswith("﻿") else 0), len(text)
    while at < n:
        m = JSON_TOKEN.match(text, at)
        if not m:
            yield "ERR", at
            return
        k = m.lastgroup
        if k == "string":
            yield "STRING", at
        elif k == "number":
            yield "NUMBER", at
        elif k:
            yield m[0], at
        at = m.end()


JS_WORDS = frozenset(CONTEXTUAL) | frozenset(RESERVED)
JS_SPACE = re.compile(r"(?:[ \t\v\f\xa0﻿  -   　]+|//[^\n\r  ]*)+")
JS_TOKEN = re.compile(
    r"(?P<name>#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|\$|\\u[0-9a-fA-F]{4}|‌|‍)*)|"
    r"(?P<number>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|(?:0|[1-9](?:_?\d)*)n)|"
    r"(?P<string>\"(?:[^\"\\\n\r]++|\\(?:\r\n|[\s\S]))*+\"|'(?:[^'\\\n\r]++|\\(?:\r\n|[\s\S]))*+')|"
    r"(?P<op>\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|<<=|<=|<<|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|[-+*%&|^!~?:;,.=<(){}\[\]@])"
)
JS_BIGINT = re.compile(r"(?:0|[1-9](?:_?\d)*)n")
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]++|\\[^\n\r]|\[(?:[^\]\\\n\r]++|\\[^\n\r])*+\])++/([A-Za-z]*)")
TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
JSX_TEXT = re.compile(r"[^{}<>]+")
JSX_TAG = re.compile(r"[^\W\d][\w$-]*(?:[.:][^\W\d][\w$-]*)*")
JSX_ATTR = re.compile(r"\"[^\"]*\"|'[^']*'")

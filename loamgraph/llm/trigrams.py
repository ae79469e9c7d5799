"""Required trigrams of a regular expression, and an inverted trigram index over pieces of texts.

`required(pattern)` gives a formula that every matching text satisfies: trigrams joined by and/or, or True where nothing
is known. Two letters at a fixed distance, such as the dashes around eight digits, count as a trigram whose middle is the distance.
Letter case is folded, so it holds for patterns of either kind. The index is kept in segments (a batch of texts): for each
trigram that some pattern needs a posting list of pieces, as a bitmap. Rules are answered from the postings alone: within a
text the postings of its pieces are joined (a match may reach over pieces), then intersected and united as the formula says.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Formula = bool | str | tuple
MAX_STRINGS = 24
PIECE = 65_536
FAR, FARTHEST = 0xE000, 64  # the middle of a pair at a distance is this character and so many on
LIKE_ASCII = ("\u0130", "\u0131", "\u017f", "\u212a")  # fixed values: the letters that match an ASCII one when case is ignored


def _and(parts: list[Formula]) -> Formula:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list[Formula]) -> Formula:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Formula:
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else True


def _chars(items: list) -> set[str] | None:
    """The characters of a class, if few."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(seq) -> tuple[set[str] | None, Formula]:
    """(all strings the sequence can match, if few; a formula)."""
    known: set[str] | None = {""}
    run: set[str] = {""}
    parts: list[Formula] = []
    items = list(seq)
    for at, (op, arg) in enumerate(items):
        strings: set[str] | None = None
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN:
            strings = _chars(arg)
        elif op is C.SUBPATTERN:
            strings, f = _walk(arg[3])
            parts.append(f)
        elif op is C.BRANCH:
            both = [_walk(b) for b in arg[1]]
            parts.append(_or([f for _, f in both]))
            if all(s is not None for s, _ in both):
                strings = set().union(*(s for s, _ in both))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            s, f = _walk(inner)
            if low:
                parts.append(f)
            after = items[at + 1] if at + 1 < len(items) else (None, None)
            if low == high <= FARTHEST and s is None and len(inner) == 1 and inner[0][0] in (C.IN, C.ANY) and after[0] is C.LITERAL and run != {""} and all(run):
                parts.append(_or([f"{r[-1]}{chr(FAR + low + 1)}{chr(after[1]).lower()}" for r in sorted(run)]))
            if s is not None and high == low:
                strings = {""}
                for _ in range(low):
                    strings = {a + b for a in strings for b in s}
                    if len(strings) > MAX_STRINGS:
                        strings = None
                        break
            elif s is not None and (low, high) == (0, 1):
                strings = s | {""}
            elif s and low == 1:  # what came before touches the first repetition, the last one what comes after
                parts.append(_of_strings({a + b for a in run for b in s} if len(run) * len(s) <= MAX_STRINGS else run))
                run, known = s, None
                continue
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            strings = {""}
        joined = {a + b for a in run for b in strings} if strings is not None and strings else None
        if joined is not None and len(joined) <= MAX_STRINGS:
            run = joined
            known = {a + b for a in known for b in strings} if known is not None and strings is not None else None
            known = None if known is not None and len(known) > MAX_STRINGS else known
        else:
            parts.append(_of_strings(run))
            run, known = (strings if strings and len(strings) <= MAX_STRINGS else {""}), None
    parts.append(_of_strings(run))
    return known, _and(parts)


def required(pattern: str) -> Formula:
    return _walk(P.parse(pattern))[1]


def trigrams(f: Formula) -> set[str]:
    if isinstance(f, str):
        return {f}
    return set().union(*(trigrams(x) for x in f[1:])) if isinstance(f, tuple) else set()


class Index:
    """Segments and their answers. Text is looked at as UTF-8 bytes in ASCII lower case; a byte beyond ASCII counts as its lower
    seven bits, which may add a candidate but never loses one (patterns' literals are ASCII). A text with one of the four
    letters that match an ASCII one gets all postings."""

    def __init__(self, formulas: list[Formula]) -> None:
        self.formulas = formulas
        self.needed = sorted(set().union(*(trigrams(f) for f in formulas)))
        self.at = {t: i for i, t in enumerate(self.needed)}
        self.far = [(i, ord(t[0]), ord(t[1]) - FAR, ord(t[2])) for t, i in self.at.items() if ord(t[1]) >= FAR]
        self.table = np.full(1 << 21, -1, np.int16)
        for t, i in self.at.items():
            if ord(t[1]) < FAR:
                a, b, c = t.encode("ascii")
                self.table[a | b << 7 | c << 14] = i
        byte = np.arange(256)
        self.fold = np.where((byte >= 65) & (byte <= 90), byte + 32, byte & 127).astype(np.uint8)

    def segment(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each text, postings as [piece, trigram])."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        if not n:
            return np.zeros(0, np.int64), np.zeros((0, len(self.needed)), bool)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        sizes = np.diff(off)
        pieces = np.maximum(1, -(-sizes // PIECE))
        first = np.concatenate([[0], np.cumsum(pieces)])
        bits = np.zeros((int(first[-1]), len(self.needed)), bool)
        x = self.fold[raw]

        def post(where: np.ndarray, width: int, trigram) -> None:  # noqa: ANN001
            text = np.searchsorted(off, where, side="right") - 1
            inside = where + width <= off[text + 1]
            where, text = where[inside], text[inside]
            bits[first[text] + (where - off[text]) // PIECE, trigram[inside] if isinstance(trigram, np.ndarray) else trigram] = True

        for lo in range(0, max(0, len(x) - 2), 1 << 20):
            y = x[lo : lo + (1 << 20) + 2].astype(np.int32)
            hit = self.table[y[:-2] | y[1:-1] << 7 | y[2:] << 14]
            where = np.flatnonzero(hit >= 0)
            post(where + lo, 3, hit[where].astype(np.int64))
        for i, a, gap, b in self.far:
            if len(x) > gap:
                post(np.flatnonzero((x[:-gap] == a) & (x[gap:] == b)), gap + 1, i)
        for letter in LIKE_ASCII:
            for t in np.flatnonzero(np.asarray(pc.match_substring(texts, letter).fill_null(False))):
                bits[first[t] : first[t + 1]] = True
        return pieces, bits

    def masks(self, pieces: np.ndarray, postings: dict[str, np.ndarray]) -> np.ndarray:
        """Bit i of a text's mask: pattern i may match it. `postings` are boolean over pieces; a trigram without any may be missing."""
        n = len(pieces)
        if not n:
            return np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(pieces)[:-1]])
        none, known = np.zeros(n, bool), {}

        def value(f: Formula) -> np.ndarray:
            if f is True:
                return ~none
            if isinstance(f, str):
                if f not in known:
                    known[f] = np.logical_or.reduceat(postings[f], starts) if f in postings else none
                return known[f]
            return (np.logical_and if f[0] == "and" else np.logical_or).reduce([value(x) for x in f[1:]])

        return sum(value(f).astype(np.int64) << i for i, f in enumerate(self.formulas))

    def candidates(self, text: str) -> int:
        """The mask of one text."""
        pieces, bits = self.segment(pa.array([text.encode("utf-8", "replace").decode()]))
        return int(self.masks(pieces, {t: bits[:, i] for t, i in self.at.items()})[0])

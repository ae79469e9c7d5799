"""Layout statistics of texts, for a batch of texts at once: counts over bytes, runs and lines by array operations, so that a
text costs a few nanoseconds a byte and statistic. Whole texts are read; carriage returns are left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1_000_000  # bytes worked on at once; a longer text is one slice
LONG_RUN = 48
STATEMENT = re.compile(rb"^[ \t]*(?:def|class|import|from|if|for|while|return|function|export (?:default )?(?:function|class|async)|try|with|switch)\b|=>|\bfunction\b", re.M)
KEY_BLOCK = re.compile(rb"-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----", re.S)  # a key in a file says nothing about the file
FIRST_STATEMENT = re.compile(rb"^[ \t]*(?:async|class|const|def|export|for|from|function|if|import|let|return|switch|try|var|while|with)\b", re.M)
COMMENT = re.compile(rb"^[ \t]*(?:#|//|/\*|\*|<!--).*$", re.M)
FIELDS = {"chars": "bigint", "max_line": "bigint", "mean_line": "double", "lines": "bigint", "space": "double", "alnum": "double", "numbers": "double", "digits": "double", "encoded": "double", "escapes": "double", "numbered": "double", "shapes": "double", "statements": "bigint"}


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
LETTER, DIGIT, NAME = _class(_LETTERS + "_$"), _class(_DIGITS), _class(_LETTERS + _DIGITS + "_$")
DOTTED, ALNUM, BLANK = _class(_LETTERS + _DIGITS + "_$."), _class(_LETTERS + _DIGITS), _class(" \t\n\f\v")
SPACE, CODED, HEX = _class(" \t\n"), _class(_LETTERS + _DIGITS + "+/=_-"), _class(_DIGITS + "abcdefABCDEF")
SHAPE = np.minimum(np.arange(256) + 3, 255).astype(np.uint8)  # no UTF-8 text has the last bytes
SHAPE[LETTER], SHAPE[DIGIT | _class(".")] = 1, 2


@dataclass(frozen=True)
class Layout:
    stats: dict[str, np.ndarray]
    bodies: list[bytes]  # 16 bytes of hash of the code without white space and comment lines
    preambles: list[str]  # comment lines before the first statement
    tails: list[str]  # the comment block after all code


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of a batch of at most `SLICE` bytes, or of one text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and size + n > SLICE:
            yield texts.slice(lo, i - lo)
            lo, size = i, 0
        size += int(n)
    if len(sizes) > lo:
        yield texts.slice(lo)


def _runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of a class; none reaches over the first byte of a text."""
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | first))
    stop = np.flatnonzero(before & (~inside | first))
    return start, np.concatenate([stop, [len(inside)]])[: len(start)]


def measured(texts: pa.Array) -> Layout:
    """The layout of each text; a null one counts as empty."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\r", "").cast(pa.large_binary())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = (texts.buffers()[2] or b"")[off[0] : off[-1]] if n else b""
    raw = raw.to_pybytes() if isinstance(raw, pa.Buffer) else bytes(raw)
    x, off = np.frombuffer(raw, np.uint8), off - off[0]
    a, b = off[:-1], off[1:]
    each = [raw[i:j] for i, j in zip(a, b)]
    first = np.zeros(len(x) + 1, bool)
    first[a] = True
    first = first[:-1]
    kind = np.int32 if len(x) < 2**31 else np.int64
    sums = lambda mask: np.concatenate([np.zeros(1, kind), np.cumsum(mask, dtype=kind)])

    def per(mask: np.ndarray) -> np.ndarray:
        c = sums(mask)
        return c[b] - c[a]

    def owned(places: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """How many places, or how much, of each text."""
        return np.bincount(np.searchsorted(off, places, side="right") - 1, weights, n)[:n] if len(places) else np.zeros(n)

    lead = sums((x & 0xC0) != 0x80)
    chars = (lead[b] - lead[a]).astype(np.int64)
    size = np.maximum(chars, 1)
    # lines
    at = np.flatnonzero(x == 10)
    of = np.searchsorted(off, at, side="right") - 1
    text = np.concatenate([np.arange(n), of])
    start, end = np.concatenate([a, at + 1]), np.concatenate([b, at])
    order = np.lexsort((start, text))
    line_text, line_start, line_end = text[order], start[order], end[np.lexsort((end, text))]
    line_chars = lead[line_end] - lead[line_start]
    seen = ~BLANK[x]
    csum = sums(seen)
    full = csum[line_end] > csum[line_start]
    lines = np.bincount(line_text[full], minlength=n)[:n]
    longest = np.maximum.reduceat(line_chars, np.searchsorted(line_text, np.arange(n))) if n else np.zeros(0, np.int64)
    # literals and names
    s, e = _runs(DOTTED[x], first)
    letters, dots = sums(LETTER[x] & (x != 95)), sums(x == 46)
    number = DIGIT[x[s]] & (letters[e] == letters[s]) & (dots[e] - dots[s] <= 1) & (x[e - 1] != 46) if len(s) else np.zeros(0, bool)
    numbers = owned(s[number])
    del letters, dots
    s, e = _runs(NAME[x], first)
    turn = DIGIT[x] & np.concatenate([[False], LETTER[x[:-1]]]) & ~first
    turns = sums(turn)
    name = LETTER[x[s]] if len(s) else np.zeros(0, bool)
    numbered = name & (turns[e] - turns[s] == 1)
    names, with_number = owned(s[name]), owned(s[numbered])
    del turn, turns
    # encoded runs, outside key blocks, and escapes
    coded = CODED[x]
    if b"-----BEGIN" in raw:
        for i, t in enumerate(each):
            for m in KEY_BLOCK.finditer(t):
                coded[a[i] + m.start() : a[i] + m.end()] = False
    s, e = _runs(coded, first)
    long = e - s >= LONG_RUN
    encoded = owned(s[long], (e - s)[long].astype(float))
    p = np.flatnonzero((x[:-3] == 92) & (x[1:-2] == 120)) if len(x) > 3 else np.zeros(0, np.int64)
    escapes = owned(p[HEX[x[p + 2]] & HEX[x[p + 3]]])
    # different shapes of lines: names and numbers as one sign each
    sign = SHAPE[x]
    keep = np.flatnonzero(((sign > 2) | (sign != np.concatenate([[0], sign[:-1]])) | first) & (x != 10)) if len(x) else np.zeros(0, np.int64)
    line = np.searchsorted(line_start, keep, side="right") - 1
    keep, line = keep[full[line]], line[full[line]]
    shapes = np.zeros(n)
    if len(keep):
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        place = np.arange(len(keep)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(keep)]])))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
            v = sign[keep].astype(np.uint64)
            v = (v * np.uint64(0xBF58476D1CE4E5B9) ^ (v << np.uint64(17))) * power[place]
            h = np.add.reduceat(v, begin)
            owner = line_text[line[begin]]
            h = (h ^ (h >> np.uint64(29))) + owner.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        _, one = np.unique(h, return_index=True)
        shapes = np.bincount(owner[one], minlength=n)[:n].astype(float)
        del place, v, power
    del keep, line, sign
    # comment lines; code without them
    places = np.flatnonzero(seen)
    head = np.searchsorted(places, line_start)
    at = places[np.minimum(head, max(0, len(places) - 1))] if len(places) else np.zeros(len(line_start), np.int64)
    y = np.concatenate([x, np.zeros(4, np.uint8)])
    hash_or_slashes = full & ((y[at] == 35) | ((y[at] == 47) & (y[at + 1] == 47)))
    comment = hash_or_slashes | (full & (((y[at] == 47) & (y[at + 1] == 42)) | (y[at] == 42) | ((y[at] == 60) & (y[at + 1] == 33) & (y[at + 2] == 45) & (y[at + 3] == 45))))
    mark = np.zeros(len(x) + 1, np.int32)
    np.add.at(mark, line_start[hash_or_slashes], 1)
    np.add.at(mark, line_end[hash_or_slashes], -1)
    code = seen & (np.cumsum(mark)[:-1] == 0)
    kept, ends = x[code].tobytes(), sums(code)
    bodies = [blake2b(kept[ends[i] : ends[j]], digest_size=16).digest() for i, j in zip(a, b)]
    real = np.flatnonzero(full & ~comment)
    last = np.searchsorted(line_text[real], np.arange(n), side="right") - 1
    preambles, tails = [], []
    for i, t in enumerate(each):
        m = FIRST_STATEMENT.search(t)
        preambles.append(b"\n".join(COMMENT.findall(t[: m.start()] if m else t)).decode("utf-8", "replace"))
        has = last[i] >= 0 and line_text[real[last[i]]] == i
        tails.append(t[line_end[real[last[i]]] - a[i] :].decode("utf-8", "replace") if has else "")
    stats = {
        "chars": chars, "max_line": longest, "mean_line": chars / np.maximum(lines, 1), "lines": lines, "space": per(SPACE[x]) / size, "alnum": per(ALNUM[x]) / size, "numbers": numbers * 10 / size, "digits": per(DIGIT[x]) / size,
        "encoded": encoded / size, "escapes": escapes * 4 / size, "numbered": with_number / np.maximum(names, 1), "shapes": shapes / np.maximum(lines, 1), "statements": np.array([len(STATEMENT.findall(t)) for t in each], np.int64),
    }
    return Layout(stats, bodies, preambles, tails)

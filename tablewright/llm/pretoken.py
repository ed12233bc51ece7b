"""Byte-level pre-tokenisation as a scan over transition functions, without a regex engine.

The split that byte-level vocabularies use (contractions, an optional space before letters, numbers
or other signs, white space that leaves its last character to what follows) is a small automaton
over character classes. Every character becomes a function from state to state. Functions compose
associatively, so the state before each character comes from a doubling scan; a function that no
longer depends on its input state is final, and almost all are after two or three rounds.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

# States: what the token that is open after a character looks like.
LETTERS, NUMBERS, OTHERS, SPACES, LEAD, CLOSED, ONE_MORE, TWO_MORE = range(8)
# Symbols: the class of a character together with what follows it.
LETTER, NUMBER, OTHER, SPACE_RUN, SPACE_LEAD, SPACE_LAST, MARK_1, MARK_2 = range(8)
FIRST = 8  # added to the symbol of the first character of a text

# Classes of single characters.
C_OTHER, C_LETTER, C_NUMBER, C_SPACE, C_BLANK, C_END = range(6)

# White space as in Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that newer Unicode tables assign and Python's may not yet have.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
# What may follow an apostrophe at the start of a token.
ENDINGS_1 = "stmd"
ENDINGS_2 = ["re", "ve", "ll"]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, C_OTHER, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = C_LETTER
        elif kind == "N":
            table[code] = C_NUMBER
    for ranges, kind in ((NEW_LETTERS, C_LETTER), (NEW_NUMBERS, C_NUMBER)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[WHITE_SPACE] = C_SPACE
    table[0x20] = C_BLANK
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character, and whether a token begins at it."""
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (CLOSED if state == ONE_MORE else ONE_MORE), False
        return LETTERS, state not in (LETTERS, LEAD)
    if symbol == NUMBER:
        return NUMBERS, state not in (NUMBERS, LEAD)
    if symbol in (OTHER, MARK_1, MARK_2):
        if state in (OTHERS, LEAD):
            return OTHERS, False
        return {OTHER: OTHERS, MARK_1: ONE_MORE, MARK_2: TWO_MORE}[symbol], True
    if symbol == SPACE_RUN:
        return SPACES, state != SPACES
    return (LEAD if symbol == SPACE_LEAD else CLOSED), True


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol; products of functions; constant value or 255; begin flags."""
    base = []
    begins = np.zeros((8, 16), dtype=bool)
    for symbol in range(16):
        if symbol < FIRST:
            base.append(tuple(_step(s, symbol)[0] for s in range(8)))
            begins[:, symbol] = [_step(s, symbol)[1] for s in range(8)]
        else:
            base.append((_step(CLOSED, symbol - FIRST)[0],) * 8)
            begins[:, symbol] = True
    known = {f: i for i, f in enumerate(dict.fromkeys(base))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in base:
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    every = list(known)
    product = np.array([[known.get(tuple(g[x] for x in f), 0) for g in every] for f in every], dtype=np.uint8)
    value = np.array([f[0] if len(set(f)) == 1 else 255 for f in every], dtype=np.uint8)
    return np.array([known[f] for f in base], dtype=np.uint8), product, value, begins


def _symbols(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(codes)
    table = classes()
    kind = table[codes]
    after = np.full(n, C_END, dtype=np.uint8)
    after[:-1] = kind[1:]
    after[starts[1:] - 1] = C_END
    # symbol by class and next class
    grid = np.empty((6, 6), dtype=np.uint8)
    grid[C_OTHER], grid[C_LETTER], grid[C_NUMBER], grid[C_END] = OTHER, LETTER, NUMBER, OTHER
    grid[C_SPACE], grid[C_BLANK] = SPACE_LAST, SPACE_LEAD
    grid[C_SPACE:C_END, [C_SPACE, C_BLANK, C_END]] = SPACE_RUN
    symbol = grid.ravel()[kind * np.uint8(6) + after]
    marks = np.flatnonzero((codes == 0x27) & (after == C_LETTER))
    if len(marks):
        one = codes[marks + 1]
        symbol[marks[np.isin(one, [ord(x) for x in ENDINGS_1])]] = MARK_1
        inside = marks + 2 < n
        inside[inside] &= after[marks[inside] + 1] == C_LETTER
        pairs = marks[inside]
        both = codes[pairs + 1].astype(np.uint64) << np.uint64(32) | codes[pairs + 2]
        symbol[pairs[np.isin(both, np.array([ord(a) << 32 | ord(b) for a, b in ENDINGS_2], dtype=np.uint64))]] = MARK_2
    symbol[starts] += FIRST
    return symbol


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where tokens begin in code points of texts laid end to end; starts: first positions of non-empty texts."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    base, product, value, begins = automaton()
    symbol = _symbols(codes, starts)
    reach = base[symbol]
    open_at = np.flatnonzero(value[reach] == 255)
    step = 1
    while len(open_at):
        made = product[reach[open_at - step], reach[open_at]]
        reach[open_at] = made
        open_at = open_at[value[made] == 255]
        step *= 2
    before = np.empty(n, dtype=np.uint8)
    before[0] = CLOSED
    before[1:] = value[reach[:-1]]
    return np.flatnonzero(begins.ravel()[before * np.uint8(16) + symbol])


def cuts(data: bytes, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts laid end to end: the text, where tokens begin in code points and in bytes (both with the end), and for each text the index of its first token (len + 1)."""
    text = data.decode("utf-8")
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    raw = np.frombuffer(data, dtype=np.uint8)
    narrow = len(codes) == len(raw)
    if narrow:
        at = offsets
    else:
        head = (raw & 0xC0) != 0x80
        heads = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(head, out=heads[1:])
        at = heads[offsets]
    starts = np.unique(at[:-1][np.diff(at) > 0])
    cut = boundaries(codes, starts)
    first = np.searchsorted(cut, at)
    places = cut if narrow else np.flatnonzero(head)[cut]
    return text, np.append(cut, len(codes)), np.append(places, len(raw)), first


def split(data: bytes, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The tokens of UTF-8 texts laid end to end, and for each text the index of its first token (len + 1)."""
    text, cut, _, first = cuts(data, offsets)
    at = cut.tolist()
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)], first

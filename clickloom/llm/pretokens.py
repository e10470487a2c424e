"""Pre-token boundaries without a regular expression.

Characters become classes, classes become transition functions of a small automaton over the open
pre-token, and the functions are composed: within blocks of text all blocks at once, then from
block to block. Composition is associative, so the blocks can be of any length and in any batch.
A boundary follows from the state before a character, its class and whether a space run goes on.

The automaton is that of the pattern which the rank files use: contractions, an optional space
before letters, digits or other signs, and runs of white space that leave their last character
to what follows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from unicodedata import category

import numpy as np

# Classes of characters. An apostrophe that begins a contraction of one or two letters gets a class
# of its own; RESET stands between two texts.
LETTER, NUMBER, SIGN, SPACE, BLANK, SHORT, LONG, RESET = range(8)
# States: what the open pre-token is; TWO and ONE are contractions still lacking so many letters.
IN_LETTERS, IN_NUMBERS, IN_SIGNS, IN_SPACE, IN_BLANK, TWO, ONE, CLOSED = range(8)
STATES = 8

# Fixed values of the pattern: white space, and what may follow an apostrophe.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# What Unicode 16.0 adds to letters and numbers of 15.1, as first and last code point.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

CODE_POINTS = 0x110000
LONGEST_BLOCK = 256
# Characters scanned at a time; a longer text carries its state over.
CHUNK = 1 << 19
SEPARATOR = np.uint32(CODE_POINTS)


@lru_cache(maxsize=1)
def classes_of_code_points() -> np.ndarray:
    """The class of every code point; the last entry belongs to the separator of texts."""
    table = np.full(CODE_POINTS + 1, SIGN, np.uint8)
    table[SEPARATOR] = RESET
    major = np.array([ord(category(chr(point))[0]) for point in range(CODE_POINTS)], np.uint8)
    table[:CODE_POINTS][major == ord("L")] = LETTER
    table[:CODE_POINTS][major == ord("N")] = NUMBER
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[list(WHITE_SPACE)] = BLANK
    table[0x20] = SPACE
    return table


@lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """State after a character of a class, by class and state before."""
    table = np.empty((8, STATES), np.uint8)
    table[LETTER] = IN_LETTERS
    table[LETTER, TWO] = ONE
    table[LETTER, ONE] = CLOSED
    table[NUMBER] = IN_NUMBERS
    table[SIGN] = IN_SIGNS
    table[SPACE] = IN_SPACE
    table[BLANK] = IN_BLANK
    for kind, state in ((SHORT, ONE), (LONG, TWO)):
        table[kind] = state
        table[kind, [IN_SIGNS, IN_SPACE]] = IN_SIGNS
    table[RESET] = CLOSED
    return table


@lru_cache(maxsize=1)
def breaks() -> np.ndarray:
    """Whether a pre-token begins at a character, by class and state before. White space within a
    run is decided apart, as it depends on the character after it."""
    table = np.ones((8, STATES), bool)
    table[LETTER, [IN_LETTERS, IN_SPACE, TWO, ONE]] = False
    table[NUMBER, [IN_NUMBERS, IN_SPACE]] = False
    for kind in (SIGN, SHORT, LONG):
        table[kind, [IN_SIGNS, IN_SPACE]] = False
    for kind in (SPACE, BLANK):
        table[kind, [IN_SPACE, IN_BLANK]] = False
    return table


def states_before(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each symbol, and the one after the last, by composed transitions."""
    step = transitions().ravel()
    length = min(LONGEST_BLOCK, max(8, math.isqrt(len(symbols))))
    blocks = -(-len(symbols) // length)
    padded = np.full(blocks * length, RESET, np.uint8)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, length).T).astype(np.intp) * STATES
    # The function of each block: the state after it for every state before it.
    function = np.broadcast_to(np.arange(STATES), (blocks, STATES))
    for column in columns:
        function = step[column[:, None] + function]
    entry = np.empty(blocks, np.intp)
    for block, table in enumerate(function.tolist()):
        entry[block] = state
        state = table[state]
    before = np.empty((length, blocks), np.uint8)
    for at, column in enumerate(columns):
        before[at] = entry
        entry = step[column + entry]
    flat = before.T.ravel()[: len(symbols)]
    last = step[int(symbols[-1]) * STATES + int(flat[-1])] if len(symbols) else state
    return flat, int(last)


def _symbols(points: np.ndarray, here: int) -> np.ndarray:
    """Classes of the first `here` points; the points after them are only looked at."""
    symbols = classes_of_code_points()[points[:here]]
    quotes = np.flatnonzero(points[:here] == ord("'"))
    if len(quotes):
        ahead = np.full((2, len(quotes)), SEPARATOR, np.uint32)
        for n in (1, 2):
            inside = quotes + n < len(points)
            ahead[n - 1, inside] = points[quotes[inside] + n]
        short = np.isin(ahead[0], [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(quotes), bool)
        for first, second in LONG_ENDINGS:
            long |= (ahead[0] == ord(first)) & (ahead[1] == ord(second))
        symbols[quotes[short]] = SHORT
        symbols[quotes[long]] = LONG
    return symbols


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens (and separators) begin in an array of code points."""
    found, state = [], CLOSED
    for start in range(0, len(points), CHUNK):
        here = min(CHUNK, len(points) - start)
        seen = points[start : start + here + 2]
        symbols = _symbols(seen, here)
        before, state = states_before(symbols, state)
        begins = breaks().ravel()[symbols.astype(np.intp) * STATES + before]
        # The last of a run of white space stands alone if something other follows in the text.
        white = (symbols == SPACE) | (symbols == BLANK)
        following = classes_of_code_points()[seen[1 : here + 1]]
        if len(following) < here:
            following = np.append(following, np.uint8(RESET))
        last = white & (following != SPACE) & (following != BLANK) & (following != RESET)
        begins |= last & ((before == IN_SPACE) | (before == IN_BLANK))
        found.append(np.flatnonzero(begins) + start)
    return np.concatenate(found) if found else np.empty(0, np.intp)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of one text, in order."""
    begins = boundaries(code_points(text)).tolist()
    return [text[a:b] for a, b in zip(begins, [*begins[1:], len(text)], strict=False)]

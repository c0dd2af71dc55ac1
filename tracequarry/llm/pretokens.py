"""Splitting of text into the pieces of the public byte-level pattern, vectorised over bytes.

The pattern (fixed value, ``public_tokenizers.PATTERN``) has contractions, letters, numbers,
other symbols - each with at most one blank before - and white space. Runs of one character
class are found with numpy; the last character of a white-space run in front of something else
stands alone, and joins what follows if it is a blank.
"""

from __future__ import annotations

import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Unicode White_Space. Fixed values.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_tables: dict[str, np.ndarray] = {}


def class_table() -> np.ndarray:
    """Class by code point, built from the Unicode categories once a process."""
    if "class" not in _tables:
        table = np.frombuffer(bytes({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8).copy()
        table[_WHITE] = SPACE
        _tables["class"] = table
    return _tables["class"]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, code points, lengths) of the characters beyond ASCII in valid UTF-8."""
    at = np.flatnonzero(data >= 0xC0)
    wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    lead, b1, b2, b3 = (wide[at + i] & (0xFF if i == 0 else 0x3F) for i in range(4))
    length = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
    points = np.where(
        length == 2,
        (lead & 0x1F) << 6 | b1,
        np.where(length == 3, (lead & 0x0F) << 12 | b1 << 6 | b2, (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3),
    )
    return at, np.minimum(points, 0x10FFFF), length


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = class_table()
    classes = table[data]
    at, points, length = code_points(data)
    if len(at):
        found = table[points]
        classes[at] = found
        for i in (1, 2, 3):
            more = (length > i) & (at + i < len(data))
            classes[at[more] + i] = found[more]
    return classes


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the pieces start; each row's text is split by itself."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    classes = byte_classes(data)
    edges = np.zeros(n + 1, bool)
    edges[offsets[offsets <= n]] = True
    row_edge = edges.copy()
    row_edge[n] = True
    edges[1:n] |= classes[1:] != classes[:-1]
    edges[n] = True
    # White space in front of something else in the same row.
    runs = np.flatnonzero(edges)
    begin, end = runs[:-1], runs[1:]
    white = (classes[begin] == SPACE) & ~row_edge[end]
    begin, end = begin[white], end[white]
    last = end - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    edges[last] = True
    blank = data[last] == 0x20
    edges[end[blank]] = False
    # Contractions: a lone apostrophe that starts a piece, with one of the fixed endings after it.
    quote = np.flatnonzero((data == 0x27) & edges[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~row_edge[quote + 1] & (classes[quote + 1] == LETTER)]
    if len(quote):
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = wide[quote + 1], wide[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = np.zeros(len(quote), bool)
        for pair in (b"re", b"ve", b"ll"):
            two |= (a == pair[0]) & (b == pair[1])
        two &= ~row_edge[np.minimum(quote + 2, n)]
        hit = one | two
        quote, size = quote[hit], np.where(one[hit], 1, 2)
        edges[quote + 1] = False
        inside = quote + 1 + size
        edges[inside] = True
    edges[n] = False
    return np.flatnonzero(edges)

"""Encoding by distinct pieces: each piece is encoded once a worker, its ids are kept in one flat store.

A piece is found by a hash and then compared byte by byte, so no two pieces are ever taken for one.
Texts are encoded ``CHUNK_BYTES`` at a time: a longer row is cut where white space follows something
else, as a piece starts there whatever comes before. So memory is bounded by that and by the longest
run without such a place.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from .common import equal_spans, span_hashes
from .pretokens import piece_starts


#: Bytes of text that are encoded at once; a single run without white space may be longer.
CHUNK_BYTES = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: With the last bytes of all other white space in UTF-8. Fixed values.
_MAYBE_WHITE = _WHITE.copy()
_MAYBE_WHITE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def grown(x: np.ndarray, size: int) -> np.ndarray:
    """``x`` with room for ``size`` items at least, doubled as often as that takes."""
    room = len(x)
    while room < size:
        room *= 2
    return x if room == len(x) else np.concatenate([x, np.zeros(room - len(x), x.dtype)])


class HashIndex:
    """64-bit hash -> number, by open addressing in numpy arrays; lookups and inserts work on whole arrays."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.values, self.count = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 if unknown."""
        mask = np.uint64(len(self.keys) - 1)
        at = hashes & mask
        found = np.where(self.keys[at] == hashes, self.values[at], -1)
        left = np.flatnonzero((found < 0) & (self.values[at] >= 0))
        at = at[left]
        while len(left):
            at = (at + np.uint64(1)) & mask
            value = self.values[at]
            hit = (value >= 0) & (self.keys[at] == hashes[left])
            found[left[hit]] = value[hit]
            more = (value >= 0) & ~hit
            left, at = left[more], at[more]
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Distinct, unknown hashes get the next numbers in order."""
        while 2 * (self.count + len(hashes)) > len(self.keys):
            kept = self.values >= 0
            keys, values = self.keys[kept], self.values[kept]
            self.keys, self.values = np.zeros(2 * len(self.keys), np.uint64), np.full(2 * len(self.values), -1, np.int32)
            self._place(keys, values)
        self._place(hashes, np.arange(self.count, self.count + len(hashes), dtype=np.int32))
        self.count += len(hashes)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        at = keys & mask
        while len(keys):
            free = self.values[at] < 0
            self.values[at[free]] = values[free]
            won = self.values[at] == values
            self.keys[at[won]] = keys[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + np.uint64(1)) & mask


class PieceCodec:
    """``encode_many`` turns distinct pieces into ids; at ``limit`` kept pieces the store starts anew.

    ``whole``: literals that are cut out of each row first (the leftmost, then the longest) and are a piece each.
    """

    def __init__(self, encode_many: Callable[[list[bytes]], list], limit: int = 800_000, whole: tuple[bytes, ...] = ()):
        self.encode_many, self.limit = encode_many, limit
        self.whole = re.compile(b"|".join(map(re.escape, sorted(whole, key=len, reverse=True)))) if whole else None
        self._reset()

    def _reset(self) -> None:
        self.index, self.ids, self.used = HashIndex(), np.zeros(1 << 16, np.int32), 0
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.bytes, self.bytes_used, self.byte_begin, self.size = np.zeros(1 << 16, np.uint8), 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.clashing: dict[bytes, int] = {}  # pieces whose hash another piece has

    def _learn(self, first: int, pieces: list[bytes]) -> None:
        """Pieces ``first``, ``first`` + 1, ... with their ids and bytes."""
        found = self.encode_many(pieces)
        counts, sizes = np.fromiter(map(len, found), np.int32, len(found)), np.fromiter(map(len, pieces), np.int64, len(pieces))
        total, raw, last = int(counts.sum()), np.frombuffer(b"".join(pieces), np.uint8), first + len(pieces)
        self.ids, self.bytes = grown(self.ids, self.used + total), grown(self.bytes, self.bytes_used + len(raw))
        self.begin, self.count, self.byte_begin, self.size = (grown(x, last) for x in (self.begin, self.count, self.byte_begin, self.size))
        self.ids[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.int32, total)
        self.bytes[self.bytes_used : self.bytes_used + len(raw)] = raw
        self.begin[first:last], self.count[first:last] = self.used + np.cumsum(counts) - counts, counts
        self.byte_begin[first:last], self.size[first:last] = self.bytes_used + np.cumsum(sizes) - sizes, sizes
        self.used += total
        self.bytes_used += len(raw)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each piece; unknown ones are learned."""

        def learned(known: int, at: np.ndarray) -> None:
            text = data.tobytes()
            self._learn(known, [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        hashes = span_hashes(data, starts, ends)
        numbers = self.index.find(hashes)
        lacking = np.flatnonzero(numbers < 0)
        if len(lacking):
            fresh, example, of = np.unique(hashes[lacking], return_index=True, return_inverse=True)
            known = self.index.count
            self.index.add(fresh)
            learned(known, lacking[example])
            numbers[lacking] = known + of
        sizes = ends - starts
        good = self.size[numbers] == sizes
        good[good] = equal_spans(data, starts[good], self.bytes, self.byte_begin[numbers[good]], sizes[good])
        for i in np.flatnonzero(~good).tolist():
            piece = data[starts[i] : ends[i]].tobytes()
            if piece not in self.clashing:
                self.clashing[piece] = self.index.count
                self.index.count += 1
                learned(self.clashing[piece], np.array([i]))
            numbers[i] = self.clashing[piece]
        return numbers

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start; what lies between two literals is split by itself."""
        text = data.tobytes() if self.whole else b""
        if not self.whole or not self.whole.search(text):
            return piece_starts(data, offsets)
        rows = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        spans = np.array([m.span() for a, b in rows for m in self.whole.finditer(text, a, b)], np.int64).reshape(-1, 2)
        starts = piece_starts(data, np.unique(np.concatenate([offsets, spans.ravel()])))
        # A literal ends before the next one starts.
        at = np.searchsorted(spans[:, 0], starts, side="left") - 1
        return starts[(at < 0) | (starts >= np.append(spans[:, 1], 0)[at])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the number of ids of each row."""
        if len(data) <= CHUNK_BYTES:
            return self._encode(data, offsets)
        places = np.flatnonzero(_WHITE[data[1:]] & ~_MAYBE_WHITE[data[:-1]]) + 1
        cuts, at = [0], 0
        while at < len(data):
            inside = int(np.searchsorted(places, at + CHUNK_BYTES, side="right"))
            to = int(places[inside - 1]) if inside and places[inside - 1] > at else int(places[inside]) if inside < len(places) else len(data)
            to = len(data) if len(data) - at <= CHUNK_BYTES else to
            cuts.append(to)
            at = to
        ids, counts = [], np.zeros(len(offsets) - 1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            # Rows that reach into the chunk; the offsets' ends are the chunk's.
            first, last = int(np.searchsorted(offsets, a, side="right")) - 1, int(np.searchsorted(offsets, b, side="left"))
            own = np.clip(offsets[first : last + 1], a, b) - a
            found, many = self._encode(data[a:b], own)
            ids.append(found)
            counts[first:last] += many
        return np.concatenate(ids), counts

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        if self.index.count > self.limit or self.bytes_used + self.used > 64 * self.limit:
            self._reset()
        numbers = self._numbers(data, starts, np.append(starts[1:], len(data)))
        counts = self.count[numbers].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(counts)])
        places = np.arange(sums[-1]) + np.repeat(self.begin[numbers] - sums[:-1], counts)
        return self.ids[places], np.diff(sums[np.searchsorted(starts, offsets)])


_codecs: dict[tuple, PieceCodec] = {}


def byte_alphabet() -> dict[int, int]:
    """Byte -> code point of the byte-level vocabulary files: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def added_tokens(tokenizer) -> dict[bytes, int]:
    """Literal -> id of the tokens that the library takes from a text before its model sees it."""
    found = tokenizer.get_added_tokens_decoder()
    if any(t.single_word or t.lstrip or t.rstrip for t in found.values()) or tokenizer.normalizer is not None:
        raise ValueError("added tokens that look at what is around them, and normalizers, aren't supported")
    return {t.content.encode(): i for i, t in found.items()}


def library_codec(path: str, encode_special_tokens: bool = True, limit: int = 800_000) -> PieceCodec:
    """Pieces encoded by the tokenizers library's model from the vocabulary file at ``path``.

    ``encode_special_tokens`` is the library's switch: if false (its default), special tokens that a
    text spells out are one id each; if true they are encoded like any other text.
    """
    key = ("library", path, encode_special_tokens, limit)
    if key not in _codecs:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenize, alphabet, added = tokenizer.model.tokenize, byte_alphabet(), added_tokens(tokenizer)
        if encode_special_tokens:
            special = {t.content.encode() for t in tokenizer.get_added_tokens_decoder().values() if t.special}
            added = {t: i for t, i in added.items() if t not in special}

        def encode_many(pieces: list[bytes]) -> list[list[int]]:
            return [[added[p]] if p in added else [t.id for t in tokenize(p.decode("latin-1").translate(alphabet))] for p in pieces]

        _codecs[key] = PieceCodec(encode_many, limit, tuple(added))
    return _codecs[key]


def token_lengths(path: str) -> np.ndarray:
    """Bytes of each token of a byte-level vocabulary file, by id."""
    key = ("lengths", path)
    if key not in _codecs:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocab = tokenizer.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token)
        for i, token in tokenizer.get_added_tokens_decoder().items():
            out[i] = len(token.content.encode())
        _codecs[key] = out
    return _codecs[key]

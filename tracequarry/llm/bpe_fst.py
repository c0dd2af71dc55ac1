"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

Theory used: a token sequence is the BPE encoding of its bytes if and only if each two
neighbouring tokens are (pairwise compatible). So every prefix of a piece has exactly one last
token, and the encoding follows from those last tokens.

State of the transducer: for each place where a token may have begun that is not over yet, the
trie node reached since then and the last token in front of it. Reading a byte moves all trie
nodes; the one node that is a token compatible with what stands in front gives the last token of
the longer prefix. States and transitions are made when they are first met. A token is emitted
once every open place lies behind it, after at most the longest token's length of lookahead.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np

NONE = 1 << 60


class Merges:
    """The ranks of a vocabulary, compiled into merge spines for the test of compatibility."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.left: dict[int, list[tuple[bytes, int]]] = {}
        self.right: dict[int, list[tuple[bytes, int]]] = {}
        self.fits: dict[int, bool] = {}  # by first << 17 | second

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two parts that the last merge joins; None for single bytes and tokens that merging never makes."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                joined = [self.ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
                best = min(joined)
                if best == NONE:
                    break
                i = joined.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.last_merge(token) is not None

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at that end of the token while it is merged, each with the rank of the merge that ends it."""
        kept = (self.left, self.right)[side]
        if token not in kept:
            out, until, at = [], NONE, token
            while True:
                out.append((self.tokens[at], until))
                parts = self.last_merge(at) if len(self.tokens[at]) > 1 else None
                if parts is None:
                    break
                until, at = at, parts[side]
            kept[token] = out
        return kept[token]

    def compatible(self, first: int, second: int) -> bool:
        """Whether no merge crosses from one token into the next."""
        key = first << 17 | second
        found = self.fits.get(key)
        if found is None:
            get = self.ranks.get
            found = True
            for a, a_ends in self.spine(first, 1):
                for b, b_ends in self.spine(second, 0):
                    # Of equal ranks the leftmost pair is merged first.
                    rank = get(a + b)
                    if rank is not None and rank < a_ends and rank <= b_ends:
                        found = False
                        break
                if not found:
                    break
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = found
        return found


class Transducer:
    """Encodes pieces; ``max_states`` bounds what is kept, beyond it the states are made anew."""

    LONG = 256

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000):
        if max(ranks.values()) + 1 >= 1 << 17 or max(map(len, ranks)) > self.LONG:
            raise ValueError(f"a vocabulary of fewer than {(1 << 17) - 1} ids, with tokens of at most {self.LONG} bytes")
        self.merges, self.ranks, self.max_states = Merges(ranks), ranks, max_states
        self.step: dict[int, int] = {}
        self.token = [-1]
        self.open = [True]
        for text, i in ranks.items():
            if self.merges.reachable(i):
                node = 0
                for b in text:
                    self.open[node] = True
                    node = self.step.setdefault(node << 8 | b, len(self.token))
                    if node == len(self.token):
                        self.token.append(-1)
                        self.open.append(False)
                self.token[node] = i
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int32)
        for text, i in ranks.items():
            self.length[i] = len(text)
        self.column, self.width = np.full(256, -1, np.int64), 64
        self._reset()

    def _reset(self) -> None:
        #: An open place is node << 17 | (last token before it + 1); 0 at the start of the piece.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number = {self.states[0]: 0}
        self.ends = np.full(1024, -1, np.int32)  # last token of the prefix that leads to the state
        self.go = np.full((1024, self.width), -1, np.int32)

    def column_of(self, byte: int) -> int:
        """The table's column of a byte; bytes get one when they are first met."""
        if self.column[byte] < 0:
            if (self.column >= 0).sum() == self.width:
                self.width *= 2
                self.go = np.concatenate([self.go, np.full_like(self.go, -1)], axis=1)
            self.column[byte] = (self.column >= 0).sum()
        return int(self.column[byte])

    def transition(self, state: int, byte: int) -> int:
        """The next state; made when first asked for."""
        column = self.column_of(byte)
        to = int(self.go[state, column])
        if to < 0:
            entries, token = [], -1
            step, tokens, is_open, fits, compatible = self.step.get, self.token, self.open, self.merges.fits.get, self.merges.compatible
            for entry in self.states[state]:
                node = step((entry >> 17) << 8 | byte)
                if node is not None:
                    before, found = entry & 0x1FFFF, tokens[node]
                    if found >= 0 and token < 0:
                        if not before:
                            token = found
                        else:
                            fit = fits((before - 1) << 17 | found)
                            if fit or fit is None and compatible(before - 1, found):
                                token = found
                    if is_open[node]:
                        entries.append(node << 17 | before)
            entries.append(token + 1)
            key = tuple(entries)
            to = self.number.setdefault(key, len(self.states))
            if to == len(self.states):
                self.states.append(key)
                if to == len(self.go):
                    self.go = np.concatenate([self.go, np.full_like(self.go, -1)])
                    self.ends = np.concatenate([self.ends, np.full_like(self.ends, -1)])
                self.ends[to] = token
            self.go[state, column] = to
        return to

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one piece, each as soon as it is certain; holds only what is still open."""
        state, done, at = 0, 0, 0
        last: dict[int, int] = {}
        path: list[int] = []
        for byte in data:
            if len(self.states) > self.max_states:
                entries, token = self.states[state], self.ends[state]
                self._reset()
                state = self.number.setdefault(entries, len(self.states))
                if state == len(self.states):
                    self.states.append(entries)
                    self.ends[state] = token
            state = self.transition(state, byte)
            at += 1
            last[at] = int(self.ends[state])
            if at - done >= 2 * self.LONG:
                # Every open place is at most the longest token back: what all their paths share is certain.
                reach = at - self.LONG
                shared = None
                for place in range(reach, at + 1):
                    chain = self._chain(last, done, place)
                    shared = chain if shared is None else shared & chain
                if shared:
                    path = sorted(shared)
                    yield from self._tokens(last, done, path[-1])
                    for i in range(done, path[-1] + 1):
                        last.pop(i, None)
                    done = path[-1]
        yield from self._tokens(last, done, at)

    def _chain(self, last: dict[int, int], done: int, place: int) -> set[int]:
        out = set()
        while place > done:
            out.add(place)
            place -= int(self.length[last[place]])
        return out

    def _tokens(self, last: dict[int, int], done: int, place: int) -> list[int]:
        out = []
        while place > done:
            out.append(last[place])
            place -= int(self.length[last[place]])
        return out[::-1]

    def encode_many(self, pieces: list[bytes]) -> list:
        """Ids of each piece: all pieces read their next byte at once; a piece that is a token is taken whole."""
        out: list = [None] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif len(piece) > self.LONG:
                out[i] = tuple(self.stream(piece))
            else:
                todo.append(i)
        todo.sort(key=lambda i: -len(pieces[i]))
        for k in range(0, len(todo), 8192):
            if len(self.states) > self.max_states:
                self._reset()
            self._together([pieces[i] for i in todo[k : k + 8192]], todo[k : k + 8192], out)
        return out

    def _together(self, pieces: list[bytes], places: list[int], out: list) -> None:
        """pieces: longest first."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes[0]) if len(sizes) else 0
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        last = np.zeros((len(pieces), width), np.int32)
        state = np.zeros(len(pieces), np.int64)
        for t in range(width):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # those longer than t
            now, byte = state[:n], grid[:n, t]
            for b in np.flatnonzero((self.column < 0) & (np.bincount(byte, minlength=256) > 0)).tolist():
                self.column_of(b)
            column = self.column[byte]
            to = self.go[now, column]
            lacking = np.flatnonzero(to < 0)
            if len(lacking):
                for key in set((now[lacking] << 8 | byte[lacking]).tolist()):
                    self.transition(key >> 8, key & 255)
                to = self.go[now, column]
            last[:n, t] = self.ends[to]
            state[:n] = to
        at, found = sizes.copy(), []
        rows = np.arange(len(pieces))
        while len(rows):
            token = last[rows, at[rows] - 1]
            found.append((rows, token))
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        many = [[] for _ in pieces]
        for rows, token in reversed(found):
            for r, x in zip(rows.tolist(), token.tolist()):
                many[r].append(x)
        for i, ids in zip(places, many):
            out[i] = ids


class Utf8Machine:
    """Incremental UTF-8 decoding. State: the bytes of a character that is not over yet (at most three)."""

    def __init__(self):
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                size = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut = len(data) - back if size > back else len(data)
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class Vocabulary:
    """A tiktoken rank file: the transducer's codec, and decoding of ids in chunks."""

    def __init__(self, path: str):
        from .word_codec import PieceCodec

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.transducer = Transducer(ranks)
        self.codec = PieceCodec(self.transducer.encode_many)
        self.length = self.transducer.length.astype(np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.zeros(int(self.length.sum()), np.uint8)
        for text, i in ranks.items():
            self.flat[self.begin[i] : self.begin[i] + len(text)] = np.frombuffer(text, np.uint8)
        self.decimal = [str(i) for i in range(len(self.length))]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        counts = self.length[ids]
        sums = np.cumsum(counts)
        return self.flat[np.arange(int(sums[-1]) if len(sums) else 0) + np.repeat(self.begin[ids] - (sums - counts), counts)].tobytes()

    def decode(self, ids: np.ndarray, chunk: int = 1 << 16) -> Iterator[str]:
        """Text of the ids, chunk by chunk."""
        machine = Utf8Machine()
        for k in range(0, len(ids), chunk):
            yield machine.feed(self.bytes_of(ids[k : k + chunk]))
        yield machine.close()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One a worker and file."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]

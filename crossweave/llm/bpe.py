"""Byte-pair encoding as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly if each token encodes itself and each pair of neighbours is
the encoding of its own bytes. So encodings are the paths of a finite-state machine that reads bytes through a trie of
the vocabulary and, at the end of a token that may follow the one before, may start the next token. Every prefix of a
text has just one complete path, but a path of several is only known to be right some bytes later; the machine is
determinised by following all of them at once. A state is the set of (last token, place in the trie, tokens not emitted
yet); what all paths share is emitted. No token is longer than the longest word of the vocabulary, which bounds how
far emission lags. States and moves are made when a text first needs them.
"""

from __future__ import annotations

import base64
import sys
import types

import regex

# The pattern that parts text before merging, of the vocabularies of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REPLACEMENT = "�"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its id a line. A smaller id merges first."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """The machine for one vocabulary. Moves, states and parts of text are remembered up to the given bounds, beyond
    which all that was remembered is dropped and made again as needed; results don't hang on them."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_parts: int = 200_000):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.max_states, self.max_parts = max_states, max_parts
        self._next: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        for word, i in ranks.items():
            node = 0
            for byte in word:
                child = self._next[node].get(byte)
                if child is None:
                    child = len(self._next)
                    self._next.append({})
                    self._token.append(-1)
                    self._next[node][byte] = child
                node = child
            self._token[node] = i
        self._split = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        start = ((-1, 0, ()),)
        self._states: list[tuple] = [start]
        self._number: dict[tuple, int] = {start: 0}
        self._final: list[tuple[int, ...] | None] = [()]
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._allowed: dict[tuple[int, int], bool] = {}
        self._parts: dict[str, tuple[int, ...]] = {}

    def merged(self, word: bytes) -> list[int]:
        """The encoding of a few bytes by merging, straight from the definition: of all neighbours that make a token the
        one with the smallest id merges, the leftmost first."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ranks.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or i < best):
                    best, at = i, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether token may come after last (-1: at the start)."""
        ok = self._allowed.get((last, token))
        if ok is None:
            word = self.tokens[token]
            ok = self.merged(word) == [token] if last < 0 else self._may_follow(-1, token) and self.merged(self.tokens[last] + word) == [last, token]
            self._allowed[last, token] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        paths = []
        for last, node, held in self._states[state]:
            child = self._next[node].get(byte)
            if child is None:
                continue
            if self._next[child]:
                paths.append((last, child, held))
            token = self._token[child]
            if token >= 0 and self._may_follow(last, token):
                paths.append((token, 0, (*held, token)))
        if not paths:
            raise ValueError(f"no token begins with the byte {byte}")
        shared = 0
        first = paths[0][2]
        while shared < len(first) and all(len(p[2]) > shared and p[2][shared] == first[shared] for p in paths):
            shared += 1
        to = tuple(sorted((last, node, held[shared:]) for last, node, held in paths))
        number = self._number.get(to)
        if number is None:
            number = self._number[to] = len(self._states)
            self._states.append(to)
            self._final.append(next((held for _, node, held in to if node == 0), None))
        self._moves[state << 8 | byte] = found = (number, first[:shared])
        return found

    def part(self, text: str) -> tuple[int, ...]:
        """The ids of one part of a text."""
        state, out, moves = 0, [], self._moves
        for byte in text.encode("utf-8", "surrogatepass"):
            move = moves.get(state << 8 | byte)
            state, emitted = move if move is not None else self._move(state, byte)
            if emitted:
                out += emitted
        return (*out, *self._final[state])

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; their strings are ordinary text. Null and empty texts have none."""
        out: list[int] = []
        if not text:
            return out
        parts = self._parts
        for p in self._split(text):
            ids = parts.get(p)
            if ids is None:
                ids = self.part(p)
                if len(p) <= 64:
                    parts[p] = ids
            out += ids
        if len(self._states) > self.max_states or len(parts) > self.max_parts or len(self._allowed) > 4 * self.max_states:
            self._reset()
        return out

    def decode(self, ids) -> str:
        """The text of ids, token by token through an incremental UTF-8 machine."""
        machine = Utf8()
        return "".join(machine.push(self.tokens[i]) for i in ids) + machine.end()


class Utf8:
    """Incremental UTF-8 decoder: push() takes any bytes and gives the characters that are complete; a character may be
    parted anywhere. Each longest part that can't be continued to a character becomes one replacement character."""

    def __init__(self):
        self._need, self._code, self._low, self._high = 0, 0, 0x80, 0xBF

    def push(self, data: bytes) -> str:
        out = []
        for b in data:
            if self._need:
                if self._low <= b <= self._high:
                    self._code, self._need = self._code << 6 | b & 0x3F, self._need - 1
                    self._low, self._high = 0x80, 0xBF
                    if not self._need:
                        out.append(chr(self._code))
                    continue
                out.append(REPLACEMENT)
                self._need = 0
            self._low, self._high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self._need, self._code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self._need, self._code = 2, b & 0x0F
                self._low, self._high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self._need, self._code = 3, b & 0x07
                self._low, self._high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append(REPLACEMENT)
        return "".join(out)

    def end(self) -> str:
        """What is left when no more bytes come."""
        left, self._need = REPLACEMENT if self._need else "", 0
        return left


def transducer(path: str) -> Transducer:
    """The machine of a rank file, made once in a process however many tasks it runs."""
    kept = sys.modules.setdefault("_crossweave_machines", types.ModuleType("_crossweave_machines"))
    if path not in kept.__dict__:
        setattr(kept, path, Transducer(read_ranks(path)))
    return getattr(kept, path)

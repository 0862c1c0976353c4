"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

A state stands for (last settled token, bytes read since). On each byte the transducer extends the one valid
segmentation of every prefix that a later token could still start from, and emits the tokens that all of them
share: no continuation can change those. The lookahead is bounded by the longest token of the vocabulary. States
and transitions are made when first met and kept, up to a bound after which the table is started anew.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex

#: The published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where white space follows something else, every pre-tokenisation has a border: a text may be cut there.
BORDER = re.compile(r"(?<=\S)(?=[ \n\t])").split


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """States are numbered; transition(state, byte) gives the tokens emitted and the next state."""

    START = 0

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000, max_words: int = 150_000):
        self.ranks, self.max_states, self.max_words = ranks, max_states, max_words
        self.longest = max(map(len, ranks))
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.number = {(b"", b""): 0}
        self.key: list[tuple[bytes, bytes]] = [(b"", b"")]
        self.next: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]
        self.final: list[tuple[int, ...] | None] = [()]

    def _restart(self, state: int) -> int:
        """Empties the tables within a word; the state that it is in becomes one of the new ones."""
        key = self.key[state]
        self._reset()
        if key in self.number:
            return self.number[key]
        self.number[key] = len(self.key)
        self.key.append(key)
        self.next.append({})
        self.final.append(None)
        return self.number[key]

    def merge(self, text: bytes) -> list[bytes]:
        """The merges in rank order; used on two adjoining tokens only, and as the check of the transducer."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def adjoin(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are next to each other."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def _segment(self, anchor: bytes, pending: bytes) -> list[bytes | None]:
        """For each prefix of pending, the last token of its segmentation behind anchor.

        None where that segmentation would reach back over the anchor: no later token starts there.
        """
        last: list[bytes | None] = [anchor]
        for end in range(1, len(pending) + 1):
            for start in range(max(0, end - self.longest), end):
                token = pending[start:end]
                if token in self.ranks and last[start] is not None and (not last[start] or self.adjoin(last[start], token)):
                    last.append(token)
                    break
            else:
                last.append(None)
        return last

    @staticmethod
    def _cuts(last: list[bytes], end: int) -> list[int]:
        cuts = [end]
        while end > 0:
            end -= len(last[end])
            cuts.append(end)
        return cuts[::-1]

    def transition(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        anchor, pending = self.key[state]
        pending += bytes((byte,))
        last, n = self._segment(anchor, pending), len(pending)
        shared: set[int] | None = None
        for start in range(max(0, n - self.longest), n + 1):
            if last[start] is not None and (start == n or pending[start:] in self.prefixes):
                cuts = set(self._cuts(last, start))
                shared = cuts if shared is None else shared & cuts
        settled = max(shared)
        out = []
        if settled:
            cuts = self._cuts(last, settled)
            out = [self.ranks[pending[a:b]] for a, b in zip(cuts, cuts[1:])]
        key = (last[settled], pending[settled:])
        if key not in self.number:
            self.number[key] = len(self.key)
            self.key.append(key)
            self.next.append({})
            self.final.append(None)
        found = self.next[state][byte] = (tuple(out), self.number[key])
        return found

    def flush(self, state: int) -> tuple[int, ...]:
        if self.final[state] is None:
            anchor, pending = self.key[state]
            last = self._segment(anchor, pending)
            cuts = self._cuts(last, len(pending))
            self.final[state] = tuple(self.ranks[pending[a:b]] for a, b in zip(cuts, cuts[1:]))
        return self.final[state]

    def word(self, piece: str) -> tuple[int, ...]:
        """One pre-token, read byte by byte from the start state."""
        out: list[int] = []
        state = 0
        for byte in piece.encode("utf-8", "surrogatepass"):
            step = self.next[state].get(byte)
            if step is None:
                if len(self.key) >= self.max_states:
                    state = self._restart(state)
                step = self.transition(state, byte)
            if step[0]:
                out += step[0]
            state = step[1]
        out += self.flush(state)
        return tuple(out)

    def _path(self, part: str, borders: bool = True) -> tuple[int, ...]:
        """Ids of a part that begins and ends at a border, kept as one path from start to end."""
        ids = self.parts.get(part)
        if ids is None:
            out: list[int] = []
            if borders and len(inner := BORDER(part)) > 1:
                for x in inner:
                    out += self._path(x, False)
            else:
                words = self.words
                for piece in self.split(part):
                    got = words.get(piece)
                    if got is None:
                        got = self.word(piece)
                        if len(piece) <= 64:
                            if len(words) >= self.max_words:
                                words.clear()
                            words[piece] = got
                    out += got
            ids = tuple(out)
            if len(part) <= 400:
                if len(self.parts) >= self.max_words:
                    self.parts.clear()
                self.parts[part] = ids
        return ids

    def _lines(self, text: str) -> Iterator[tuple[int, ...]]:
        """Paths of the lines; a line goes with the next one unless it ends in something else than white space."""
        known = self.parts.get
        first, *rest = text.split("\n")
        held = first
        for line in rest:
            if held and not held[-1].isspace():
                yield known(held) or self._path(held)
                held = "\n" + line
            else:
                held += "\n" + line
        if held:
            yield known(held) or self._path(held)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty text give the empty list."""
        out: list[int] = []
        for ids in self._lines(text) if text else ():
            out += ids
        return out

    def count(self, text: str | None) -> int:
        """Length of encode(text)."""
        return sum(map(len, self._lines(text))) if text else 0


class Utf8Machine:
    """Incremental UTF-8 decoder: bytes in, whole characters out; a broken sequence gives U+FFFD."""

    def __init__(self) -> None:
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        i = 0
        while i < len(data):
            b = data[i]
            if self.need:
                if self.low <= b <= self.high:
                    self.held += data[i : i + 1]
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    i += 1
                    if not self.need:
                        out.append(self.held.decode("utf-8"))
                        self.held = b""
                    continue
                out.append("�")  # the byte is read again as a start
                self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""
                continue
            if b < 0x80:
                j = i + 1
                while j < len(data) and data[j] < 0x80:
                    j += 1
                out.append(data[i:j].decode("ascii"))
                i = j
                continue
            if 0xC2 <= b <= 0xDF:
                self.need = 1
            elif 0xE0 <= b <= 0xEF:
                self.need, self.low, self.high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.low, self.high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
            self.held = data[i : i + 1] if self.need else b""
            i += 1
        return "".join(out)

    def end(self) -> str:
        out = "�" if self.need else ""
        self.__init__()
        return out


def decode(ids: Iterable[int], tokens: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of ids, given out as soon as its characters are whole."""
    machine = Utf8Machine()
    for i in ids:
        if piece := machine.feed(tokens[i]):
            yield piece
    if rest := machine.end():
        yield rest


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One transducer a Python worker and vocabulary; its states are kept between batches."""
    return Transducer(load_ranks(path))

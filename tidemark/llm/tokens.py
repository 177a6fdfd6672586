"""Token ids and prefix token counts of whole texts.

Texts are cut at spaces that start a token of their own accord, so a unit's ids do not depend on its neighbours: a
space between two non-blank characters always begins a pre-token in the byte-level vocabulary, and blanks are dropped
in the word vocabulary. Each distinct unit is encoded by the library once and remembered (up to ``CACHE`` units for each
worker). Texts with longer runs of blanks are cut by a slower rule that is exact for them too.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from tidemark.llm.common import LOWER_BYTES

#: Last bytes of units that may end with a blank.
MAYBE_BLANK = frozenset(bytes([b]) for b in [*range(9, 14), *range(28, 33), *range(128, 256)])
#: Units that one worker remembers; beyond it, units are encoded anew each time.
CACHE = 1_000_000
LATER = re.compile(r"(?= \S)")


def load(path: str):
    """The tokenizers library's tokenizer, on one thread (Spark runs one task a core)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Blank(Exception):
    """A unit that is empty or begins with a blank: the text needs the slower cut."""


class _Units(dict):
    def __init__(self, make, prefix: str, most: int = CACHE):
        super().__init__()
        self.make, self.prefix, self.most = make, prefix, most

    def __missing__(self, unit: bytes):
        text = unit.decode("utf-8")
        if self.prefix and (not text or text[0].isspace()):
            raise Blank
        value = self.make(self.prefix + text)
        if len(self) < self.most and len(unit) < 100:
            self[unit] = value
        return value


class Encoder:
    """ids of whole texts as bytes of little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, units: int = CACHE):
        self.tok = load(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.byte_level = type(self.tok.pre_tokenizer).__name__ == "ByteLevel"
        self.first, self.rest = _Units(self._ids, "", units), _Units(self._ids, " " if self.byte_level else "", units)
        self.single: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        ids = array("H" if self.width == 2 else "I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return self.single.setdefault(ids, ids) if len(ids) == self.width else ids  # one object for a token

    def encode(self, text: bytes) -> bytes:
        if not self.byte_level:
            # it lower-cases anyway; only a special token's name must keep its case
            plain = text if b"<|" in text else text.translate(LOWER_BYTES)
            return b"".join(map(self.first.__getitem__, plain.split()))
        head, *tail = text.split(b" ")
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except Blank:
            return b"".join(self._ids(x) for x in LATER.split(text.decode("utf-8")))


class PrefixCounter:
    """Exact token counts at every prefix of a text, by dynamic programming.

    For a pre-token, the last token of a prefix's encoding is the one suffix token that is stable behind the last token
    of what precedes it, so count[i] = count[i - len(token)] + 1. Tables of distinct units are remembered; a text's table
    is their running sum. ``counts(text)`` gives all of them, so truncation and budget questions need no new encoding.
    """

    def __init__(self, path: str):
        import regex

        self.tok = load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        to_char = _byte_chars()
        to_byte = {c: b for b, c in enumerate(to_char)}
        self.ids = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        merges = [(self.ids[as_bytes(a)], self.ids[as_bytes(b)], self.ids[as_bytes(a + b)]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts = {c: (r, a, b) for r, (a, b, c) in reversed(list(enumerate(merges)))}
        #: Tokens by their bytes, and -1 for bytes that only begin longer tokens.
        self.trie = {t[:i]: -1 for t in self.ids for i in range(1, len(t))} | self.ids
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.stable: dict[tuple[int, int], bool] = {}
        self.tables: dict[bytes, list[int]] = {}
        self.first, self.rest = _Units(self.packed, ""), _Units(self.packed, " ")

    def follows(self, a: int, b: int) -> bool:
        """Whether token b stays as it is behind token a (or at the start, a = -1).

        Undo the later of the two tokens' merges, step by step; at each border between the parts, a merge that would
        have come first, by its rank, breaks the pair.
        """
        known = self.stable.get((a, b))
        if known is not None:
            return known
        if a < 0:
            known = self.whole(b)
        else:
            left, right, before, known = a, b, (1 << 60, 0), True
            rank, parts = self.rank, self.parts
            while True:
                joined = rank.get((left, right))
                if joined is not None and (joined, 0) < before:
                    known = False
                    break
                made_left, made_right = parts.get(left), parts.get(right)
                if made_left is None and made_right is None:
                    break
                if made_right is None or made_left is not None and made_left[0] > made_right[0]:
                    before, left = (made_left[0], 0), made_left[2]
                else:
                    before, right = (made_right[0], 1), made_right[1]
        if len(self.stable) < CACHE:
            self.stable[a, b] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token: its parts are whole and nothing merges across them."""
        made = self.parts.get(token)
        return made is None or self.whole(made[1]) and self.whole(made[2]) and self._only_across(made)

    def _only_across(self, made: tuple[int, int, int]) -> bool:
        rank, left, right = made
        probe = self.rank.pop((left, right))
        try:
            return self.follows_once(left, right, rank)
        finally:
            self.rank[left, right] = probe

    def follows_once(self, a: int, b: int, until: int) -> bool:
        """Whether no merge across the border of a and b comes before rank ``until``."""
        left, right, before = a, b, (until, 0)
        while True:
            joined = self.rank.get((left, right))
            if joined is not None and (joined, 0) < before:
                return False
            made_left, made_right = self.parts.get(left), self.parts.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or made_left is not None and made_left[0] > made_right[0]:
                before, left = min(before, (made_left[0], 0)), made_left[2]
            else:
                before, right = min(before, (made_right[0], 1)), made_right[1]

    def table(self, piece: bytes) -> list[int]:
        """Token counts of every byte prefix of a pre-token, 0 to its length."""
        if (known := self.tables.get(piece)) is not None:
            return known
        size, get, follows = len(piece), self.trie.get, self.follows
        count, last = [0] * (size + 1), [-1] * (size + 1)
        for start in range(size):  # what ends here is settled: longer tokens, from earlier starts, came first
            before, n = last[start], count[start] + 1
            for end in range(start + 1, size + 1):
                token = get(piece[start:end])
                if token is None:
                    break
                if token >= 0 and not count[end] and follows(before, token):
                    count[end], last[end] = n, token
        if len(self.tables) < CACHE // 4 and len(piece) < 100:
            self.tables[piece] = count
        return count

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a unit."""
        if text.isascii():
            return self.pattern.findall(text)
        pieces, at = [], 0  # by the library's own classes of characters
        for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text):
            pieces.append(text[max(a, at) : b])
            at = max(at, b)
        return pieces

    def total(self, text: str) -> int:
        """Token count of a unit."""
        if any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return sum(self.table(x.encode("utf-8"))[-1] for x in self.pieces(text))

    def unit(self, text: str) -> list[int]:
        """Token counts of every code-point prefix of a unit, 0 to its length.

        The library cuts a text at whole special strings first. Up to the last character of one, a prefix is plain text
        from the end of the special string before; with its last character, what precedes it is closed, and it is one token.
        """
        out, base, at = [0], 0, 0
        for begin, end in self._specials(text):
            out += [base + n for n in self.plain(text[at : end - 1])[1:]]
            base += self.total(text[at:begin]) + 1
            out.append(base)
            at = end
        return out + [base + n for n in self.plain(text[at:])[1:]]

    def _specials(self, text: str) -> list[tuple[int, int]]:
        """Special strings as the library finds them: leftmost, the first listed of those at one place."""
        found, at = [], 0
        while self.special and (near := min(((i, k) for k, s in enumerate(self.special) if (i := text.find(s, at)) >= 0), default=None)):
            found.append((near[0], near[0] + len(self.special[near[1]])))
            at = found[-1][1]
        return found

    def plain(self, text: str) -> list[int]:
        """The same of a text without whole special strings."""
        out, base, ahead, blanks = [0], 0, 0, ""
        for piece in self.pieces(text):
            data = piece.encode("utf-8")
            table = self.table(data)
            if len(data) == len(piece):
                mine = [base + n for n in table[1:]]
            else:
                mine = [base + table[i + 1] for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]
            if blanks and piece[0].isspace():  # up to here the blanks are one pre-token
                mine[0] = ahead + self.table((blanks + piece[0]).encode("utf-8"))[-1]
            if piece in ("'re", "'ve", "'ll"):  # cut short, the apostrophe and the letter are two
                mine[1] = base + 2
            out += mine
            ahead, blanks, base = base, piece if piece.isspace() else "", base + table[-1]
        return out

    def packed(self, text: str) -> bytes | array:
        """unit() without the empty prefix, in a byte for each where all counts fit."""
        counts = self.unit(text)[1:] if self.special and any(s in text for s in self.special) else self.plain(text)[1:]
        return bytes(counts) if max(counts, default=0) < 256 else array("I", counts)

    def units(self, text: bytes) -> tuple[list[bytes], list[bytes | array]]:
        """The units of a text (without the space before each but the first) and their prefix tables."""
        head, *tail = text.split(b" ")
        try:
            return [head, *tail], [self.first[head], *map(self.rest.__getitem__, tail)]
        except Blank:
            parts = LATER.split(text.decode("utf-8"))
            return [x.encode("utf-8")[k > 0 :] for k, x in enumerate(parts)], [self.packed(x) for x in parts]

    def count(self, text: bytes) -> int:
        return sum(t[-1] for t in self.units(text)[1] if t)

    def _space_behind(self, unit: bytes, first: bool) -> int | None:
        """What a lone space behind a unit adds, where the unit ends with a blank: the space belongs to that pre-token."""
        text = " " * (not first) + unit.decode("utf-8")
        return self.total(text + " ") - self.total(text) if text[-1:].isspace() else None

    def _counts(self, units: list[bytes], tables: list[bytes | array]) -> np.ndarray:
        sizes = np.fromiter(map(len, tables), np.int64, len(tables))
        each = np.frombuffer(b"".join(tables), np.uint8)
        if len(each) != sizes.sum():  # some tables have wide counts
            each = np.concatenate([np.frombuffer(t, np.uint8 if isinstance(t, bytes) else np.uint32).astype(np.int64) for t in tables])
        ends = np.cumsum(sizes)
        some = sizes > 0
        last = np.zeros(len(tables), np.int64)
        last[some] = each[ends[some] - 1]
        base = np.cumsum(last) - last
        out = np.zeros(len(each) + 1, np.int64)
        out[1:] = each + np.repeat(base, sizes)
        for k, unit in enumerate(units[:-1], 1):
            if unit[-1:] in MAYBE_BLANK and (more := self._space_behind(unit, k == 1)) is not None:
                out[1 + ends[k] - sizes[k]] = base[k] + more
        return out

    def counts(self, text: bytes) -> np.ndarray:
        """Exact token count of every code-point prefix, from the empty one to the whole text."""
        return self._counts(*self.units(text))

    def counts_and_fit(self, text: bytes, budget: int) -> tuple[np.ndarray, int]:
        """counts(text), and code points of its longest prefix of at most ``budget`` tokens."""
        counts = self.counts(text)
        return counts, int(np.flatnonzero(counts <= max(budget, 0))[-1])

    def fit(self, text: bytes, budget: int) -> int:
        return self.counts_and_fit(text, budget)[1]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file: itself where printable, else
    the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_made: dict = {}


def encoder(path: str, units: int = CACHE) -> Encoder:
    """One for each worker process, file and number of units."""
    return _made.get(("e", path, units)) or _made.setdefault(("e", path, units), Encoder(path, units))


def prefix_counter(path: str) -> PrefixCounter:
    return _made.get(("p", path)) or _made.setdefault(("p", path), PrefixCounter(path))

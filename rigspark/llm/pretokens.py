"""Encoding of many texts without a Python object for each pre-token.

For the pattern below, where pre-tokens begin follows from the classes of
neighbouring characters, so that one pass of array operations finds them all.
Pre-tokens are known again by 64-bit hashes in an open-addressing table, whose
values point into a store of ids; only new ones become strings and are merged.
"""

from __future__ import annotations

import numpy as np
import regex

from .byte_bpe import SHORT, ByteBpe
from .words import U64, mix

#: The pattern that ``starts`` stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPACE, LETTER, NUMBER, OTHER = range(4)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
#: Hashes that the table holds before it is begun anew.
MOST = 1 << 19


def character_classes() -> np.ndarray:
    """The class of every code point."""
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    classes = np.full(0x110000, OTHER, np.uint8)
    for expression, kind in ((r"\p{White_Space}+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(expression, text):
            classes[points[m.start() : m.end()]] = kind
    return classes


def starts(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts set end to end; ``firsts`` are the texts' first places, none of them empty."""
    n = len(points)
    fresh = np.zeros(n + 1, bool)
    fresh[firsts] = fresh[n] = True
    space, blank = kinds == SPACE, points == 0x20
    after_space = np.r_[False, space[:-1]] & ~fresh[:n]
    before_word = np.r_[~space[1:], False] & ~fresh[1:]
    changed = np.r_[True, kinds[1:] != kinds[:-1]] | fresh[:n]
    after_blank = np.r_[False, blank[:-1]] & ~fresh[:n]
    # a run of white space begins one, and its last character before a word another one, which a blank shares with the word
    begin = np.where(space, ~after_space | before_word, changed & ~after_blank)
    quote = np.flatnonzero((points == 0x27) & begin)
    if len(quote):
        ahead = np.r_[points, np.zeros(2, points.dtype)]
        one, two = ahead[quote + 1], ahead[quote + 2]
        room1, room2 = ~fresh[quote + 1], ~fresh[quote + 1] & ~fresh[np.minimum(quote + 2, n)]
        short = room1 & np.isin(one, [ord(c) for c in "stmd"])
        long = room2 & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            for k in range(1, size):
                begin[at + k] = False
            behind = at + size
            begin[behind[behind < n]] = True
    return np.flatnonzero(begin)


class Table:
    """64-bit keys to small integers, with linear probing."""

    def __init__(self, most: int) -> None:
        self.mask = 4 * most - 1
        self.keys, self.values, self.held = np.zeros(4 * most, np.uint64), np.zeros(4 * most, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for none; no key is 0."""
        at = (keys & U64(self.mask)).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        todo = np.flatnonzero((seen != keys) & (seen != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, all different."""
        at, todo = (keys & U64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            spot = at[todo]
            free = self.keys[spot] == 0
            _, first = np.unique(spot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[spot[won]], self.values[spot[won]] = keys[todo[won]], values[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo = todo[left]
            at[todo] = (at[todo] + 1) & self.mask
        self.held += len(keys)


class Encoder:
    """Encodes texts as ``bpe`` does."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe, self.classes = bpe, character_classes()
        self._clear()

    def _clear(self) -> None:
        self.table, self.ids = Table(MOST), np.zeros(1 << 16, np.int32)
        self.begin, self.size, self.count, self.used = np.zeros(MOST, np.int64), np.zeros(MOST, np.int32), 0, 0

    def _store(self, packed: list[bytes]) -> np.ndarray:
        """Numbers of new entries with these ids."""
        sizes = np.array([len(x) // 4 for x in packed], np.int32)
        new = self.count + np.arange(len(packed))
        total = self.used + int(sizes.sum())
        if total > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(max(total, len(self.ids)), np.int32)]
        while self.count + len(packed) > len(self.begin):
            self.begin, self.size = np.r_[self.begin, np.zeros_like(self.begin)], np.r_[self.size, np.zeros_like(self.size)]
        self.ids[self.used : total] = np.frombuffer(b"".join(packed), "<i4")
        self.begin[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.count, self.used = self.count + len(packed), total
        return new

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        begin = starts(points, self.classes[points], (ends - lengths)[lengths > 0])
        stop = np.r_[begin[1:], len(points)]
        with np.errstate(over="ignore"):
            up, down = np.full(len(points), _STEP, np.uint64), np.full(len(points), _BACK, np.uint64)
            up[0] = down[0] = 1
            total = np.r_[U64(0), np.cumsum((points + np.uint32(1)).astype(np.uint64) * U64(0xD6E8FEB86659FD93) * np.cumprod(up))]
            keys = mix((total[stop] - total[begin]) * np.cumprod(down)[begin] + (stop - begin).astype(np.uint64)) | U64(1)
        if self.table.held + len(keys) > 2 * MOST:
            known = np.unique(keys)
            if self.table.held + len(known) > MOST:
                self._clear()
        entry = self.table.find(keys)
        long = np.flatnonzero(stop - begin > SHORT)
        entry[long] = -2
        new = np.flatnonzero(entry == -1)
        word = lambda k: points[begin[k] : stop[k]].tobytes().decode("utf-32-le").encode()
        if len(new):
            fresh, first, of = np.unique(keys[new], return_index=True, return_inverse=True)
            packed, short, raw = [b""] * len(fresh), [], []
            for i, k in enumerate(new[first].tolist()):
                piece = word(k)
                rank = self.bpe.ranks.get(piece)
                if rank is None:
                    short.append(i)
                    raw.append(piece)
                else:
                    packed[i] = rank.to_bytes(4, "little")
            if raw:
                for i, ids in zip(short, self.bpe.merge_rounds(raw), strict=True):
                    packed[i] = ids
            numbers = self._store(packed)
            if self.table.held + len(fresh) <= 2 * MOST:  # what does not fit is merged again when it comes again
                self.table.add(fresh, numbers.astype(np.int32))
            entry[new] = numbers[of]
        if len(long):
            entry[long] = self._store([np.array(self.bpe.merge(word(k)), "<i4").tobytes() for k in long.tolist()])
        sizes = self.size[entry]
        last = np.cumsum(sizes, dtype=np.int64)
        ids = self.ids[np.repeat(self.begin[entry] - (last - sizes), sizes) + np.arange(last[-1])]
        cuts = np.r_[0, last][np.searchsorted(begin, np.r_[0, ends])]
        if self.count > 4 * MOST:
            self._clear()
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

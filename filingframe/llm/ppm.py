"""Prediction by partial matching over bytes, with frozen counts, in numpy.

A text is padded with ``order`` PAD bytes in front and one END byte behind; neither byte occurs in
UTF-8. Every symbol then has a full context, so the counts of an order are sums of the counts of
the order above it. Escapes follow method C: a context seen ``n`` times with ``d`` different
symbols gives a seen symbol count/(n+d) and the escape d/(n+d). With ``exclusion`` the symbols
already ruled out by the longer context leave the distribution of the shorter one. Symbols left
out of a tree to bound its size add their counts to the escape of their context.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

PAD, END = b"\xff", b"\xfe"
_SYMBOLS = 255  # all byte values but PAD
_SEGMENT = 1 << 18  # bytes of text held as arrays at a time


def segments(texts: Sequence[bytes], order: int, limit: int = _SEGMENT) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Groups of (text number, context, symbols) of about ``limit`` bytes; a long text is continued."""
    group, size = [], 0
    for i, text in enumerate(texts):
        whole = text + END
        for at in range(0, len(whole), limit):
            before = (PAD * order + whole[max(0, at - order) : at])[-order:] if order else b""
            group.append((i, before, whole[at : at + limit]))
            size += len(group[-1][2])
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group


def gram_keys(group: list[tuple[int, bytes, bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of each position as one integer, and where each segment starts."""
    b = np.frombuffer(b"".join(x for _, before, body in group for x in (before, body)), np.uint8)
    keys = b[order:].astype(np.uint64)
    for j in range(1, order + 1):
        keys |= b[order - j : len(b) - j].astype(np.uint64) << np.uint64(8 * j)
    lengths = np.array([len(body) for _, _, body in group])
    use = np.ones(len(keys), bool)
    for at in np.cumsum(lengths[:-1] + order):
        use[at - order : at] = False
    return keys[use], np.r_[0, np.cumsum(lengths[:-1])]


def gram_counts(texts: Sequence[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the texts with their counts."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for group in segments(texts, order, 4 * _SEGMENT):
        k, c = np.unique(gram_keys(group, order)[0], return_counts=True)
        keys, counts = summed(np.r_[keys, k], np.r_[counts, c])
    return keys, counts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up by key, keys in order."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def lower_order(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of ``order`` from those of a higher order."""
    return summed(keys & np.uint64((1 << (8 * (order + 1))) - 1), counts)


class Index:
    """Place of each key in a sorted array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.table = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        at = self.table[slot]
        left = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            at[left] = self.table[slot[left]]
            left = left[(at[left] >= 0) & (self.keys[at[left]] != keys[left])]
        return at


class Contexts:
    """Frozen context tree: ``levels[j]`` holds (keys, counts) of order j, keys in order."""

    def __init__(self, levels: Sequence[tuple[np.ndarray, np.ndarray]], exclusion: bool = True):
        self.order, self.exclusion = len(levels) - 1, exclusion
        self.grams, self.count, self.contexts, self.n, self.d, self.left_out, self.ruled_out = [], [], [], [], [], [], []
        for j, (keys, counts) in enumerate(levels):
            context = keys >> np.uint64(8)
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.empty(0, np.int64)
            add = lambda x, at=starts: np.add.reduceat(x, at) if len(at) else np.empty(0, np.int64)
            below = np.zeros(len(keys), np.int64)
            if j and len(keys):
                short = self.grams[j - 1].find(keys & np.uint64((1 << (8 * j)) - 1))
                below = np.where(short >= 0, self.count[j - 1][short], 0)
            self.grams.append(Index(keys))
            self.contexts.append(Index(context[starts]))
            self.count.append(counts.astype(np.int64))
            kept = add(counts.astype(np.int64))
            n = kept
            if j and len(keys):  # a context is a (context, symbol) pair of the order below
                whole = self.grams[j - 1].find(context[starts])
                n = np.maximum(kept, np.where(whole >= 0, self.count[j - 1][whole], 0))
            self.n.append(n)
            self.left_out.append(n - kept)
            self.d.append(np.diff(np.r_[starts, len(keys)]))
            self.ruled_out.append(add(below))
        last = self.order
        n, d = self.n[last] + self.d[last], self.d[last]
        self.seen_bits = np.log2(np.repeat(n, d) / self.count[last]) if len(d) else np.empty(0)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each position."""
        at = self.grams[self.order].find(keys)
        out = np.zeros(len(keys))
        hit = at >= 0
        out[hit] = self.seen_bits[at[hit]]
        left = np.flatnonzero(~hit)
        if len(left):
            none = np.zeros(len(left), np.int64)
            out[left] = self.escaped(keys[left], none, none)
        return out

    def escaped(self, keys: np.ndarray, gone_n: np.ndarray, gone_d: np.ndarray) -> np.ndarray:
        """Code length of each position in these orders, after longer contexts ruled out ``gone_d`` symbols seen ``gone_n`` times."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        gone_n, gone_d = gone_n.copy(), gone_d.copy()
        for j in range(self.order, -1, -1):
            key = keys[left] & np.uint64((1 << (8 * (j + 1))) - 1)
            at = self.grams[j].find(key)
            context = self.contexts[j].find(key >> np.uint64(8))
            known = context >= 0
            rest = np.where(known, self.d[j][context] if len(self.d[j]) else 0, 0) - gone_d[left]
            total = np.where(known, self.n[j][context] if len(self.n[j]) else 0, 0) - gone_n[left] + rest
            rest = rest + np.where(known, self.left_out[j][context] if len(self.n[j]) else 0, 0)
            seen = at >= 0
            out[left[seen]] += np.log2(total[seen] / self.count[j][at[seen]])
            escape = known & ~seen & (rest > 0)
            out[left[escape]] += np.log2(total[escape] / rest[escape])
            if self.exclusion:
                past = known & ~seen
                gone_n[left[past]], gone_d[left[past]] = self.ruled_out[j][context[past]], self.d[j][context[past]]
            left = left[~seen]
            if not len(left):
                return out
        out[left] += np.log2(max(1, _SYMBOLS - (int(self.d[0][0]) if self.exclusion and len(self.d[0]) else 0)))
        return out


def text_bits(texts: Sequence[bytes], order: int, bits) -> np.ndarray:
    """Sum of ``bits(keys)`` over each text; ``bits`` gives one or several columns."""
    out = None
    for group in segments(texts, order):
        keys, starts = gram_keys(group, order)
        sums = np.add.reduceat(bits(keys), starts, axis=0)
        if out is None:
            out = np.zeros((len(texts), *sums.shape[1:]))
        np.add.at(out, [i for i, _, _ in group], sums)
    return out


class Codes:
    """Code lengths of some keys, for positions whose tree is not at hand."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.lengths = Index(keys[by]), lengths[by]

    def text_bits(self, texts: Sequence[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums over each text, and what they lack: text number, key and number of its positions, in order."""
        sums, lacking = np.zeros(len(texts)), [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
        for group in segments(texts, order):
            keys, starts = gram_keys(group, order)
            text = np.repeat([i for i, _, _ in group], np.diff(np.r_[starts, len(keys)]))
            at = self.keys.find(keys)
            hit = at >= 0
            sums += np.bincount(text[hit], self.lengths[at[hit]], len(texts))
            lacking.append(_tally(text[~hit], keys[~hit], np.ones(int((~hit).sum()), np.int64)))
        return sums, *_tally(*(np.concatenate(x) for x in zip(*lacking, strict=True)))


def _tally(text: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up by text and key, in order."""
    if not len(keys):
        return text, keys, counts
    by = np.lexsort((keys, text))
    text, keys, counts = text[by], keys[by], counts[by]
    starts = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])
    return text[starts], keys[starts], np.add.reduceat(counts, starts)

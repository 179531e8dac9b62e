"""Prefix dynamic program over merge-based (BPE) pieces, in numpy, many equally long words at once.

For every prefix of a word there is exactly one last piece: the piece p ending there whose pair with the last
piece of the rest is admissible, that is, the merge order keeps the boundary between the two. So one pass
over the prefixes gives count, last piece and backpointer of every prefix, without merging anything.
Candidate pieces are found by probing the sorted hashes of all pieces with the hashes of the word's
substrings; admissibility undoes the merges of both pieces from the latest on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from vocalgrid.llm.textkit import BASE, mix, powers

_BASE = np.uint64(BASE)
_NONE = np.iinfo(np.int64).max
_LENGTH = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = pow(BASE, -1, 1 << 64)
CELLS = 1 << 19
# Words beyond this many symbols are settled on their own.
LONG = 1 << 12
SHORT = 12


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: int) -> np.ndarray:
    """Hashes of the substrings from each ``start`` to ``end``, of every row."""
    length = end - start
    shift = powers(BASE, int(length.max(initial=0)) + 1)[length]
    return mix(prefix[:, end, None] - prefix[:, start] * shift + length.astype(np.uint64) * _LENGTH)


class MergeTable:
    """Pieces as symbol sequences, their latest merge, and the rank of every mergeable pair.

    ``symbols[i]`` are the integer symbols of piece i; ``left``/``right`` its two parts (itself for a base
    piece), ``rank`` the rank of that merge (-1 for base). ``pairs`` maps (left, right) to a rank. Pieces with
    ``usable`` False are never the result of merging their own symbols and are no candidates.
    Symbols that no piece holds are given the pseudo piece ``unknown``.
    """

    def __init__(self, symbols, left, right, rank, pairs: dict[tuple[int, int], int], usable=None) -> None:
        self.unknown = len(symbols)
        self.left = np.append(np.asarray(left, dtype=np.int64), self.unknown)
        self.right = np.append(np.asarray(right, dtype=np.int64), self.unknown)
        self.rank = np.append(np.asarray(rank, dtype=np.int64), -1)
        self.longest = max((len(s) for s in symbols), default=1)
        usable = np.ones(len(symbols), dtype=bool) if usable is None else np.asarray(usable)
        keys = self._piece_keys(symbols)[usable]
        ids = np.flatnonzero(usable)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.sizes = {len(s) for s, ok in zip(symbols, usable) if ok} | {1}
        ends = [i for i in np.flatnonzero(usable) if len(symbols[i]) > SHORT]
        self.tails = np.unique(self._tails([symbols[i][-SHORT:] for i in ends]))
        width = self.unknown + 1
        pair_keys = np.fromiter((a * width + b for a, b in pairs), dtype=np.int64, count=len(pairs))
        ranks = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        order = np.argsort(pair_keys)
        self.pair_keys, self.pair_ranks = pair_keys[order], ranks[order]

    @staticmethod
    def _prefix(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((rows.shape[0], rows.shape[1] + 1), dtype=np.uint64)
        for k in range(rows.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + rows[:, k].astype(np.uint64) + np.uint64(1)
        return out

    @classmethod
    def _piece_keys(cls, symbols) -> np.ndarray:
        keys = np.zeros(len(symbols), dtype=np.uint64)
        lengths = np.array([len(s) for s in symbols])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            rows = np.array([symbols[i] for i in at], dtype=np.int64).reshape(len(at), int(length))
            keys[at] = _span_hash(cls._prefix(rows), np.array([0]), int(length))[:, 0]
        return keys

    @staticmethod
    def _tails(rows) -> np.ndarray:
        total = np.zeros(len(rows), np.uint64)
        for k in range(SHORT):
            total = total * _BASE + np.array([r[k] for r in rows], np.uint64) + np.uint64(1)
        return mix(total)

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.unknown + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def admissible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps the boundary between pieces ``a`` and ``b``.

        The latest merges are undone first. After each step the two pieces at the boundary must not have a merge
        that comes before the merge just undone; among equal ranks the leftmost merge comes first.
        """
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), _NONE)
        while len(at):
            bad = self._pair_rank(a, b) < limit
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def prefixes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length (rows x length): piece count, last piece and its length at prefix 0..length."""
        n, length = rows.shape
        count = np.zeros((n, length + 1), dtype=np.int32)
        last = np.full((n, length + 1), -1, dtype=np.int64)
        back = np.zeros((n, length + 1), dtype=np.int32)
        hashes = self._prefix(rows)
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            piece = self._probe(_span_hash(hashes, starts, end))
            lone = piece[:, -1] < 0
            piece[lone, -1] = self.unknown
            r, c = np.nonzero(piece >= 0)
            found, before = piece[r, c], last[r, starts[c]]
            ok = starts[c] == 0
            rest = np.flatnonzero(~ok)
            if len(rest):
                pair = before[rest] * (self.unknown + 1) + found[rest]
                kinds, place = np.unique(pair, return_inverse=True)
                ok[rest] = self.admissible(kinds // (self.unknown + 1), kinds % (self.unknown + 1))[place]
            r, c, found = r[ok], c[ok], found[ok]
            last[r, end] = found
            back[r, end] = end - starts[c]
            count[r, end] = count[r, starts[c]] + 1
        return count, last, back

    def long_prefixes(self, word: np.ndarray, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``prefixes`` of one long word: its candidate pieces are probed for many ends at once, then ends are settled in a row.

        Pieces of more than ``SHORT`` symbols are looked for only where one with the same last ``SHORT`` symbols ends.
        """
        n = len(word)
        count, last, back = np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int32)
        for begin in range(0, n, chunk):
            low = max(begin - self.longest, 0)
            own = word[low : begin + chunk]
            # Polynomial prefix hashes of the chunk and what reaches into it, modulo 2^64.
            up = powers(BASE, len(own) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers(_INVERSE, len(own) + 1)[1:], dtype=np.uint64)]) * up
            ends = np.arange(begin + 1, min(begin + chunk, n) + 1) - low
            at, length, piece = [], [], []
            for size in range(1, min(self.longest, int(ends[-1])) + 1):
                places = ends[ends >= size]
                if size == SHORT + 1 and len(places):
                    tail = mix(sums[places] - sums[places - SHORT] * powers(BASE, SHORT + 1)[SHORT])
                    ends = places = places[np.isin(tail, self.tails)]
                if not len(places):
                    break
                if size not in self.sizes:
                    continue
                made = self._probe(mix(sums[places] - sums[places - size] * powers(BASE, size + 1)[size] + np.array([size], np.uint64) * _LENGTH))
                hit = made >= 0
                at.append(places[hit])
                length.append(np.full(hit.sum(), size))
                piece.append(made[hit])
            # A symbol without a piece of its own stands alone.
            first = np.arange(begin + 1, min(begin + chunk, n) + 1) - low
            single = np.zeros(int(first[-1]) + 1, dtype=bool)
            single[at[0][length[0] == 1] if length else []] = True
            alone = first[~single[first]]
            at, length, piece = (np.concatenate([*x, y]) for x, y in ((at, alone), (length, np.ones(len(alone), np.int64)), (piece, np.full(len(alone), self.unknown))))
            order = np.argsort(at, kind="stable")
            at, length, piece = at[order], length[order], piece[order]
            fits = self._neighbours(at, length, piece, last[low : begin + 1])
            width = self.unknown + 1
            lasts, counts, backs = last[low : begin + 1].tolist(), count[low : begin + 1].tolist(), []
            bounds = np.searchsorted(at, first).tolist() + [len(at)]
            length, piece = length.tolist(), piece.tolist()
            for i, end in enumerate(first.tolist()):
                # Exactly one candidate is admissible.
                for k in range(bounds[i], bounds[i + 1]):
                    before = end - length[k]
                    if before + low == 0 or lasts[before] * width + piece[k] in fits:
                        lasts.append(piece[k])
                        backs.append(length[k])
                        counts.append(counts[before] + 1)
                        break
            stop = begin + len(backs) + 1
            last[low:stop], count[low:stop], back[begin + 1 : stop] = lasts, counts, backs
        return count, last, back

    def _neighbours(self, at: np.ndarray, length: np.ndarray, piece: np.ndarray, settled: np.ndarray) -> set[int]:
        """Keys of the admissible pairs among candidates that meet: of one that ends where the other starts, or the settled last piece there."""
        width, start = self.unknown + 1, at - length
        early = start < len(settled)
        keys = [(settled[start[early]] * width + piece[early])[settled[start[early]] >= 0]]
        first, behind = np.searchsorted(at, start[~early]), np.searchsorted(at, start[~early], side="right")
        counts = behind - first
        k = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        keys.append(piece[k] * width + np.repeat(piece[~early], counts))
        keys = np.unique(np.concatenate(keys))
        return set(keys[self.admissible(keys // width, keys % width)].tolist())

    def grouped(self, encoded: list[bytes], dtype) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """(places in ``encoded``, counts, last pieces, backpointers) of words given as packed symbols of ``dtype``.

        Words of one length advance together, in groups of bounded size.
        """
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(encoded):
            by_length.setdefault(len(word), []).append(i)
        for size, members in by_length.items():
            length = size // np.dtype(dtype).itemsize
            if length > LONG:
                for i in members:
                    made = self.long_prefixes(np.frombuffer(encoded[i], dtype=dtype).astype(np.int64))
                    yield [i], *(x[None, :] for x in made)
                continue
            step = max(CELLS // max(length * min(length, self.longest), 1), 1)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                rows = np.frombuffer(b"".join([encoded[i] for i in part]), dtype=dtype).reshape(len(part), length).astype(np.int64)
                yield part, *self.prefixes(rows)


def paths(last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of whole words by their backpointers, aligned at the right end, and their number."""
    n, length = last.shape[0], last.shape[1] - 1
    rows, at = np.arange(n), np.full(n, length)
    columns, number = [], np.zeros(n, dtype=np.int64)
    while (at > 0).any():
        going = at > 0
        columns.append(last[rows, at])
        number += going
        at = np.where(going, at - back[rows, at], 0)
    return (np.stack(columns[::-1], axis=1) if columns else np.zeros((n, 0), dtype=np.int64)), number


class Known(dict):
    """Results of words met before, in two generations: what is asked for again moves on, the rest is dropped when full."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.size, self.old = limit, 0, {}

    def unknown(self, words) -> list:
        new = []
        for w in set(words):
            if w not in self:
                held = self.old.get(w)
                if held is None:
                    new.append(w)
                else:
                    self.add(w, held)
        return new

    def add(self, word, value) -> None:
        self[word] = value
        self.size += 240 + 2 * len(word) + len(value)

    def turn(self) -> None:
        """To be called between texts: the words of one batch all stay until then."""
        if self.size > self.limit // 2:
            self.old = dict(self)
            self.clear()
            self.size = 0

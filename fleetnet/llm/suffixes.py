"""Blockwise suffix sorting with a difference cover, for one block of text in memory.

Suffixes are sorted one bucket at a time. Two suffixes of a bucket are compared by their first bytes up to a distance,
less than PERIOD, at which both reach a position of the cover sample; there the precomputed ranks of the sample decide.
Ties of any length so cost one lookup, and no more is held than the block, its words and the sample's ranks.
"""

from __future__ import annotations

import numpy as np

PERIOD = 64


def difference_cover(period: int = PERIOD) -> list[int]:
    """A small set of residues whose differences are all residues; the next one chosen covers the most new differences."""
    chosen, covered = [0], {0}
    while len(covered) < period:
        gain = {r: len({(r - c) % period for c in chosen} | {(c - r) % period for c in chosen} - covered) - len({(r - c) % period for c in chosen} & covered) for r in range(period) if r not in chosen}
        best = max(gain, key=lambda r: (gain[r], -r))
        covered |= {(best - c) % period for c in chosen} | {(c - best) % period for c in chosen}
        chosen.append(best)
    return sorted(chosen)


COVER = difference_cover()


def _deltas() -> np.ndarray:
    """delta[a, b]: the least d with a + d and b + d both in the cover, modulo PERIOD."""
    member = np.zeros(PERIOD, dtype=bool)
    member[COVER] = True
    out = np.zeros((PERIOD, PERIOD), dtype=np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if member[(a + d) % PERIOD] and member[(b + d) % PERIOD])
    return out


DELTA = _deltas()


class Block:
    """A block of bytes with 8-byte words at every position and the ranks of its cover sample."""

    def __init__(self, data: np.ndarray, depth: int) -> None:
        self.depth = depth
        pad = np.zeros(depth + 8 * PERIOD, dtype=np.uint8)
        text = np.concatenate([data, pad])
        self.words = np.empty(len(text) - 8, dtype=np.uint64)
        for r in range(8):
            n = len(self.words[r::8])
            self.words[r::8] = text[r : r + 8 * n].view(">u8")[:n]
        size = len(data) + PERIOD
        at = np.arange(size, dtype=np.int64)
        at = at[np.isin(at % PERIOD, COVER)]
        order = np.lexsort([self.words[at + 8 * k] for k in range(PERIOD // 8 - 1, -1, -1)])
        sorted_at = at[order]
        new = np.zeros(len(at), dtype=bool)
        for k in range(PERIOD // 8):
            w = self.words[sorted_at + 8 * k]
            new[1:] |= w[1:] != w[:-1]
        self.rank = np.zeros(len(text) + depth, dtype=np.int64)
        self.rank[sorted_at] = np.cumsum(new) + 1
        self.short, self.reach = self.rank, PERIOD
        reach = PERIOD
        while reach < depth:  # prefix doubling: the sample is closed under shifts by multiples of PERIOD
            key = self.rank[at] * np.int64(len(at) + 2) + self.rank[at + reach]
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.zeros_like(self.rank)
            rank[at[order]] = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(key) else 0
            self.rank, reach = rank, 2 * reach
            if 2 * reach <= depth:
                self.short, self.reach = self.rank, reach

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of suffixes; 0: equal in ``depth`` bytes at least."""
        delta = DELTA[i % PERIOD, j % PERIOD]
        a, b = self.rank[i + delta], self.rank[j + delta]
        out = np.sign(a - b).astype(np.int8)
        left, k = np.arange(len(i)), 0
        while True:  # the words before the common sample position come first
            left = left[delta[left] > k]
            if not len(left):
                return out
            keep = np.minimum(delta[left] - k, 8).astype(np.uint64)
            drop = (np.uint64(8) - keep) * np.uint64(8)
            x, y = self.words[i[left] + k] >> drop, self.words[j[left] + k] >> drop
            differ = x != y
            out[left[differ]] = np.where(x[differ] < y[differ], -1, 1)
            left, k = left[~differ], k + 8

    def sort(self, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and buckets, ordered by bucket and, within each, by suffix: three-way partitions about pivots."""
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order].copy(), bucket[order]
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, dtype=np.int64)
        starts, sizes = edges[:-1], np.diff(edges)
        while True:
            open_ = sizes > 1
            starts, sizes = starts[open_], sizes[open_]
            if not len(starts):
                return at, bucket
            group = np.repeat(np.arange(len(starts)), sizes)
            within = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            where = np.repeat(starts, sizes) + within
            mine = at[where]
            side = self.compare(mine, np.repeat(at[starts + sizes // 2], sizes)).astype(np.int64) + 1
            order = np.argsort(group * 3 + side, kind="stable")
            at[where] = mine[order]
            counts = np.bincount(group * 3 + side, minlength=3 * len(starts)).reshape(-1, 3)
            starts = np.concatenate([starts, starts + counts[:, 0] + counts[:, 1]])
            sizes = np.concatenate([counts[:, 0], counts[:, 2]])

    def agree(self, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
        """Whether the suffixes of each pair share their first ``length`` bytes (length - reach is at least PERIOD)."""
        delta = DELTA[i % PERIOD, j % PERIOD]
        out = self.short[i + delta] == self.short[j + delta]
        alive = np.flatnonzero(out)
        for k in range(0, length, 8):
            inside = (k >= delta[alive]) & (k + 8 <= delta[alive] + self.reach)  # the sample's ranks say so already
            ask = alive[~inside]
            if k + 8 <= length:
                wrong = self.words[i[ask] + k] != self.words[j[ask] + k]
            else:
                drop = np.uint64(8 * (k + 8 - length))
                wrong = self.words[i[ask] + k] >> drop != self.words[j[ask] + k] >> drop
            out[ask[wrong]] = False
            if wrong.any():
                alive = alive[out[alive]]
        return out


def repeated(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Whether each window (its start in ``at``) of ``length`` bytes equals another one of its bucket.

    Windows that can be equal must be in one bucket; a window's bytes must lie inside its fragment of ``data``.
    """
    block = Block(data, length)
    order = np.argsort(at, kind="stable")
    place, kind = block.sort(at, bucket)
    near = np.flatnonzero(kind[1:] == kind[:-1])
    same = near[block.agree(place[near], place[near + 1], length)]
    hit = np.zeros(len(at), dtype=bool)
    hit[same] = hit[same + 1] = True
    found = np.zeros(len(at), dtype=bool)
    found[order[np.searchsorted(at[order], place[hit])]] = True
    return found

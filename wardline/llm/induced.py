"""Induced suffix sorting of one shard, with queues on disk and common-prefix values.

Seeds (suffixes at local minima) are sorted first; all others follow by induction: a
suffix popped in order pushes its left neighbour into the queue of that neighbour's first
character. Popping by character, then by arrival, is a monotone priority queue, so each
queue is only ever appended to and read in order, and lives in a file once the shard
outgrows its memory. Every tuple carries the common prefix with the tuple before it, up to
``depth``; a pushed one gets the least value since the last push to that queue, plus one.

Only order and common prefixes up to ``depth`` matter here, so the seeds are refined by
rounds of ``_WORD`` characters among ties, not by recursion to full depth."""
from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_WORD = 7  # characters of 9 bits in one 63-bit key


def _keys(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(_WORD):
        out = (out << 9) | text[at + k]
    return out


def sort_seeds(text: np.ndarray, seeds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds in order of their first ``depth`` characters, and each one's common prefix with the one before."""
    n = len(seeds)
    out, lcp, head, slot = seeds.copy(), np.full(n, depth, np.int16), np.zeros(n, np.int64), np.arange(n)
    for r in range(0, depth, _WORD):
        tied = head != slot
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = _keys(text, out[at] + r)
        order = np.lexsort((key, head[at]))
        out[at], key, group = out[at][order], key[order], head[at]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        split = np.flatnonzero(new[1:] & (group[1:] == group[:-1])) + 1
        differ = key[split] ^ key[split - 1]
        lcp[at[split]] = np.minimum(depth, r + _WORD - 1 - (np.log2(differ.astype(np.float64)) // 9).astype(np.int64))
        head[at] = np.maximum.accumulate(np.where(new, at, 0))
    if n:
        lcp[0] = 0
    return out, lcp


class Queues:
    """First-in first-out queues of (position, common prefix), one per character; chunks
    beyond ``memory`` bytes go to a temporary file that ends with the shard."""

    def __init__(self, memory: int):
        self.chunks: dict[int, list] = {}
        self.room, self.file = memory, None

    def push(self, char: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if size <= self.room:
            self.room -= size
            self.chunks.setdefault(char, []).append((pos, lcp))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        at = self.file.tell()
        pos.tofile(self.file)
        lcp.tofile(self.file)
        self.chunks.setdefault(char, []).append((at, len(pos)))

    def _load(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(a, np.ndarray):
            return a, b
        self.file.seek(a)
        return np.fromfile(self.file, np.int64, b), np.fromfile(self.file, np.int16, b)

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that waits under a character, in order of arrival."""
        waiting = self.chunks.pop(char, None)
        if not waiting:
            return None
        for a, b in waiting:
            if isinstance(a, np.ndarray):
                self.room += a.nbytes + b.nbytes
        parts = [self._load(a, b) for a, b in waiting]
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])


def _common(text: np.ndarray, i: int, j: int, depth: int) -> int:
    differ = np.flatnonzero(text[i:i + depth] != text[j:j + depth])
    return int(differ[0]) if len(differ) else depth


class _Spread:
    """Pushes left neighbours of scanned suffixes, with their common prefixes."""

    def __init__(self, text: np.ndarray, right_type: np.ndarray, queues: Queues, chars: int, depth: int):
        self.text, self.right_type, self.queues, self.depth = text, right_type, queues, depth
        self.least = np.full(chars, -1, np.int16)  # since the last push to a queue; -1: none yet

    def __call__(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        at = np.flatnonzero((pos > 0) & self.right_type[pos - 1])
        before = self.least.copy()
        np.minimum(self.least, lcp.min(), out=self.least)
        if not len(at):
            return
        left = pos[at] - 1
        char = self.text[left]
        order = np.argsort(char, kind="stable")
        char = char[order]
        cut = np.flatnonzero(np.diff(char, prepend=-1))
        for c, part in zip(char[cut].tolist(), np.split(order, cut[1:])):
            k = at[part]
            least = np.minimum.reduceat(lcp[:k[-1] + 1], np.append(0, k[:-1] + 1))
            least[0] = min(least[0], before[c])
            self.queues.push(c, left[part], np.minimum(least + 1, self.depth).astype(np.int16))
            self.least[c] = lcp[k[-1] + 1:].min() if k[-1] + 1 < len(lcp) else self.depth


def suffixes(body: np.ndarray, depth: int, memory: int = 1 << 26) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (position, common prefix with the suffix before it in this order), from the
    greatest suffix down. ``body`` holds characters from 1; a 0 is put behind it."""
    n = len(body) + 1
    text = np.zeros(n + depth + _WORD, np.int32)
    text[:n - 1] = body
    chars = int(text.max()) + 1
    step = np.sign(np.diff(text[:n], append=0))  # of a suffix against the next one
    step[-1] = 1
    known = np.where(step != 0, np.arange(n), n - 1)
    small = step[np.minimum.accumulate(known[::-1])[::-1]] > 0  # smaller than the next suffix
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds, seed_lcp = sort_seeds(text, seeds, depth)
    first = text[seeds]
    present = np.flatnonzero(np.bincount(text[:n], minlength=chars)).tolist()

    large = Queues(memory)
    queue = Queues(memory)
    spread = _Spread(text, ~small, queue, chars, depth)
    for c in present:
        last = None
        while (chunk := queue.pop(c)) is not None:
            large.push(c, *chunk)
            spread(*chunk)
            last = int(chunk[0][-1])
        a, b = np.searchsorted(first, [c, c + 1])
        if a < b:
            lcp = seed_lcp[a:b].copy()
            lcp[0] = 0 if last is None else _common(text, last, int(seeds[a]), depth)
            spread(seeds[a:b], lcp)

    queue = Queues(memory)
    spread = _Spread(text, small, queue, chars, depth)
    # The 0 behind the text is the least suffix and starts nothing in this direction.
    for c in reversed(present):
        last = None
        while (chunk := queue.pop(c)) is not None:
            spread(*chunk)
            last = int(chunk[0][-1])
            yield chunk
        if (chunk := large.pop(c)) is not None:
            pos, lcp = chunk[0][::-1].copy(), np.append(np.int16(0), chunk[1][:0:-1])
            lcp[0] = 0 if last is None else _common(text, last, int(pos[0]), depth)
            spread(pos, lcp)
            yield pos, lcp

"""A unigram model over the pieces of a SentencePiece file, and its best paths.

The file's pieces are ranked, not weighted: piece i gets Zipf's log probability
-ln(27 + i), rounded to 2^-12 so that sums are exact. A character without a piece of its own
is spelled by the byte pieces of its UTF-8 form. Each token costs 2^-22 more, so of equal
paths the one of fewer tokens wins. Spaces are written as U+2581; pieces hold it in front
only, so every path breaks before a run of it: what lies between two breaks is a unit. ``MARK``
stands for a U+2581 that a text holds itself; no piece has it, so it is spelled."""
from __future__ import annotations

import functools
import os.path
import re
from array import array

import numpy as np

SPACE = "▁"
MARK = "\ud800"  # no text can hold it
_QUANTUM, _TOKEN = 2.0 ** -12, 2.0 ** -22
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_B = np.uint64(0x9E3779B97F4A7C15)
#: Words of the trie (or paths) that are cheaper one by one than as arrays.
_FEW = 32


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        self.ids: dict[str, int] = {}
        self.pieces: list[bytes] = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte[b], self.pieces[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[model.id_to_piece(i)] = i
                self.pieces[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        self.value = np.round(-np.log(27.0 + np.arange(n)) / _QUANTUM) * _QUANTUM - _TOKEN
        self.longest = max(map(len, self.ids))
        self.values: list[float] = self.value.tolist()
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            ends.setdefault(p[-1], set()).add(len(p))
        #: Lengths of the pieces that end in a character.
        self.ends = {c: sorted(k) for c, k in ends.items()}
        self.tables = []
        for k in range(1, self.longest + 1):
            of = [(p, i) for p, i in self.ids.items() if len(p) == k]
            h = np.zeros(len(of), np.uint64)
            for j in range(k):
                h = h * _B + np.array([ord(p[j]) for p, _ in of], np.uint64)
            order = np.argsort(h)
            maybe = np.zeros(1 << 16, bool)
            maybe[(h * _B >> np.uint64(48)).astype(np.int64)] = True
            self.tables.append((h[order], np.array([i for _, i in of], np.int64)[order], maybe))

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        """Ids of pieces of k characters by hash; -1 where there is none."""
        known, ids, maybe = self.tables[k - 1]
        out = np.full(len(h), -1)
        at = np.flatnonzero(maybe[(h * _B >> np.uint64(48)).astype(np.int64)])
        if len(at) and len(known):
            j = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            hit = known[j] == h[at]
            out[at[hit]] = ids[j[hit]]
        return out

    def spelled(self, char: str) -> tuple[list[int], float]:
        """Byte pieces of one character and their value."""
        raw = " " if char == SPACE else SPACE if char == MARK else char
        ids = [int(self.byte[b]) for b in raw.encode()]
        return ids, float(self.value[ids].sum())

    def edges(self, text: str, at: int) -> list[tuple[int, float, int]]:
        """(length, value, id) of what may start at a character; id -1: spelled by bytes."""
        out = [(k, float(self.value[i]), i) for k in range(1, self.longest + 1)
               if at + k <= len(text) and (i := self.ids.get(text[at:at + k], -1)) >= 0]
        return out if any(k == 1 for k, _, _ in out) else out + [(1, self.spelled(text[at])[1], -1)]


@functools.lru_cache
def vocabulary(name: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


class Trie:
    """Units as a trie: level by level, each distinct prefix is a node whose forward score is
    computed once, from those of its ancestors. Words are the units in order; of each are
    kept its value and, per character, how the best path to there ends: the shortest last piece
    of the best ones, or -1 less the character if that is spelled by several bytes. A level of few words is
    done word by word, each from where it leaves the word before, so units may have any length."""

    def __init__(self, v: Vocabulary, units: list[str]):
        self.order = sorted(range(len(units)), key=units.__getitem__)
        words = [units[i] for i in self.order]
        self.size = np.array([len(w) for w in words], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.step, self.piece = np.zeros(len(chars), np.int8), np.zeros(len(chars), np.int32)
        self.value = np.zeros(len(words))
        spelled = {}  # value and (coded) piece of characters without a piece
        for c in np.unique(chars).tolist():
            if chr(c) not in v.ids:
                ids, value = v.spelled(chr(c))
                spelled[c] = value, ids[0] if len(ids) == 1 else -1 - c

        node = np.zeros(len(words), np.int64)  # each word's node on the level above
        scores, hashes = [np.zeros(1)], []  # by distance to the ancestor; of the last 1, 2, ... characters
        depth, alive = 0, np.flatnonzero(self.size > 0)
        while len(alive) > _FEW:
            above, c = node[alive], chars[self.begin[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (above[1:] != above[:-1]) | (c[1:] != c[:-1])
            here = np.cumsum(new) - 1
            parent, char = above[new], c[new]
            code = char.astype(np.uint64)
            reach = min(depth + 1, v.longest)
            before = [s[parent] for s in scores[:reach]]
            # A hash is that of the characters in order: the last one is added at the end.
            hashes = [code] + [h[parent] * _B + code for h in hashes[:reach - 1]]
            best = np.full(len(parent), -np.inf)
            how, what = np.zeros(len(parent), np.int8), np.zeros(len(parent), np.int32)
            bare = np.isin(char, np.array(list(spelled), np.uint32)) if spelled else np.zeros(len(char), bool)
            if bare.any():
                best[bare] = before[0][bare] + np.array([spelled[x][0] for x in char[bare].tolist()])
                how[bare] = 1
                what[bare] = [spelled[x][1] for x in char[bare].tolist()]
            for k in range(1, reach + 1):
                ids = v.find(k, hashes[k - 1])
                at = np.flatnonzero(ids >= 0)
                value = before[k - 1][at] + v.value[ids[at]]
                better = value > best[at]
                at, value = at[better], value[better]
                best[at], how[at], what[at] = value, k, ids[at]
            scores = [best, *before]
            node[alive] = here
            at = self.begin[alive] + depth
            self.step[at], self.piece[at] = how[here], what[here]
            depth += 1
            ends = self.size[alive] == depth
            self.value[alive[ends]] = best[here[ends]]
            alive = alive[~ends]
        self._tails(v, spelled, words, alive.tolist(), depth, {w: [float(s[node[w]]) for s in scores[::-1]] for w in alive.tolist()})

    def _tails(self, v: Vocabulary, spelled: dict[int, tuple[float, int]], words: list[str], alive: list[int], depth: int,
               scores: dict[int, list[float]]) -> None:
        """The levels from ``depth`` on of the words that reach it. ``scores``: of the last nodes on their way."""
        step, piece = memoryview(self.step), memoryview(self.piece)
        lookup, ends, values = v.ids.get, v.ends, v.values
        last, best = None, array("d")
        for w in alive:
            word, base = words[w], int(self.begin[w])
            shared = depth if last is None else max(depth, len(os.path.commonprefix([word, words[last]])))
            low = depth + 1 - len(scores[w])  # the first character whose score is kept
            if shared == depth:
                best = array("d", scores[w])
            else:
                del best[shared + 1 - low:]
                of = int(self.begin[last])
                step[base + depth:base + shared], piece[base + depth:base + shared] = step[of + depth:of + shared], piece[of + depth:of + shared]
            for i in range(shared, len(word)):
                char, top, how, what = word[i], -np.inf, 0, 0
                if (bare := spelled.get(ord(char))) is not None:
                    top, how, what = best[i - low] + bare[0], 1, bare[1]
                for k in ends.get(char, ()):
                    if k > i + 1:
                        break
                    p = lookup(word[i + 1 - k:i + 1])
                    if p is not None and (value := best[i + 1 - k - low] + values[p]) > top:
                        top, how, what = value, k, p
                best.append(top)
                step[base + i], piece[base + i] = how, what
            self.value[w], last = best[-1], w

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The best paths, flat, and where each word's starts; it ends where the word does."""
        ids, left, start = np.zeros(len(self.piece), np.int32), self.end.copy(), self.end.copy()
        at = np.flatnonzero(self.size > 0)
        while len(at) > _FEW:  # backwards
            here = left[at] - 1
            start[at] -= 1
            ids[start[at]] = self.piece[here]
            left[at] -= self.step[here]
            at = at[left[at] > self.begin[at]]
        step, piece, out = memoryview(self.step), memoryview(self.piece), memoryview(ids)
        for w in at.tolist():
            first, i, j = int(self.begin[w]), int(left[w]), int(start[w])
            while i > first:
                j -= 1
                out[j] = piece[i - 1]
                i -= step[i - 1]
            start[w] = j
        return ids, start


def trie_counts(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and score of every unit."""
    t = Trie(v, units)
    ids, start = t.paths()
    used = t.end - start
    odd = np.flatnonzero(ids < 0)  # characters of several byte pieces
    char = -1 - ids[odd]
    used += np.bincount(np.searchsorted(t.begin, odd, "right") - 1, 1 + (char >= 0x800) + (char >= 0x10000), len(units)).astype(np.int64)
    value, tokens = np.zeros(len(units)), np.zeros(len(units), np.int64)
    value[t.order], tokens[t.order] = t.value, used
    return tokens, value + tokens * _TOKEN


def trie_paths(v: Vocabulary, units: list[str]) -> list[bytes]:
    """The best path of every unit, as int32."""
    t = Trie(v, units)
    ids, start = t.paths()
    flat, paths = ids.tobytes(), [b""] * len(units)
    for i, lo, hi in zip(t.order, (start * 4).tolist(), (t.end * 4).tolist()):
        paths[i] = flat[lo:hi]
    for w in np.unique(np.searchsorted(t.begin, np.flatnonzero(ids < 0), "right") - 1).tolist():
        path: list[int] = []
        for x in ids[start[w]:t.end[w]].tolist():
            path += [x] if x >= 0 else v.spelled(chr(-1 - x))[0]
        paths[t.order[w]] = np.array(path, np.int32).tobytes()
    return paths


class Paths(dict):
    """Best paths (as int32 bytes) of units, kept while there are at most ``room``."""

    def __init__(self, v: Vocabulary, room: int = 200_000):
        super().__init__()
        self.v, self.room = v, room

    def learn(self, units: set[str]) -> None:
        if len(self) > self.room:
            self.clear()
        new = [u for u in units if u not in self]
        self.update(zip(new, trie_paths(self.v, new)))

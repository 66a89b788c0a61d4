"""Byte-pair merges as a lazily determinised finite-state transducer.

A token sequence is the merge result of its bytes exactly if every neighbouring pair is stable: no merge across
their boundary comes before the merges that made the two. So the merges are a transducer whose states are last
tokens and whose transitions read one token's bytes; it is non-deterministic only in where a token ends.
Determinisation follows all hypotheses over the bytes ahead and emits what they share, so output waits for a
bounded lookahead only. Transitions of the deterministic machine are made when a text first needs them, kept up to
a length, and dropped when there are too many, which bounds memory.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import unicodedata
from functools import lru_cache

import regex


class Merges:
    """A vocabulary with its merges. ``pair(a, b)`` gives (rank, token) of a merge, or None."""

    def __init__(self, tokens: list[bytes], pair):
        self.tokens, self.pair = tokens, pair
        self.byte_id = {t[0]: i for i, t in enumerate(tokens) if t is not None and len(t) == 1}

    @staticmethod
    def from_ranks(path: str) -> Merges:
        """A rank file: one base64 token and its rank a line; two tokens merge if their concatenation is a token."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens: list = [None] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t

        def pair(a: int, b: int, get=ranks.get):
            i = get(tokens[a] + tokens[b])
            return None if i is None else (i, i)

        return Merges(tokens, pair)

    @staticmethod
    def from_json(path: str) -> Merges:
        """A tokenizer file with an explicit list of merges over the byte-level alphabet."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in byte_alphabet().items()}
        vocab = {k: v for k, v in model["vocab"].items() if all(c in back for c in k)}
        tokens: list = [None] * (max(vocab.values()) + 1)
        for k, v in vocab.items():
            tokens[v] = bytes(back[c] for c in k)
        table = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            table[vocab[a], vocab[b]] = (r, vocab[a + b])
        return Merges(tokens, lambda a, b: table.get((a, b)))

    def merge(self, data: bytes) -> tuple[list[int], tuple[int, int, int] | None]:
        """The merges by definition, lowest rank first, leftmost first, and the last one made: (rank, left, right). For short strings."""
        ids, pair, last = [self.byte_id[b] for b in data], self.pair, None
        while len(ids) > 1:
            best = min((p[0], k, p[1]) if (p := pair(ids[k], ids[k + 1])) else (sys.maxsize, k, 0) for k in range(len(ids) - 1))
            if best[0] == sys.maxsize:
                break
            last = (best[0], ids[best[1]], ids[best[1] + 1])
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids, last


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from code point 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(keep))
    return out


class Transducer:
    """States are last tokens (-1: none yet). A transition reads a window of the bytes ahead and emits
    the tokens that every live hypothesis agrees on; it is derived at first use and kept, up to
    ``most`` of them. ``window`` is the lookahead that nearly always decides; where it doesn't, it doubles."""

    def __init__(self, merges: Merges, window: int = 12, most: int = 80_000):
        self.merges, self.window, self.most = merges, window, most
        self._ids = {t: i for i, t in enumerate(merges.tokens) if t is not None}
        self._open = {t[:k] for t in self._ids for k in range(1, len(t))}
        self._longest = max(map(len, self._ids))
        self._made: dict[int, tuple | None] = {}
        self._stable: dict[int, bool] = {}
        self._ends: dict = {}
        self.moves: dict = {}

    def _parts(self, t: int):
        """The merge (rank, left, right) that makes a token of its bytes: () for a byte, None if merging does not lead to it."""
        made = self._made.get(t, 0)
        if made == 0:
            ids, last = self.merges.merge(self.merges.tokens[t])
            made = self._made[t] = None if ids != [t] else last or ()
        return made

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a. Their merges are undone from the last one on (of equal ranks the right one
        is later); at each moment the tokens at the boundary must not merge before the one that was undone."""
        k = (a + 1) << 24 | b
        ok = self._stable.get(k)
        if ok is not None:
            return ok
        if len(self._stable) > 4 * self.most:
            self._stable.clear()
        y = self._parts(b)
        ok = y is not None
        if ok and a >= 0:
            x, pair, before = self._parts(a), self.merges.pair, sys.maxsize
            left, right = a, b
            while True:
                met = pair(left, right)
                if met and met[0] < before:
                    ok = False
                    break
                if not x and not y:
                    break
                if x and (not y or x[0] > y[0]):
                    before, left = x[0], x[2]
                    x = self._parts(left)
                else:
                    # the left one of two equal merges comes first, and the boundary is left of this one
                    before, right = y[0] + 1, y[1]
                    y = self._parts(right)
        self._stable[k] = ok
        return ok

    def _end(self, a: int, data: bytes, keep: bool = True):
        """The token that ends ``data`` after state a, and where it begins: just one can, as a string has one tokenization; None
        if no path from a ends here. What it says of beginnings is kept, since many strings share them."""
        key = data if a < 0 else (a, data)
        found = self._ends.get(key, 0)
        if found != 0:
            return found
        ids, stable, n, found = self._ids, self._stable, len(data), None
        for q in range(n - self._longest if n > self._longest else 0, n):
            t = ids.get(data[q:])
            if t is None:
                continue
            before = a
            if q:
                prior = self._end(a, data[:q])
                if prior is None:
                    continue
                before = prior[0]
            ok = stable.get((before + 1) << 24 | t)
            if ok or ok is None and self._fits(before, t):
                found = (t, q)
                break
        if keep:
            if len(self._ends) >= self.most:
                self._ends.clear()
            self._ends[key] = found
        return found

    def determinise(self, a: int, ahead: bytes, ends: bool) -> tuple[tuple, int] | None:
        """Tokens that follow state a whatever comes after ``ahead`` (or if nothing does), and how many
        bytes they read; None if that is still open. Hypotheses are the beginnings from which the rest of the
        window could still grow to a token; what their paths back to the state share from the left is certain."""
        n, steps = len(ahead), {}

        def back(q):
            if q not in steps:
                steps[q] = self._end(a, ahead[:q], q < n)
            return steps[q]

        at = {n} if ends else {q for q in range(max(0, n - self._longest), n + 1) if (q == n or ahead[q:] in self._open) and (not q or back(q))}
        while len(at) > 1:
            q = max(at)
            at.discard(q)
            at.add(back(q)[1])
        n = at.pop()
        if n <= 0:
            return None
        out, p = [], n
        while p > 0:
            t, p = back(p)
            out.append(t)
        return tuple(reversed(out)), n

    def _move(self, a: int, data: bytes, i: int):
        """The transition from a at byte i: the window grows until it decides, and what it decides is kept."""
        moves, w, n = self.moves, self.window, len(data)
        while True:
            ahead, ends = data[i : i + w], i + w > n
            # in a first window the length tells whether the bytes end there; a longer one needs it in its key
            key = (a, ahead) if w == self.window else (a, ahead, ends)
            made = moves.get(key)
            if made is None:
                got = self.determinise(a, ahead, ends)
                made = (got[0], got[1], len(got[0]), got[0][-1]) if got else ()
                # whole pre-tokens are kept by who asks for them, and very long windows are not kept
                if not (a < 0 and ends) and w <= 4 * self.window:
                    if len(moves) >= self.most:
                        moves.clear()
                    moves[key] = made
            if made:
                return made
            w *= 2

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one pre-token."""
        moves, w, a, i, n, out = self.moves, self.window, -1, 0, len(data), []
        while i < n:
            m = moves.get((a, data[i : i + w])) or self._move(a, data, i)
            out += m[0]
            i += m[1]
            a = m[3]
        return out

    def run(self, data: bytes, a: int = -1) -> tuple[int, int]:
        """From state a over all of ``data``: the tokens emitted, as annotated on the transitions, and the last state."""
        moves, w, i, n, c = self.moves, self.window, 0, len(data), 0
        while i < n:
            m = moves.get((a, data[i : i + w])) or self._move(a, data, i)
            c += m[2]
            i += m[1]
            a = m[3]
        return c, a


@lru_cache(4)
def _patterns(pattern: str):
    r"""The pre-token pattern for texts within Latin-1, where \p{L}, \p{N} and \s become small plain
    classes and the standard library's engine is fastest, and for all texts."""
    kinds: dict[str, str] = {"L": "", "N": ""}
    for cp in range(256):
        k = unicodedata.category(chr(cp))[0]
        if k in kinds:
            kinds[k] += f"\\x{cp:02x}"
    space = "\\t-\\r \\x85\\xa0"
    p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kinds['L']}{kinds['N']}]")
    p = p.replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]")
    return re.compile(p.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")), regex.compile(pattern)


_WIDE = re.compile("[^\x00-\xff]")


def split(pattern: str, text: str) -> list[str]:
    """All pre-tokens of a text."""
    narrow, wide = _patterns(pattern)
    return (wide if _WIDE.search(text) else narrow).findall(text)


class WordTable(dict):
    """Pre-token -> what ``make`` gives for it, filled on demand. At ``most`` entries they become the old ones, and those before
    them go; an old entry that is asked for is young again. So at most twice ``most`` are held, the frequent ones always."""

    def __init__(self, make, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, word):
        out = self.old.get(word, self)
        if out is self:
            out = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out

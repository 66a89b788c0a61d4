"""Operators 1 and 3: byte-level BPE encoding, decoding and counting by the merge transducer.

Both run in ``mapInArrow``: a row never leaves its partition, so there is no shuffle, a lost
executor costs its tasks only, and memory is one Arrow batch plus the bounded transition tables.
Cases: a null text counts as empty (0 tokens); columns of the input beside the key and the text are
not read; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import tidy
from .transducer import Merges, Transducer, WordTable, split

PATTERN = public_tokenizers.PATTERN

_TRANSDUCERS: dict = {}


def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, one per Python worker."""
    if path not in _TRANSDUCERS:
        load = Merges.from_json if path.endswith(".json") else Merges.from_ranks
        _TRANSDUCERS[path] = Transducer(load(path))
    return _TRANSDUCERS[path]


_MADE: dict = {}


def _once(kind, *args):
    """One codec or counter per Python worker, so that a worker's next task finds its tables filled."""
    if (kind, args) not in _MADE:
        _MADE[kind, args] = kind(*args)
    return _MADE[kind, args]


class Utf8Stream:
    """Incremental UTF-8 decoding by a state machine. The states say which bytes may come next: none open (0), one, two or three
    continuation bytes (1 to 3), and what follows the four leads whose next byte is narrower (4 to 7). An ASCII byte leads
    to state 0 from all, so only what comes after the last one is stepped through.

    ``feed`` returns the text that is certain; ``close`` turns what is unfinished into U+FFFD."""

    #: Lead bytes (first, last) and the state that follows.
    LEADS = ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))
    #: Which bytes a state takes, and the state that follows.
    NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    TAIL = re.compile(rb"[\x80-\xff]*\Z")

    def __init__(self):
        self.open = b""

    @classmethod
    def step(cls, state: int, byte: int) -> int:
        """The next state, or -1 if the byte cannot come next."""
        if state:
            low, high, after = cls.NEXT[state]
            return after if low <= byte <= high else -1
        if byte < 0x80:
            return 0
        return next((s for low, high, s in cls.LEADS if low <= byte <= high), -1)

    def feed(self, data: bytes) -> str:
        data = self.open + data
        state, begin = 0, len(data)
        for i in range(self.TAIL.search(data, max(0, len(data) - 4)).start() if data[-1:] >= b"\x80" else len(data), len(data)):
            state, was = self.step(state, data[i]), state
            if state < 0 and was:
                was, state = 0, self.step(0, data[i])
            state = max(state, 0)
            if not was:
                begin = i
        n = begin if state else len(data)
        self.open = data[n:]
        return data[:n].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.open = self.open.decode("utf-8", "replace"), b""
        return out


class Codec:
    def __init__(self, path: str, pattern: str = PATTERN, held: int = 300_000):
        self.fst, self.pattern = transducer(path), pattern
        self.words = WordTable(lambda w: tuple(self.fst.encode(w.encode("utf-8"))), held)
        self.digits = [str(i) for i in range(len(self.fst.merges.tokens))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        for w in split(self.pattern, text):
            out += words[w]
        return out

    def decode(self, ids, step: int = 4096) -> Iterator[str]:
        """The text in pieces; each piece is what is certain after ``step`` more tokens."""
        state, tokens = Utf8Stream(), self.fst.merges.tokens
        for k in range(0, len(ids), step):
            yield state.feed(b"".join([tokens[i] for i in ids[k : k + step]]))
        yield state.close()


def _columns(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(df[key].cast("long").alias("k"), df[text].cast("string").alias("t"))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = True, pattern: str = PATTERN, held: int = 300_000) -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256``
    (of the bytes that decoding the ids gives) and, where ``ids`` is set, ``ids`` and ``decoded``. A worker holds
    the tokens of at most twice ``held`` pre-tokens."""

    def run(batches):
        codec = _once(Codec, path, pattern, held)
        digits = codec.digits
        for b in batches:
            n, h, d, lists, texts = [], [], [], [], []
            for t in b.column(1).to_pylist():
                out = codec.encode(t or "")
                n.append(len(out))
                h.append(hashlib.sha256(",".join([digits[i] for i in out]).encode()).hexdigest())
                sha, parts = hashlib.sha256(), []
                for piece in codec.decode(out):
                    sha.update(piece.encode("utf-8"))
                    if ids:
                        parts.append(piece)
                d.append(sha.hexdigest())
                if ids:
                    lists.append(out)
                    texts.append("".join(parts))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    return _columns(df, key, text).mapInArrow(tidy(run), schema)


def special_strings(path: str) -> tuple[str, ...]:
    """The special strings that a tokenizer file names."""
    with open(path, encoding="utf-8") as f:
        found = tuple(t["content"] for t in json.load(f).get("added_tokens", []))
    if any(c.isspace() for s in found for c in s):
        raise ValueError("special strings with white space could lie across boundaries")
    return found


class StateMap(NamedTuple):
    """What a chunk does to the state that enters it.

    A state is the open pre-token: the text since the last boundary. A non-space followed by white space is a boundary
    whatever stands around it, so all states meet at the chunk's first one. The map sends state s to the count of
    s + ``head`` plus ``count`` and the state ``tail``; a chunk without a boundary (``count`` None) sends s to s + ``head``."""

    head: str
    count: int | None
    tail: str


class Counter:
    """Token counts by state maps. Counts stand on the transducer's transitions (``Transducer.run``); the maps of a text's chunks
    are composed by a prefix scan in rounds that double the reach, as composition is associative."""

    def __init__(self, path: str, pattern: str = PATTERN, special: tuple[str, ...] = (), chunk: int = 1 << 16):
        self.fst, self.pattern, self.special, self.chunk = transducer(path), pattern, special, chunk
        self.words = WordTable(lambda w: self.fst.run(w.encode("utf-8"))[0])

    def tokens(self, text: str) -> int:
        """Tokens that a stretch between two boundaries emits from the start state."""
        for s in self.special:
            if s in text:
                parts = text.split(s)
                return len(parts) - 1 + sum(map(self.tokens, parts))
        words = self.words
        return sum([words[w] for w in split(self.pattern, text)])

    def state_map(self, text: str) -> StateMap:
        first = _BOUNDARY.search(text)
        if first is None:
            return StateMap(text, None, "")
        a = first.start() + 1
        b = a
        for back in range(len(text) - 1, a, -1):
            if _space(text[back]) and not _space(text[back - 1]):
                b = back
                break
        return StateMap(text[:a], self.tokens(text[a:b]) if b > a else 0, text[b:])

    def compose(self, f: StateMap, g: StateMap) -> StateMap:
        """First f, then g: f's open text meets g's head."""
        if f.count is None:
            m = self.state_map(f.head + g.head)
            if m.count is None:
                return StateMap(m.head, g.count, g.tail)
            return StateMap(m.head, m.count, m.tail) if g.count is None else StateMap(m.head, m.count + self.tokens(m.tail) + g.count, g.tail)
        m = self.state_map(f.tail + g.head)
        open_, n = (m.head, 0) if m.count is None else (m.tail, self.tokens(m.head) + m.count)
        return StateMap(f.head, f.count + n, open_) if g.count is None else StateMap(f.head, f.count + n + self.tokens(open_) + g.count, g.tail)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """The composition of every prefix: in each round a prefix takes up the one that ends where it begins."""
        step = 1
        while step < len(maps):
            maps = [m if k < step else self.compose(maps[k - step], m) for k, m in enumerate(maps)]
            step *= 2
        return maps

    def total(self, maps: list[StateMap]) -> StateMap:
        """The last prefix alone, in rounds of neighbours."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        m = self.total([self.state_map(text[k : k + self.chunk]) for k in range(0, len(text), self.chunk)] or [StateMap("", None, "")])
        return self.tokens(m.head) + ((m.count + self.tokens(m.tail)) if m.count is not None else 0)


def _space(c: str) -> bool:
    r"""White space as ``\s`` of the pre-token pattern; the separators 1c to 1f don't belong to it."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


#: The first non-space before white space; \x1c to \x1f are no white space for the pattern.
_BOUNDARY = re.compile(r"[^\s](?=[^\S\x1c-\x1f])|[\x1c-\x1f](?=[^\S\x1c-\x1f])")


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, special: tuple[str, ...] | None = None, chunk: int = 1 << 16) -> DataFrame:
    """Per row: ``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; a special string in a text (those the file names, unless given) counts as one token."""
    special = special_strings(path) if special is None else special

    def run(batches):
        counter = _once(Counter, path, PATTERN, special, chunk)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            size = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return _columns(df, key, text).mapInArrow(tidy(run), f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean")

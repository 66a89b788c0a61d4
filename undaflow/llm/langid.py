"""Operator 9: language of mixed-language texts by script ranges and Viterbi over word scores.

A model holds the log-probabilities of letter trigrams by language. It is learned from all labelled rows that
may be learned from: every task counts the trigrams of its whole texts and hands on one row a language and
trigram, and at most ``grams`` sums reach the driver, whatever the table's size.
The script range of a word's first letter narrows the languages to those that use the script; a word's
score is the sum over its trigrams; a path through the words pays ``penalty`` for each change of
language, and the best path labels spans. The language of most letters is predicted and its share is the
score. ``fit`` is the mean log-probability of the path by letter; ``fits`` holds where that is not four standard
errors below what drawing evenly from the language's own trigrams would give, as noise of known letters is.

All is done on arrays of code points for many texts at once; a very long text is cut between words, so
memory does not grow with its letters.

Cases: null texts and texts without letters (Unicode category L) are ``und`` with score 0, as is any text
if there is nothing to learn from; words of scripts that no learned language uses take no part, and a text
of such words alone gets the most frequent language with score 0; of equal paths the one that stays is
taken, of equal languages the first in order; null and repeated keys are rows like others; a null key is
learned from like any other; empty tables give empty tables; other columns are handed on by ``keep``
only, and those named like a result column are refused.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import tidy

#: First code points of script ranges.
SCRIPTS = ((0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"),
           (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x30000, "other"))
NAMES = sorted({name for _, name in SCRIPTS})
#: One above the last assigned letter.
LIMIT = 0x32400
NONE = -1e9
TRIGRAM, SCRIPT, DOC = 0, 1, 2


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower case, and its script."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(LIMIT)), bool, LIMIT)
    low = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(LIMIT)), np.uint32, LIMIT)
    of = np.array([NAMES.index(name) for _, name in SCRIPTS], np.uint8)
    return letter, low, of[np.searchsorted([s for s, _ in SCRIPTS], np.arange(LIMIT), side="right") - 1]


def read(text: str) -> tuple[np.ndarray, ...]:
    """Trigram codes, one a letter; the first letter's place among them, start, end and script of every word."""
    letter, low, script = tables()
    at = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), LIMIT - 1)
    is_letter = np.concatenate([[False], letter[at], [False]])
    v = np.full(len(at) + 2, 32, np.uint64)
    v[1:-1] = np.where(is_letter[1:-1], low[at], 32)
    p = np.flatnonzero(is_letter)
    codes = v[p - 1] << np.uint64(42) | v[p] << np.uint64(21) | v[p + 1]
    edge = np.flatnonzero(np.diff(is_letter.view(np.int8)))
    first, last = edge[0::2], edge[1::2]
    return codes, np.searchsorted(p, first + 1), first, last, script[at[first]]


def pieces(text: str, most: int) -> list[str]:
    """A text in pieces of about ``most`` characters, cut between words."""
    out, a = [], 0
    while len(text) - a > most:
        b = a + most
        while b < len(text) and unicodedata.category(text[b])[0] == "L":
            b += 1
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


class Model:
    """Log-probabilities by language from counts (lang, kind, code, n)."""

    def __init__(self, counts: list[tuple[str, int, int, int]], penalty: float = 12.0, smooth: float = 0.5):
        self.penalty = penalty
        docs = {x: n for x, kind, _, n in counts if kind == DOC}
        grams = [c for c in counts if c[1] == TRIGRAM]
        self.langs = sorted({x for x, _, _, _ in grams})
        at = {x: k for k, x in enumerate(self.langs)}
        self.fallback = min(self.langs, key=lambda x: (-docs.get(x, 0), x)) if self.langs else None
        self.keys = np.array(sorted({c for _, _, c, _ in grams}), np.uint64)
        n = np.zeros((len(self.keys) + 1, len(self.langs)))
        if grams:
            n[np.searchsorted(self.keys, np.array([c for _, _, c, _ in grams], np.uint64)), [at[x] for x, _, _, _ in grams]] = [k for _, _, _, k in grams]
        self.table = np.log(n + smooth) - np.log(n.sum(axis=0) + smooth * (len(self.keys) + 1))
        self.least = -np.log(np.maximum((n > 0).sum(axis=0), 1))
        share = np.exp(self.table)
        self.spread = np.sqrt(np.maximum((share * self.table**2).sum(axis=0) - (share * self.table).sum(axis=0) ** 2, 0.0))
        uses = np.zeros((len(NAMES), len(self.langs)))
        for x, kind, c, k in counts:
            if kind == SCRIPT and x in at:
                uses[c, at[x]] = k
        self.scripts = (uses > 0) & (uses >= 0.01 * uses.sum(axis=0))
        # a dense index where the alphabet is small
        self.letters = np.unique(np.concatenate([self.keys >> np.uint64(s) & np.uint64((1 << 21) - 1) for s in (42, 21, 0)])).astype(np.int64)
        k = len(self.letters) + 1
        self.dense = None
        if k <= 160:
            self.place = np.zeros(LIMIT, np.uint32)
            self.place[self.letters[self.letters < LIMIT]] = np.arange(1, k)[self.letters < LIMIT]
            self.dense = np.full(k**3, len(self.keys), np.int32)
            self.dense[self._dense(self.keys)] = np.arange(len(self.keys))

    def _dense(self, codes: np.ndarray) -> np.ndarray:
        k, m = len(self.letters) + 1, np.uint64((1 << 21) - 1)
        a, b, c = (self.place[(codes >> np.uint64(s) & m).astype(np.int64)] for s in (42, 21, 0))
        return (a * np.uint32(k) + b) * np.uint32(k) + c

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The table's row of every trigram, the last one for those never seen."""
        if self.dense is not None:
            return self.dense[self._dense(codes)]
        at = np.minimum(np.searchsorted(self.keys, codes), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == codes, at, len(self.keys)) if len(self.keys) else at

    def words(self, text: str):
        """Scores, letters, start and end of the words whose script a language uses, and whether there is any letter."""
        codes, first, start, end, script = read(text)
        if not len(first):
            return np.empty((0, len(self.langs))), first, start, end
        s = np.add.reduceat(self.table[self.rows(codes)], first, axis=0)
        allowed = self.scripts[script]
        s = np.where(allowed, s, NONE)
        ok = allowed.any(axis=1)
        return s[ok], (end - start)[ok], start[ok], end[ok], len(first)

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of every word. If no run of words gains more than a penalty over the best single
        language, nor a start and an end together, that language is the best path; else dynamic programming finds it."""
        a = int(s.sum(axis=0).argmax())
        gain = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s - s[:, a : a + 1], axis=0)])
        if (gain - np.minimum.accumulate(gain)).max() <= self.penalty and gain.max() + (gain[-1] - gain).max() <= self.penalty:
            return np.full(len(s), a)
        rows, pen, back = s.tolist(), self.penalty, []
        best, own = rows[0], range(s.shape[1])
        for row in rows[1:]:
            top = max(best)
            t, jump = best.index(top), top - pen
            back.append([k if best[k] >= jump else t for k in own])
            best = [max(best[k], jump) + row[k] for k in own]
        out = [best.index(max(best))]
        for step in reversed(back):
            out.append(step[out[-1]])
        return np.array(out[::-1])

    def judge(self, s: np.ndarray, letters: np.ndarray, start: np.ndarray, end: np.ndarray, any_letter: bool):
        """(language, score, fit, fits, spans) of one text's words."""
        if not any_letter or not self.langs:
            return "und", 0.0, None, False, []
        if not len(s):
            return self.fallback, 0.0, None, False, []
        p = self.path(s)
        by = np.bincount(p, weights=letters, minlength=len(self.langs))
        k, total = int(by.argmax()), float(letters.sum())
        value = s[np.arange(len(s)), p]
        cut = np.flatnonzero(np.diff(p)) + 1
        spans = [(int(start[a]), int(end[b - 1]), self.langs[p[a]]) for a, b in zip([0, *cut], [*cut, len(p)])]
        return self.langs[k], float(by[k]) / total, float(value.sum()) / total, bool(value.sum() >= (self.least[p] * letters).sum() - 4 * self.spread[k] * total**0.5), spans

    def label(self, texts: list[str], most: int = 1 << 17) -> list[tuple]:
        """What ``judge`` says of every text; short texts are read together, long ones in pieces."""
        out, a = [], 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            if size > most:
                parts, shift = [], 0
                for piece in pieces(texts[a], most):
                    w = self.words(piece)
                    parts.append((w[0], w[1], w[2] + shift, w[3] + shift, w[4] if len(w) > 4 else 0))
                    shift += len(piece)
                out.append(self.judge(*(np.concatenate(x) for x in list(zip(*parts))[:4]), any(p[4] for p in parts)))
                a = b
                continue
            while b < len(texts) and size + len(texts[b]) <= most:
                size += len(texts[b])
                b += 1
            joined = "\n".join(texts[a:b])
            w = self.words(joined)
            ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
            upto, x = np.searchsorted(w[2], ends), 0
            for k, y in enumerate(upto.tolist()):
                base = int(ends[k]) - len(texts[a + k]) - 1
                has = y > x or any(unicodedata.category(c)[0] == "L" for c in texts[a + k])
                out.append(self.judge(w[0][x:y], w[1][x:y], w[2][x:y] - base, w[3][x:y] - base, has))
                x = y
            a = b
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of the spans of a text."""
        return self.label([text])[0][4]


class Counts:
    """Sums by language of trigrams, scripts of words, and texts with a word; short texts are read together, long ones in pieces."""

    def __init__(self, most: int = 1 << 17, loose: int = 1 << 20):
        self.most, self.loose = most, loose
        self.grams, self.scripts, self.docs = {}, {}, {}

    def add(self, texts: list[str], lang: str) -> None:
        a = 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) <= self.most:
                size += len(texts[b])
                b += 1
            if b == a + 1:
                with_word = max([len(self._read(piece, lang)) for piece in pieces(texts[a], self.most)]) > 0
            else:
                ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
                with_word = len(np.unique(np.searchsorted(ends, self._read("\n".join(texts[a:b]), lang), side="right")))
            self.docs[lang] = self.docs.get(lang, 0) + int(with_word)
            a = b

    def _read(self, text: str, lang: str) -> np.ndarray:
        """Counts a text and gives the starts of its words."""
        codes, _, start, _, script = read(text)
        if len(codes):
            held = self.grams.setdefault(lang, [])
            held.append(np.unique_counts(codes))
            self.scripts[lang] = self.scripts.get(lang, 0) + np.bincount(script, minlength=len(NAMES))
            if len(held) > 1 and sum(len(c[0]) for c in held[1:]) > max(self.loose, len(held[0][0])):
                self.grams[lang] = [self._sums(held)]
        return start

    @staticmethod
    def _sums(held: list) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([c[0] for c in held]), return_inverse=True)
        n = np.zeros(len(values), np.int64)
        np.add.at(n, at, np.concatenate([c[1] for c in held]))
        return values, n

    def size(self) -> int:
        return sum(len(c[0]) for held in self.grams.values() for c in held)

    def rows(self):
        """(lang, kind, codes, n), the last two as arrays."""
        for lang in sorted(self.grams):
            yield lang, TRIGRAM, *self._sums(self.grams[lang])
            used = np.flatnonzero(self.scripts[lang])
            yield lang, SCRIPT, used, self.scripts[lang][used]
            yield lang, DOC, np.zeros(1, np.int64), np.array([self.docs[lang]])


def count(rows: list[tuple[str | None, str]]) -> list[tuple[str, int, int, int]]:
    """(lang, kind, code, n) of (text, lang) rows: trigrams, scripts of words, and texts with a word."""
    c = Counts()
    for lang in sorted({x for _, x in rows}):
        c.add([text or "" for text, x in rows if x == lang], lang)
    return [(lang, kind, int(code), int(n)) for lang, kind, codes, ns in c.rows() for code, n in zip(codes, ns)]


def learn(df: DataFrame, where: Column, text: str = "text", lang: str = "lang", grams: int = 200_000, held: int = 1 << 21) -> Model:
    """A model from all labelled rows, of at most ``grams`` counts, the largest. A task hands its counts on when it
    holds more than ``held``, and at its end."""
    rows = df.where(where & df[lang].isNotNull()).select(df[text].cast("string").alias("t"), df[lang].cast("string").alias("l"))

    def out(c):
        for x, kind, codes, n in c.rows():
            for a in range(0, len(codes), 1 << 16):
                v, k = codes[a : a + (1 << 16)].astype(np.int64), n[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(v), pa.string()), pa.array([kind] * len(v), pa.int32()), pa.array(v), pa.array(k)], ["l", "kind", "code", "n"])

    def run(batches):
        c = Counts()
        for b in batches:
            texts = {}
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(x, []).append(t or "")
            for x, ts in texts.items():
                c.add(ts, x)
            if c.size() > held:
                yield from out(c)
                c = Counts()
        yield from out(c)

    total = rows.mapInArrow(tidy(run), "l string, kind int, code long, n long").groupBy("l", "kind", "code").agg(F.sum("n").alias("n"))
    got = total.orderBy(F.col("kind").desc(), F.col("n").desc(), "l", "code").limit(grams).collect()
    return Model([(r["l"], r["kind"], r["code"], r["n"]) for r in got])


def held_out(key: Column) -> Column:
    """The third of the rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


RESULT = "lang_pred string, score double, fit double, fits boolean, spans array<struct<start:int,end:int,lang:string>>"


def label(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Per row ``key`` (or the columns ``keep``), ``lang_pred``, ``score``, ``fit``, ``fits`` and ``spans``; only the text is looked at."""
    broadcast = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), span)

    def run(batches):
        m = broadcast.value
        for b in batches:
            got = m.label([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            cols = list(zip(*got)) if got else [()] * 5
            spans = [[{"start": x, "end": y, "lang": z} for x, y, z in s] for s in cols[4]]
            new = [pa.array(c, t) for c, t in zip([*map(list, cols[:4]), spans], kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "lang_pred", "score", "fit", "fits", "spans"])

    own = [df[c] for c in keep] if keep else [df[key].cast("long").alias(key)]
    d = df.select(*own, df[text].cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(tidy(run), f"{schema}, {RESULT}")

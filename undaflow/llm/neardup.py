"""Operator 4: near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct word shingles as 64-bit hashes; documents of equal sets are one class (a
128-bit fingerprint of the set) and only classes are compared. ``POSITIONS`` minwise tokens make a class's
signature. In each of ``trees`` independent trees a class goes to the node that two tokens of the tree
name. A node of up to ``cap`` classes is compared exhaustively in one task: signatures choose the pairs
(at least half of the tokens equal, which a pair at 0.75 misses with probability 1e-6, and sizes that
allow the similarity), and a pair that meets in several such nodes belongs to the first of them.
Larger nodes are dealt into blocks of about ``cap``, the node's smallest class in each, which joins most of a
group of near copies. Where classes stay apart, every pair of blocks is compared if there are at most
``most``; a larger node branches into two children by tokens that the path chooses, up to ``levels`` times,
and what is still open then is compared by pairs of blocks too, so no pair of a node is left out. Pairs are confirmed on full sets inside the task, from the most similar on, skipping those
already joined, so a group of n near copies costs about n confirmations and no pair leaves a task but
the links that join. A pair at the threshold meets in a node of one of the 16 trees with probability
1 - (1 - 0.75**2)**16 > 0.999998, and in large nodes, where the path goes on, with 0.99998.

Full sets are built again from the texts of those classes alone that have a candidate. Components are
smallest labels with pointer jumping; each round is written to the shared folder.

Cases: null, empty and blank texts have an empty set and link with nothing; texts under ``width`` words are
one shingle; rows that repeat a key are documents of their own, also with different texts; a null key
counts as larger than all keys, and such a row is kept if no row of its component has a key; ties go to
the smallest key; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .memory import tidy

POSITIONS = 64
MEMBER = ("c", "n", "sig", "label", "settled", "tree")
_U = np.uint64
#: Odd multipliers of a 64-bit mixer.
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _M1
    x = (x ^ (x >> _U(33))) * _M2
    return x ^ (x >> _U(33))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += _U(32)
_BYTE = _mix((_LOW + _U(1)) * _M1)
_STEP = _M2 | _U(1)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_SEEDS = _mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * _M1) | _U(1)
_PLACES = _mix(np.arange(1, 64, dtype=np.uint64) * _M2) | _U(1)


class Powers:
    """Powers of the word hash's base and of its inverse, as far as they have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m, b)])) for b in (_STEP, _BACK))
        return self.up, self.down


def words(data: bytes, powers: Powers, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data``; blocks are cut at white space, so memory does not grow with a text's bytes."""
    raw, starts, hashes, at = np.frombuffer(data, np.uint8), [], [], 0
    while at < len(raw):
        end = min(len(raw), at + block)
        while end < len(raw) and not _SPACE[raw[end - 1]]:
            end += 1
        b = raw[at:end]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]])))
        first, last = edge[0::2], edge[1::2]
        up, down = powers.upto(len(b) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
        starts.append(first + at)
        hashes.append(_mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _M1))
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def shingles(texts: list[bytes], width: int, powers: Powers) -> list[np.ndarray]:
    """The shingle hashes of every text, repeated ones too."""
    data = b"\n".join(texts)
    first, w = words(data, powers)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends)
    out, a = [], 0
    # all windows of the batch at once; those that leave their text are not taken
    m = max(0, len(w) - width + 1)
    whole = np.zeros(m, np.uint64)
    for k in range(width):
        whole += w[k : k + m] * _PLACES[k]
    whole = _mix(whole)
    for b in upto:
        n = int(b) - a
        if n >= width:
            out.append(whole[a : b - width + 1])
        else:
            out.append(_mix((w[a:b] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _M1) if n else w[:0])
        a = int(b)
    return out


def _batches(texts: list, most: int = 1 << 20):
    """Runs of texts of about ``most`` bytes."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _bytes(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _low(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set."""
    low = np.full(POSITIONS, ~_U(0))
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * _SEEDS).min(axis=0))
    return (low >> _U(32)).astype(np.uint32)


def text_hash(text) -> F.Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketch(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per row: id, text_hash, n (size of the set), fp (fingerprint, null for an empty set) and sig."""

    def run(batches):
        powers = Powers()
        for b in batches:
            texts, n, fp, sig = _bytes(b.column(2)), [], [], []
            for x, y in _batches(texts):
                for s in shingles(texts[x:y], width, powers):
                    s = np.unique(s)
                    n.append(len(s))
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(_low(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["id", "text_hash", "n", "fp", "sig"])

    rows = df.select(df[key].cast("long").alias("id"), text_hash(df[text]).alias("text_hash"), df[text].cast("string").alias("t"))
    return rows.mapInArrow(tidy(run), "id long, text_hash long, n long, fp binary, sig binary")


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def paths(classes: DataFrame, trees: int) -> DataFrame:
    """(node, tree, c): the node of every class in each tree, named by two tokens of the tree's own."""

    def run(batches):
        tree = np.arange(trees, dtype=np.uint64) * _M1
        for b in batches:
            s = _sigs(b.column(1)).astype(np.uint64)
            node = _mix(_mix(s[:, 0 : 2 * trees : 2] + tree) + s[:, 1 : 2 * trees : 2]).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(s))), b.column(0).take(pa.array(np.repeat(np.arange(len(s)), trees)))], ["node", "tree", "c"])

    return classes.select("c", "sig").mapInArrow(tidy(run), "node long, tree int, c binary")


def branch(members: DataFrame, trees: int, branches: int) -> DataFrame:
    """(node, c) of the children of nodes: the path chooses ``branches`` positions beyond those of the roots."""

    def run(batches):
        each = np.arange(1, branches + 1, dtype=np.uint64) * _M2
        for b in batches:
            node = np.asarray(b.column(0)).view(np.uint64)
            s = _sigs(b.column(2))
            h = _mix(node[:, None] * _M1 + each)
            token = np.take_along_axis(s, (2 * trees + h % _U(POSITIONS - 2 * trees)).astype(np.int64), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(_mix(h + token).view(np.int64).ravel()), b.column(1).take(pa.array(np.repeat(np.arange(len(s)), branches)))], ["node", "c"])

    return members.select("node", "c", "sig").mapInArrow(tidy(run), "node long, c binary")


def candidates(t: pa.Table, trees: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of a node's rows that may be similar and belong to no earlier node, with their equal tokens."""
    s, n = _sigs(t.column("sig")), np.asarray(t.column("n"))
    label = np.unique(np.array(t.column("label").to_pylist(), dtype="S32"), return_inverse=True)[1].ravel()
    judged = (np.asarray(t.column("settled"))[:, None] >> np.arange(trees)) & 1
    part = np.asarray(t.column("part"))
    apart = (lambda a: part[a : a + 32, None] != part[None, a:]) if part[0] >= 0 else (lambda a: True)
    before = np.arange(trees) < np.asarray(t.column("tree"))[0]
    out = []
    for a in range(0, len(s), 32):
        eq = (s[a : a + 32, None, :] == s[None, a:, :]).sum(axis=2, dtype=np.int16)
        x, y = n[a : a + 32, None], n[None, a:]
        ok = (eq >= POSITIONS // 2) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (label[a : a + 32, None] != label[None, a:]) & apart(a)
        i, j = np.nonzero(ok)
        keep = i < j
        i, j = i[keep], j[keep]
        e = eq[i, j]
        i, j = i + a, j + a
        if before.any() and len(i):
            same = s[i] == s[j]
            met = same[:, 0 : 2 * trees : 2] & same[:, 1 : 2 * trees : 2] & (judged[i] == 1) & before
            i, j, e = i[~met.any(axis=1)], j[~met.any(axis=1)], e[~met.any(axis=1)]
        out.append((i, j, e))
    i, j, e = (np.concatenate(p) for p in zip(*out))
    order = np.lexsort((j, i, -e))
    return i[order], j[order], e[order]


def _distinct(t: pa.Table) -> pa.Table:
    """One row a class, in the classes' order."""
    t = t.sort_by("c")
    c = t.column("c").to_pylist()
    return t.take([k for k in range(len(c)) if not k or c[k] != c[k - 1]])


def sift(rows: DataFrame, wanted: DataFrame, most_bits: int = 26) -> DataFrame:
    """The rows whose (id, text_hash) may be in ``wanted``, by a bitmap of at most 2**most_bits bits: a broadcast of at most
    2**(most_bits - 6) pairs of numbers at any size of the table. It saves moving most texts; a join decides."""
    bits = min(most_bits, max(10, wanted.count().bit_length() + 4))
    slot = lambda d: d.withColumn("_s", F.shiftrightunsigned(F.xxhash64("id", "text_hash"), 64 - bits)).withColumn("_k", F.shiftright("_s", 6))
    words = slot(wanted).groupBy("_k").agg(F.expr("bit_or(shiftleft(1L, cast(_s % 64 as int)))").alias("_w"))
    return slot(rows).join(F.broadcast(words), "_k").where(F.expr("shiftrightunsigned(_w, cast(_s % 64 as int)) & 1 = 1")).drop("_k", "_s", "_w")


def links(blocks: DataFrame, rows: DataFrame, named: DataFrame, width: int, percent: int, trees: int) -> DataFrame:
    """(a, b): links that join what is similar inside every block of (block, c, n, sig, label, settled, tree, part)."""

    def involved(t: pa.Table) -> pa.Table:
        t = _distinct(t)
        i, j, _ = candidates(t, trees, percent)
        return t.take(np.unique(np.concatenate([i, j])))

    def join(t: pa.Table) -> pa.Table:
        t = _distinct(t)
        i, j, _ = candidates(t, trees, percent)
        c = t.column("c").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        root, a, b = {x: x for x in t.column("label").to_pylist()}, [], []
        label = t.column("label").to_pylist()

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(label[x]), find(label[y])
            if p != q:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    root[p] = q
                    a.append(c[x])
                    b.append(c[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    def build(batches):
        powers = Powers()
        for b in batches:
            t, out = _bytes(b.column(1)), []
            for x, y in _batches(t):
                out += [np.unique(s).tobytes() for s in shingles(t[x:y], width, powers)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["c", "shingles"])

    member = "block string, c binary, n long, sig binary, label binary, settled int, tree int, part int"
    found = materialize(blocks.groupBy("block").applyInArrow(involved, member), "involved")
    # of rows that share a class one text is enough
    wanted = materialize(found.select("c").distinct().join(named, "c"), "wanted")
    w = wanted.withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    some = sift(rows, wanted)
    text = some.join(w, (F.col("text_hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))).groupBy("c").agg(F.first("t").alias("t"))
    sets = materialize(text.mapInArrow(tidy(build), "c binary, shingles binary"), "sets")
    return materialize(found.join(sets, "c").groupBy("block").applyInArrow(join, "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of ``edges`` (a, b): the smallest vertex reachable."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"id": "b", "label": "l"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        new = labels.join(seen, "id").select("id", "label", F.least("label", "l").alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("label").alias("up"))
        new = materialize(new.join(jump, "m", "left").select("id", F.col("label").alias("old"), F.least("m", "up").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, trees: int = 16,
                    cap: int = 512, most: int = 8, levels: int = 3) -> DataFrame:
    """Per row ``key``, ``n_shingles``, ``component_id``, ``kept``, ``text_hash`` and ``component``, a name of the component that is null for empty sets."""
    docs = materialize(sketch(df, key, text, width), "sketch")
    own = docs.where("n > 0").groupBy(F.col("fp").alias("c")).agg(
        F.min("id").alias("least"), F.min(F.struct("id", "text_hash")).alias("row"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(own, "classes")
    rows = df.select(df[key].cast("long").alias("id"), text_hash(df[text]).alias("text_hash"), df[text].cast("string").alias("t"))
    named = classes.select("c", "row.id", "row.text_hash")
    nodes = paths(classes, trees)
    shared = nodes.groupBy("node").agg(F.count("*").alias("k")).where("k > 1")
    nodes = materialize(nodes.join(shared, "node"), "nodes")
    # the trees in which every pair of a class's node is judged
    settled = nodes.groupBy("c").agg(F.sum(F.when(F.col("k") <= most * cap, F.pow(F.lit(2.0), "tree")).otherwise(0)).cast("int").alias("settled"))
    sig = classes.select("c", "n", "sig")
    member = nodes.join(settled, "c").join(sig, "c").withColumn("label", F.col("c"))
    edges, labels = None, None
    for level in range(levels + 1):
        # larger nodes in blocks, a node's smallest class in each of them
        blocks, place = F.ceil(F.col("k") / cap).cast("int"), F.pmod(F.xxhash64("c", "node"), F.ceil(F.col("k") / cap)).cast("int")
        pivots = member.where(F.col("k") > cap).groupBy("node").agg(F.min("c").alias("pivot"))
        big = member.where(F.col("k") > cap).join(pivots, "node")
        big = big.withColumn("part", F.explode(F.when(F.col("c") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(place))))
        dealt = big.select(F.concat_ws("/", "node", "part").alias("block"), *MEMBER, F.lit(-1).alias("part"))
        dealt = dealt.union(member.where(F.col("k") <= cap).select(F.col("node").cast("string").alias("block"), *MEMBER, F.lit(-1).alias("part")))
        found = links(dealt, rows, named, width, percent, trees)
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
        wide = nodes.where(F.col("k") > cap).select("node", "k", "tree", "c").join(labels, F.col("c") == labels["id"], "left").select("node", "k", "tree", "c", F.coalesce("label", "c").alias("label"))
        open_ = wide.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("node")
        wide = materialize(wide.join(open_, "node").join(sig, "c"), "open")
        if not wide.limit(1).count():
            break
        # every pair of different blocks meets
        last = F.lit(True) if level == levels else F.col("k") <= most * cap
        mid = wide.where(last).withColumn("part", place).join(settled, "c").withColumn("_q", F.explode(F.sequence(F.lit(0), blocks - 1))).where("_q <> part")
        mid = mid.select(F.concat_ws("/", "node", F.least("part", "_q"), F.greatest("part", "_q")).alias("block"), *MEMBER, "part")
        edges = edges.union(links(mid, rows, named, width, percent, trees))
        labels = components(edges)
        huge = wide.where(~last).drop("label").join(labels, F.col("c") == labels["id"], "left").select("node", "c", "sig", F.coalesce("label", "c").alias("label"))
        huge = materialize(huge, "huge")
        if not huge.limit(1).count():
            break
        children = branch(huge, trees, 2).join(huge.select("c", "label").distinct(), "c")
        stat = children.groupBy("node").agg(F.count("*").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("node", "k")
        nodes = materialize(children.join(stat, "node").withColumn("tree", F.lit(0)), "nodes")
        member = nodes.join(sig, "c").withColumn("settled", F.lit(0))
        settled = classes.select("c", F.lit(0).alias("settled"))
    whole = classes.join(labels, classes["c"] == labels["id"], "left").select("c", "least", F.coalesce("label", "c").alias("label"))
    whole = whole.join(whole.groupBy("label").agg(F.min("least").alias("component_id")), "label").select(F.col("c").alias("fp"), "component_id", F.hex("label").alias("component"))
    one = docs.where("n = 0").select("id", "text_hash", "n", F.col("id").alias("component_id"), F.lit(None).cast("string").alias("component"))
    many = docs.where("n > 0").join(whole, "fp").select("id", "text_hash", "n", "component_id", "component")
    return one.union(many).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "component")

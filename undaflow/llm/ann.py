"""Operator 10: nearest neighbours by low-dimensional stable projections in kd-trees.

Vectors are scaled to length 1 and projected on ``dims`` Gaussian directions. A kd-tree fitted on about
``sample`` projected rows deals all rows into cells of about ``per_block`` rows; larger cells are cut by a hash of the
key. Each query first searches the cell it lies in; then, with the distance of its k-th best so far, the cells whose
boxes pass the stopping test. In a block the projections form a kd-tree of their own. A query meets its leaves in
order of projected distance and verifies those of their vectors that pass the stopping test: for a
point at distance d its squared projected distance over d squared is chi-square distributed, so a point is left
out, and the search stops at a leaf, once it is so far that one nearer than the k-th best would lie there with
probability below ``1 - sure``. ``verified`` counts the vectors whose distance was computed. Scores of a
matrix product differ by rounding even for equal vectors, so all rows within a rounding tolerance of
the k-th are kept, scored one by one with the exact measure and only then cut to k by (score, key).
Queries go to blocks in parts of ``per_part``, so a task holds one block and one part. Every distinct vector of a
block is indexed, with its k + 1 smallest keys: of equal vectors no others can be among the k nearest of any row.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors are
compared within their dimension only; equal vectors tie to the smaller key; fewer candidates than
k give what there is; repeated rows of one key count once; a null key takes no part; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def chi2_tail(x: float, dims: int) -> float:
    """P(chi-square with an even number of degrees > x)."""
    t, s = math.exp(-x / 2), 0.0
    for i in range(dims // 2):
        s += t
        t *= x / 2 / (i + 1)
    return s


def chi2_quantile(p: float, dims: int) -> float:
    """x with P(chi-square <= x) = p."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi2_tail(mid, dims) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree of projected points; leaves are runs of ``order`` with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.runs, low, high, todo = [], [], [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            p = points[self.order[a:b]]
            lo, hi = p.min(axis=0), p.max(axis=0)
            if b - a <= leaf:
                self.runs.append((a, b))
                low.append(lo)
                high.append(hi)
                continue
            m = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(p[:, int((hi - lo).argmax())], m)]
            todo += [(a, a + m), (a + m, b)]
        self.low, self.high = np.array(low), np.array(high)

    def far(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distances to the leaves' boxes."""
        gap = np.maximum(0.0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(axis=1)


def smallest(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The rows of the ``k`` smallest distinct ids of every distinct vector."""
    same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    c, i = same[order], ids[order]
    first = np.r_[True, c[1:] != c[:-1]]
    new = first | np.r_[True, i[1:] != i[:-1]]
    rank = np.cumsum(new)
    start = np.maximum.accumulate(np.where(first, rank, 0))
    return np.sort(order[new & (rank - start < k)])


def plane_of(size: int, dims: int, seed: int) -> np.ndarray:
    """The Gaussian directions for vectors of a size."""
    return np.random.default_rng(seed).standard_normal((size, dims))


def scaled(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


class Cells:
    """Splits of projected space at the medians of a sample, ``depth`` levels deep, along the widest axis each."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, size = depth, (1 << depth) - 1
        self.axis, self.at = np.zeros(size, np.int64), np.zeros(size)
        held = {0: points}
        for node in range(size):
            p = held.pop(node)
            if len(p):
                self.axis[node] = int(np.ptp(p, axis=0).argmax())
                self.at[node] = np.median(p[:, self.axis[node]])
            high = p[:, self.axis[node]] > self.at[node]
            held[2 * node + 1], held[2 * node + 2] = p[~high], p[high]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - ((1 << self.depth) - 1)


def search_block(ids, vectors, q_ids, q_vectors, k: int, dims: int, sure: float, seed: int, leaf: int, reach=None):
    """For every query the rows of a block that may be among its best ``k`` (those within rounding of the k-th score), and how many were
    verified. ``reach`` holds squared distances within which the best lie by what is known already."""
    rows_of = smallest(ids, vectors, k + 1)
    ids, vectors = ids[rows_of], vectors[rows_of]
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors / norm[:, None]
    plane = plane_of(vectors.shape[1], dims, seed)
    tree = Tree(unit @ plane, leaf)
    points, unit, ids, rows_of = (unit @ plane)[tree.order], unit[tree.order], ids[tree.order], rows_of[tree.order]
    q_unit = q_vectors / np.linalg.norm(q_vectors, axis=1)[:, None]
    q_plane, need = q_unit @ plane, chi2_quantile(sure, dims)
    # above the difference that rounding can make between two scores of one pair
    close = 4 * (vectors.shape[1] + 8) * np.finfo(float).eps
    out = []
    for i in range(len(q_ids)):
        far = tree.far(q_plane[i])
        nearest, score, found = np.argsort(far, kind="stable"), np.empty(0), np.empty(0, np.int64)
        at, step, seen = 0, 2, 0
        while at < len(nearest):
            most = need * (max(0.0, 2 - 2 * score[k - 1]) + 2 * close) if len(score) >= k else np.inf
            if reach is not None:
                most = min(most, need * (reach[i] + 2 * close))
            if far[nearest[at]] > most:
                break
            rows = np.concatenate([np.arange(*tree.runs[j]) for j in nearest[at : at + step]])
            rows = rows[(ids[rows] != q_ids[i]) & (((points[rows] - q_plane[i]) ** 2).sum(axis=1) <= most)]
            seen += len(rows)
            s, c = np.concatenate([score, unit[rows] @ q_unit[i]]), np.concatenate([found, rows])
            best = np.lexsort((ids[c], -s))
            if len(best) > k:
                best = best[s[best] >= s[best[k - 1]] - close]
            score, found = s[best], c[best]
            at, step = at + step, min(2 * step, 64)
        out.append((rows_of[found], seen))
    return out


def search(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", dims: int = 24, sure: float = 0.97,
           seed: int = 29, leaf: int = 32, per_block: int = 8_000, per_part: int = 10_000, sample: int = 20_000, most_cells: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the ``k`` nearest found of every row that ``is_query`` (a Column) holds for.
    The driver holds the splits and boxes of at most ``most_cells`` cells for each length of vectors."""
    v = df[vector].cast("array<double>")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(good & df[key].isNotNull()).select(df[key].cast("long").alias("id"), v.alias("v"), is_query.alias("q"), F.size(v).alias("size"))
    count = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    need = chi2_quantile(sure, dims)
    cells = _fitted(rows, count, dims, seed, per_block, sample, most_cells)
    placed = materialize(_placed(rows, cells, dims, seed), "placed")
    boxes = _boxes(placed, dims, seed)
    # cells beyond the size of a block are cut by hash
    size = placed.groupBy("size", "cell").agg(F.count("*").alias("n"))
    data = placed.join(size, ["size", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / per_block)).cast("int"))
    subs = size.select("size", "cell", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / per_block).cast("int") - 1)).alias("sub"))
    queries = placed.where("q").select("id", "v", "size", "cell").dropDuplicates(["id"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, s, n = [], [], [], []
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("id"), right.sort_by("q_id")
            x, y = matrix(left.column("v")), matrix(right.column("q_v"))
            ids, q_ids = np.asarray(left.column("id")), np.asarray(right.column("q_id"))
            for i, (rows_, seen) in enumerate(search_block(ids, x, q_ids, y, k, dims, sure, seed, leaf, np.asarray(right.column("q_reach")))):
                exact = [(-float(np.dot(x[r], y[i]) / (math.sqrt(np.dot(x[r], x[r])) * math.sqrt(np.dot(y[i], y[i])))), int(ids[r])) for r in rows_]
                # the last row carries the number of verified vectors
                for score, r, m in [*((score, r, 0) for score, r in sorted(exact)[:k]), (None, None, seen)]:
                    q.append(int(q_ids[i]))
                    c.append(r)
                    s.append(None if score is None else -score)
                    n.append(m)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64()), "verified": pa.array(n, pa.int64())})

    def searched(asked: DataFrame, name: str) -> DataFrame:
        """What queries (id, v, size, cell, reach) find in the blocks of their cells."""
        asked = asked.join(subs, ["size", "cell"])
        n = asked.groupBy("size", "cell", "sub").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("parts")).cast("int")
        asked = asked.join(n, ["size", "cell", "sub"]).withColumn("part", part)
        held = data.join(n, ["size", "cell", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        on = ["size", "cell", "sub", "part"]
        other = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "v", "reach", *on)]).groupBy(*[f"q_{c}" for c in on])
        found = held.select("id", "v", *on).groupBy(*on).cogroup(other)
        return materialize(found.applyInArrow(run, "query_id long, vec_id long, score double, verified long"), name)

    own = searched(queries.withColumn("reach", F.lit(float("inf"))), "own")
    kth = F.element_at(F.sort_array(F.collect_set(F.struct("score", "vec_id")), asc=False), k)["score"]
    near = own.where("vec_id is not null").groupBy(F.col("query_id").alias("id")).agg(F.count_distinct("vec_id").alias("n"), F.when(F.count_distinct("vec_id") >= k, kth).alias("kth"))
    reach = F.when(F.col("kth").isNull(), float("inf")).otherwise(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth")))
    asked = queries.join(near, "id", "left").select("id", "v", "size", "cell", reach.alias("reach"))
    found = own.union(searched(_routed(asked, boxes, need, dims, seed), "others"))
    verified = found.where("vec_id is null").groupBy("query_id").agg(F.sum("verified").alias("verified"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.where("vec_id is not null").select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(verified, "query_id").select("query_id", "rank", "vec_id", "score", "verified")


def matrix(column) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(flat.chunks).flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def _by_size(batch, at: int):
    """(size, rows, vectors) of a batch whose vectors differ in length."""
    size = np.asarray(batch.column(at).value_lengths())
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield int(n), rows, matrix(batch.column(at).take(pa.array(rows)))


def _fitted(rows: DataFrame, count: dict[int, int], dims: int, seed: int, per_block: int, sample: int, most_cells: int) -> dict[int, Cells]:
    """The cells of every length of vectors, from a sample by key hash."""
    depth = {n: min(math.ceil(math.log2(most_cells)), max(0, math.ceil(math.log2(max(1, c) / per_block)))) for n, c in count.items()}
    total = sum(count.values())
    if not any(depth.values()):
        return {n: Cells(np.empty((0, dims)), 0) for n in count}

    def run(batches):
        for b in batches:
            for n, _, x in _by_size(b, 0):
                p = scaled(x) @ plane_of(n, dims, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), n, np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))], ["size", "p"])

    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed + 2)), 11) / F.lit(float(1 << 53))
    got = rows.where(u < sample / total).select("v").mapInArrow(run, "size int, p array<double>").collect()
    return {n: Cells(np.array([r["p"] for r in got if r["size"] == n]).reshape(-1, dims), d) for n, d in depth.items()}


def _placed(rows: DataFrame, cells: dict[int, Cells], dims: int, seed: int) -> DataFrame:
    """Rows (id, v, q, size) with their cell."""

    def run(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            for n, at, x in _by_size(b, 1):
                cell[at] = cells[n].of(scaled(x) @ plane_of(n, dims, seed))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return rows.mapInArrow(run, "id long, v array<double>, q boolean, size int, cell int")


def _boxes(placed: DataFrame, dims: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vectors: the cells that hold rows, with the least and largest projections of each."""

    def run(batches):
        held: dict = {}
        for b in batches:
            cell = np.asarray(b.column(1))
            for n, at, x in _by_size(b, 0):
                p = scaled(x) @ plane_of(n, dims, seed)
                for c in np.unique(cell[at]):
                    mine = p[cell[at] == c]
                    low, high = held.get((n, int(c)), (mine[0], mine[0]))
                    held[n, int(c)] = np.minimum(low, mine.min(axis=0)), np.maximum(high, mine.max(axis=0))
        rows = [(n, c, d, float(low[d]), float(high[d])) for (n, c), (low, high) in held.items() for d in range(dims)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["size", "cell", "d", "low", "high"])

    got = placed.select("v", "cell").mapInArrow(run, "size int, cell int, d int, low double, high double").groupBy("size", "cell", "d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    out = {}
    for n in {r["size"] for r in got}:
        cells = sorted({r["cell"] for r in got if r["size"] == n})
        at = {c: i for i, c in enumerate(cells)}
        low, high = np.zeros((len(cells), dims)), np.zeros((len(cells), dims))
        for r in got:
            if r["size"] == n:
                low[at[r["cell"]], r["d"]], high[at[r["cell"]], r["d"]] = r["low"], r["high"]
        out[n] = np.array(cells, np.int32), low, high
    return out


def _routed(asked: DataFrame, boxes: dict, need: float, dims: int, seed: int) -> DataFrame:
    """Queries (id, v, size, cell, reach) once for each other cell whose box passes the stopping test."""

    def run(batches):
        for b in batches:
            cell, reach = np.asarray(b.column(3)), np.asarray(b.column(4))
            who, where = [], []
            for n, at, x in _by_size(b, 1):
                cells, low, high = boxes[n]
                q = scaled(x) @ plane_of(n, dims, seed)
                for i, row in zip(at, q):
                    gap = np.maximum(0.0, np.maximum(low - row, row - high))
                    to = cells[((gap * gap).sum(axis=1) <= need * (reach[i] + 1e-9)) & (cells != cell[i])]
                    who += [int(i)] * len(to)
                    where += to.tolist()
            t = b.take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(where, pa.int32()), t.column(4)], t.schema.names)

    return asked.mapInArrow(run, "id long, v array<double>, size int, cell int, reach double")

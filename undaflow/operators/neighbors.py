"""Neighbour joins of vectors, by blocks of a matrix product.

Candidates are dealt into blocks, queries into parts; a task holds one block and one part, keeps what it needs of their
distances, and the bests of all blocks are merged. Work is rows times queries, as exact neighbours of
unstructured vectors ask for, but memory is a block and a part and a strip of their distances, and nothing is broadcast.
Euclidean nearest rows are found among squares from a matrix product, with its rounding left as slack; the distances
themselves come from differences. Equal distances tie to the smaller key. Null vectors take no part; a zero
vector is at cosine distance 1 from all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import matrix
from .blocks import indexed

METRICS = ("euclidean", "cosine", "angular")


def distances(x: np.ndarray, y: np.ndarray, metric: str, halved: bool = False, eps: float = 1e-8) -> np.ndarray:
    """Distances of the rows of x to those of y. ``halved``: no component is negative, so angles span half as much."""
    if metric == "euclidean":
        step = max(1, (1 << 22) // max(1, y.size))
        rows = [np.sqrt(((x[c : c + step, None, :] - y[None, :, :]) ** 2).sum(axis=2)) for c in range(0, len(x), step)]
        return np.concatenate(rows) if rows else np.empty((0, len(y)))
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
    if metric == "cosine":
        return np.where(norm > 0, 1 - (x @ y.T) / np.where(norm > 0, norm, 1.0), 1.0)
    if metric == "angular":
        cos = (x @ y.T) / np.maximum(norm, eps)
        return (2 if halved else 1) * np.arccos(np.clip(cos, -1 + eps / 2, 1 - eps / 2)) / np.pi
    raise ValueError(f"unknown metric {metric!r}")


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, from their differences."""
    return np.sqrt(np.maximum(((x - y) ** 2).sum(axis=1), 0.0))


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Squared distances of the rows of x to those of y by a matrix product, and for each row of x how far rounding may have
    moved them. None where the product overflows or a component isn't finite."""
    with np.errstate(over="ignore", invalid="ignore"):
        nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    top = ny.max(initial=0.0)
    if not np.isfinite(nx.max(initial=0.0) + top):
        return None
    sq = np.hstack([x, nx[:, None], np.ones((len(x), 1))]) @ np.hstack([-2 * y, np.ones((len(y), 1)), ny[:, None]]).T
    return sq, 4 * (x.shape[1] + 4) * np.finfo(float).eps * (nx + top)


def euclidean(x: np.ndarray, y: np.ndarray, share: float = 1e-3) -> np.ndarray:
    """Distances of the rows of x to those of y by a matrix product; where their square is under ``share`` of the vectors' own,
    so that digits are lost, from differences."""
    got = squares(x, y)
    if got is None:
        return distances(x, y, "euclidean")
    d = np.sqrt(np.maximum(got[0], 0.0))
    i, j = np.nonzero(got[0] < share * ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)))
    for c in range(0, len(i), STRIP // 64):
        p, q = i[c : c + STRIP // 64], j[c : c + STRIP // 64]
        d[p, q] = gaps(x[p], y[q])
    return d


def same(qids: np.ndarray, ids: np.ndarray):
    """Where query and row are of one key, as an index into their matrix; ``ids`` are sorted."""
    if (ids[1:] == ids[:-1]).any():
        return qids[:, None] == ids[None, :]
    at = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
    hit = np.flatnonzero(ids[at] == qids)
    return hit, at[hit]


def _bound(sq: np.ndarray, k: int, lanes: int = 128) -> np.ndarray:
    """For each row a number that at least ``k`` entries don't exceed: the k-th of the least of each lane."""
    rows, n = sq.shape
    if n >= 2 * lanes and k <= lanes // 4:
        sq = sq[:, : n - n % lanes].reshape(rows, -1, lanes).min(axis=1)
    return sq.min(axis=1) if k == 1 else np.partition(sq, k - 1, axis=1)[:, k - 1]


def nearest(x: np.ndarray, y: np.ndarray, k: int, left_out=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and Euclidean distances of the ``k`` nearest rows of y for each row of x and of all within rounding of the
    k-th; pairs at the index ``left_out`` and those whose distance isn't finite take no part."""
    n, got = min(k, len(y)), squares(x, y)
    sq, slack = got or (distances(x, y, "euclidean"), 0.0)
    if got is None:
        sq[~np.isfinite(sq)] = np.inf
    if left_out is not None:
        sq[left_out] = np.inf
    top = _bound(sq, n)
    reach = top + 1e-12 if got is None else (np.sqrt(np.maximum(top + slack, 0.0)) + 1e-12) ** 2 + slack
    at = np.flatnonzero(sq <= np.minimum(reach, np.finfo(float).max)[:, None])
    i, j = np.divmod(at, len(y))
    cut = range(0, len(i), STRIP // 64)
    d = np.concatenate([gaps(x[i[c : c + STRIP // 64]], y[j[c : c + STRIP // 64]]) for c in cut] or [np.empty(0)])
    # the k-th by differences, among those that the product left
    order = np.lexsort((d, i))
    first, size = np.searchsorted(i, np.arange(len(x))), np.bincount(i, minlength=len(x))
    kth = np.full(len(x), np.inf)
    kth[size >= n] = d[order][first[size >= n] + n - 1]
    near = d <= kth[i] + 1e-12
    return i[near], j[near], d[near]


#: Numbers of a strip of distances that a task holds at once.
STRIP = 1 << 20


def joined(queries: DataFrame, data: DataFrame, keep, per_block: int = 8192, per_part: int = 8192, group: str | None = None) -> DataFrame:
    """(src, dst, dist) of what ``keep`` (query vectors, vectors, query ids, ids -> rows, columns, distances) takes of each block;
    with ``group``, a column of both tables, ``keep`` gets the queries' and the rows' groups behind these."""
    names = ["id", "v", *(["g"] if group else [])]
    q, x = (
        d.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), *([F.col(group).cast("long").alias("g")] if group else [])).where("id is not null and v is not null")
        for d in (queries, data)
    )
    blocks, parts = (max(1, -(-d.count() // n)) for d, n in ((x, per_block), (q, per_part)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.select(*names, own(blocks).alias("b"), every(parts).alias("p"))
    q = q.select(*names, own(parts).alias("p"), every(blocks).alias("b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("id"), right.sort_by("id")
            ids, qids, a, b = np.asarray(left.column("id")), np.asarray(right.column("id")), matrix(left.column("v")), matrix(right.column("v"))
            groups = (np.asarray(right.column("g")), np.asarray(left.column("g"))) if group else None
            found = []
            step = max(1, STRIP // len(a))
            for k in range(0, len(b), step):
                more = (groups[0][k : k + step], groups[1]) if groups else ()
                i, j, d = keep(b[k : k + step], a, qids[k : k + step], ids, *more)
                found.append((qids[k + i], ids[j], d))
            src, dst, dist = (np.concatenate(c) for c in zip(*found))
        return pa.table({"src": pa.array(src), "dst": pa.array(dst), "dist": pa.array(dist)})

    return x.groupBy("b", "p").cogroup(q.groupBy("b", "p")).applyInArrow(run, "src long, dst long, dist double")


def _vectors(df: DataFrame, key: str, v: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(v).alias("v"))


def knn(queries: DataFrame, data: DataFrame, key: str, v: str, k: int, metric: str = "euclidean", with_self: bool = False, halved: bool = False,
        per_block: int = 8192, per_part: int = 8192) -> DataFrame:
    """(src, rank, dst, dist): the ``k`` nearest rows of ``data`` for every row of ``queries``, itself left out unless ``with_self``."""

    def keep(a, b, qids, ids):
        if metric == "euclidean":
            return nearest(a, b, k, None if with_self else same(qids, ids))
        d = distances(a, b, metric, halved)
        if not with_self:
            d[qids[:, None] == ids[None, :]] = np.inf
        n = min(k, d.shape[1])
        kth = np.partition(d, n - 1, axis=1)[:, n - 1]
        # equal distances can differ by rounding between blocks, so all within rounding of the k-th go on
        i, j = np.nonzero((d <= kth[:, None] + 1e-12) & np.isfinite(d))
        return i, j, d[i, j]

    found = joined(_vectors(queries, key, v), _vectors(data, key, v), keep, per_block, per_part)
    w = Window.partitionBy("src").orderBy(F.round("dist", 12), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "rank", "dst", "dist")


def radius_graph(df: DataFrame, key: str, v: str, radius: float, metric: str = "euclidean", per_block: int = 4096, per_part: int = 1024) -> DataFrame:
    """(src, dst, dist) of all pairs at most ``radius`` apart, a row with itself left out."""

    def keep(a, b, qids, ids):
        d = distances(a, b, metric)
        i, j = np.nonzero((d <= radius) & (qids[:, None] != ids[None, :]))
        return i, j, d[i, j]

    d = _vectors(df, key, v)
    return joined(d, d, keep, per_block, per_part)


def pairwise(x: DataFrame, y: DataFrame, key: str, v: str, metric: str = "euclidean", halved: bool = False, per_block: int = 4096, per_part: int = 1024) -> DataFrame:
    """(src, dst, dist) of all pairs, block by block: the full matrix, for those who ask for it."""

    def keep(a, b, qids, ids):
        d = distances(a, b, metric, halved)
        i, j = np.indices(d.shape)
        return i.ravel(), j.ravel(), d.ravel()

    return joined(_vectors(x, key, v), _vectors(y, key, v), keep, per_block, per_part)


def nearest_neighbor(x: DataFrame, y: DataFrame, key: str, v: str) -> DataFrame:
    """(src, dst, dist): the row of ``y`` at the least angular distance from each row of ``x``. Angles count double where
    no component of either table is below zero."""
    low = x.select(v).union(y.select(v)).agg(F.min(F.array_min(v))).first()[0]
    return knn(x, y, key, v, 1, "angular", with_self=True, halved=low is not None and low >= 0).select("src", "dst", "dist")


def in_degree(edges: DataFrame) -> DataFrame:
    """(dst, n): the edges of a distance above zero that end in each vertex."""
    return edges.where("dist > 0").groupBy("dst").agg(F.count("*").alias("n"))


def neighbor_filter(df: DataFrame, key: str, v: str, k: int = 16, metric: str = "euclidean", aggregate: str = "median") -> DataFrame:
    """key, dim, y: each component replaced by the median, mean or max of it over the rows that are among each other's
    ``k`` nearest. A row without such neighbours stays."""
    g = knn(df, df, key, v, k, metric)
    both = g.select("src", "dst").join(g.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    x = df.select(F.col(key).alias("_id"), F.posexplode(F.col(v).cast("array<double>")).alias("dim", "_x"))
    agg = {"median": F.median, "mean": F.avg, "max": F.max}[aggregate]
    near = both.join(x, both["dst"] == x["_id"]).groupBy("src", "dim").agg(agg("_x").alias("_y"))
    d = x.join(near.withColumnsRenamed({"src": "_src", "dim": "_dim"}), (F.col("_id") == F.col("_src")) & (F.col("dim") == F.col("_dim")), "left")
    return d.select(F.col("_id").alias(key), "dim", F.coalesce("_y", "_x").alias("y"))


def dtw(cost: np.ndarray, subsequence: bool = True) -> list[tuple[int, int]]:
    """The cheapest path of steps (1, 1), (0, 1), (1, 0) through a cost matrix, from the first row to the last; with
    ``subsequence`` it begins and ends in any column. Diagonals are computed at once; equal costs prefer the diagonal."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, :] = 0.0 if subsequence else np.inf
    total[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        total[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(total[i - 1, j - 1], total[i, j - 1]), total[i - 1, j])
    i, j = n, int(total[n, 1:].argmin()) + 1 if subsequence else m
    path = [(i - 1, j - 1)]
    while i > 1 or (j > 1 and not subsequence):
        steps = [(i - 1, j - 1), (i, j - 1), (i - 1, j)]
        i, j = min((p for p in steps if p[0] > 0 and p[1] > 0), key=lambda p: total[p])
        path.append((i - 1, j - 1))
    return path[::-1]


def align(queries: DataFrame, bank: DataFrame, source: list[str], t: str, v: str, subsequence: bool = True) -> DataFrame:
    """source, step, i, j: for each query (source, t, v) its path through the one ``bank`` (t, v), by cosine distance of
    absolute components. A task holds one query and the bank, which is a bounded set of reference frames."""
    frames = bank.orderBy(t).select(v).toArrow()
    y = np.abs(matrix(frames.column(0)))
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}

    def run(q: pa.Table) -> pa.Table:
        q = q.sort_by(t)
        path = dtw(distances(np.abs(matrix(q.column(v))), y, "cosine"), subsequence)
        first = pa.array(np.zeros(len(path), np.int64))
        own = {c: q.column(c).combine_chunks().take(first) for c in source}
        return pa.table({**own, "step": pa.array(np.arange(len(path))), "i": pa.array([p[0] for p in path], pa.int64()), "j": pa.array([p[1] for p in path], pa.int64())})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in source), "step long, i long, j long"])
    return queries.select(*source, t, F.col(v).cast("array<double>").alias(v)).groupBy(*source).applyInArrow(run, schema)


def best_k(df: DataFrame, score: str, k: int, ascending: bool = True, key: str | None = None) -> DataFrame:
    """The ``k`` rows of the least (or largest) score, ties by ``key``."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return df.orderBy(order, *([key] if key else [])).limit(k)


def numbered(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    return indexed(df, [], [key], out)


def condition(dist: Column, low: float, high: float) -> Column:
    return (dist > low) & (dist < high)

"""Decompositions of vectors (key, v). Executors sum small matrices (dimensions or components squared), the driver solves
them, and rows are projected where they are; no task or driver holds rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import apply, matrix


def summed(df: DataFrame, v: str, fn) -> dict[str, np.ndarray]:
    """The sums over all rows of the matrices that ``fn`` makes of a batch: one partial result a task."""

    def run(batches):
        total: dict = {}
        for b in batches:
            if b.num_rows:
                for name, m in fn(matrix(b.column(0))).items():
                    total[name] = total.get(name, 0) + m
        cols = [(n, np.atleast_2d(m)) for n, m in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, m in cols for _ in range(m.size)], pa.string()), pa.array([i for _, m in cols for i in np.repeat(np.arange(m.shape[0]), m.shape[1])], pa.int32()),
             pa.array([j for _, m in cols for j in np.tile(np.arange(m.shape[1]), m.shape[0])], pa.int32()), pa.array([float(x) for _, m in cols for x in m.ravel()], pa.float64())],
            ["name", "i", "j", "x"])

    rows = df.select(v).mapInArrow(run, "name string, i int, j int, x double").groupBy("name", "i", "j").agg(F.sum("x").alias("x")).collect()
    out = {}
    for name in {r["name"] for r in rows}:
        mine = [r for r in rows if r["name"] == name]
        m = np.zeros((1 + max(r["i"] for r in mine), 1 + max(r["j"] for r in mine)))
        for r in mine:
            m[r["i"], r["j"]] = r["x"]
        out[name] = m
    return out


def _moments(df: DataFrame, v: str):
    s = summed(df, v, lambda x: {"n": np.array([[len(x)]]), "s": x.sum(axis=0), "g": x.T @ x})
    n = s["n"][0, 0]
    mean = s["s"][0] / n
    return n, mean, s["g"] / n - np.outer(mean, mean)


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def pca(df: DataFrame, v: str, n: int = 16, out: str = "scores") -> DataFrame:
    """Scores on the ``n`` main axes of the standardised components; a constant component is left as it is."""
    _, mean, cov = _moments(df, v)
    std = np.sqrt(np.diag(cov))
    std = np.where(std > 1e-12, std, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    axes = _oriented(vectors[:, np.argsort(-values)[:n]])
    return apply(df, [v], lambda x: (((x - mean) / std) @ axes,), [out])


def nmf(df: DataFrame, v: str, n: int = 16, max_iter: int = 50, inner: int = 30, seed: int = 0, tol: float = 1e-4, out: str = "weights") -> DataFrame:
    """Weights W >= 0 of X ~ W H by multiplicative updates. A row's weights follow from H alone (``inner`` updates from
    even weights), so a round sums two small matrices and keeps no rows; it ends when H moves less than ``tol``."""
    _, mean, _ = _moments(df, v)
    h = np.random.default_rng(seed).uniform(0.5, 1.5, (n, len(mean))) * np.maximum(mean, 1e-9)

    def weights(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w = np.ones((len(x), n))
        xh, hh = x @ h.T, h @ h.T
        for _ in range(inner):
            w = w * xh / np.maximum(w @ hh, 1e-12)
        return w

    for _ in range(max_iter):
        now = h

        def sums(x, now=now):
            w = weights(x, now)
            return {"wx": w.T @ x, "ww": w.T @ w}

        s = summed(df, v, sums)
        h = h * s["wx"] / np.maximum(s["ww"] @ h, 1e-12)
        if np.abs(h - now).max() <= tol * np.abs(now).max():
            break
    final = h
    return apply(df, [v], lambda x: (weights(x, final),), [out])


def factor_analysis(df: DataFrame, v: str, n: int = 16, max_iter: int = 1000, tol: float = 1e-8, out: str = "factors") -> DataFrame:
    """Posterior means of ``n`` factors with a noise variance for each component, by expectation and maximisation on the covariance."""
    _, mean, cov = _moments(df, v)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:n]
    load = _oriented(vectors[:, top]) * np.sqrt(np.maximum(values[top], 1e-12))
    noise = np.maximum(np.diag(cov) - (load**2).sum(axis=1), 1e-6)
    last = -np.inf
    for _ in range(max_iter):
        inv = np.linalg.inv(np.eye(n) + (load.T / noise) @ load)
        beta = inv @ (load.T / noise)
        second = inv + beta @ cov @ beta.T
        load = cov @ beta.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(cov - load @ beta @ cov), 1e-6)
        sign, det = np.linalg.slogdet(load @ load.T + np.diag(noise))
        value = -det - np.trace(np.linalg.solve(load @ load.T + np.diag(noise), cov))
        if abs(value - last) < tol:
            break
        last = value
    beta = np.linalg.inv(np.eye(n) + (load.T / noise) @ load) @ (load.T / noise)
    return apply(df, [v], lambda x: ((x - mean) @ beta.T,), [out])

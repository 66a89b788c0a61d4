"""Generation with state: a step function reads the last ``rf`` values of a sequence and writes the next ones.

Prompts are independent, so each is one unit of work; what a step needs beside its prompt (a bank of frames, a
transition table, weights) is bounded and travels with the function."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import matrix
from .blocks import Names
from .neighbors import distances, dtw


class Generator(Protocol):
    """What ``generate`` runs: ``rf`` values read a step, ``before`` at the start, ``step`` for the values from t on, ``after`` at the end."""

    rf: int
    parameters: tuple[str, ...]

    def before(self, prompt: np.ndarray) -> object: ...

    def step(self, window: np.ndarray, t: int, state: object, **parameters) -> tuple[np.ndarray, object]: ...

    def after(self, state: object) -> None: ...


class Stateless:
    """A generator of a plain function of the window."""

    parameters: tuple[str, ...] = ()

    def __init__(self, rf: int, fn: Callable[[np.ndarray], np.ndarray]):
        self.rf, self.fn = rf, fn

    def before(self, prompt):
        return None

    def step(self, window, t, state, **parameters):
        return self.fn(window), state

    def after(self, state):
        return None


def accepted(generator: Generator, parameters: dict) -> dict:
    """The parameters that a generator knows."""
    return {k: v for k, v in parameters.items() if k in generator.parameters}


def extend(prompt: np.ndarray, generator: Generator, n: int, **parameters) -> np.ndarray:
    """The prompt with ``n`` values behind it; a step may write several, and what goes beyond the end is left."""
    prior = len(prompt)
    if prior < generator.rf:
        raise ValueError(f"the prompt has {prior} values, {generator.rf} are read")
    out = np.concatenate([prompt, np.zeros((n, *prompt.shape[1:]), prompt.dtype)])
    state, t, known = generator.before(prompt), prior, accepted(generator, parameters)
    while t < prior + n:
        new, state = generator.step(out[t - generator.rf : t], t, state, **known)
        new = np.atleast_1d(new)[: prior + n - t]
        out[t : t + len(new)] = new
        t += len(new)
    generator.after(state)
    return out


def generate(prompts: DataFrame, source: Names, v: str, generator: Generator, n: int, callback: Callable[[DataFrame], None] | None = None, **parameters) -> DataFrame:
    """source, v: every prompt (an array of numbers) with ``n`` more values."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(v)
            out = [extend(np.array(x, float), generator, n, **parameters).tolist() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in source), pa.array(out, pa.list_(pa.float64()))], [*source, v])

    d = prompts.select(*source, F.col(v).cast("array<double>").alias(v))
    out = d.mapInArrow(run, d.schema)
    if callback:
        callback(out)
    return out


def encode_decode(df: DataFrame, source: Names, v: str, fn: Callable[[np.ndarray], np.ndarray], size: int) -> DataFrame:
    """Arrays whose whole windows of ``size`` are replaced by what ``fn`` makes of them."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(b.schema.get_field_index(v)).to_pylist():
                y = np.array(x, float)
                for k in range(0, len(y) - size + 1, size):
                    y[k : k + size] = fn(y[k : k + size])
                out.append(y.tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in source), pa.array(out, pa.list_(pa.float64()))], [*source, v])

    d = df.select(*source, F.col(v).cast("array<double>").alias(v))
    return d.mapInArrow(run, d.schema)


def nearest_next(queries: DataFrame, bank: DataFrame, source: Names, t: str, v: str, n: int) -> DataFrame:
    """source, step, bank_t: the frames of ``bank`` that follow the end of each prompt's cheapest path through it, up to the bank's end."""
    frames = bank.orderBy(t).select(v).toArrow()
    y = np.abs(matrix(frames.column(0)))
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}

    def run(q: pa.Table) -> pa.Table:
        q = q.sort_by(t)
        end = dtw(distances(np.abs(matrix(q.column(v))), y, "cosine"))[-1][1]
        found = np.arange(end + 1, min(end + 1 + n, len(y)))
        first = pa.array(np.zeros(len(found), np.int64))
        return pa.table({**{c: q.column(c).combine_chunks().take(first) for c in source}, "step": pa.array(np.arange(len(found))), "bank_t": pa.array(found, pa.int64())})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in source), "step long, bank_t long"])
    return queries.select(*source, t, F.col(v).cast("array<double>").alias(v)).groupBy(*source).applyInArrow(run, schema)


def transitions(df: DataFrame, source: Names, t: str, label: str) -> DataFrame:
    """(label, next, n): how often a label follows another."""
    from .blocks import near

    d = near(df, source, t, 0, 1, {"next": lambda w: F.lead(label).over(w)}).where(F.col("next").isNotNull())
    return d.groupBy(label, "next").agg(F.count("*").alias("n"))


def likeliest(table: DataFrame, label: str) -> DataFrame:
    """(label, next): the most frequent follower, ties to the smaller."""
    return table.groupBy(label).agg(F.min_by("next", F.struct(-F.col("n"), F.col("next"))).alias("next"))


def walk(starts: DataFrame, table: DataFrame, label: str, n: int) -> DataFrame:
    """``starts`` (id, label) followed ``n`` times through (label, next): id, step, label. A label without a follower ends a walk."""
    now, out = starts.select("id", F.lit(0).alias("step"), label), None
    step = table.select(F.col(label).alias("_l"), F.col("next").alias("_n"))
    for k in range(n + 1):
        out = now if out is None else out.union(now)
        now = now.join(step, now[label] == step["_l"]).select("id", F.lit(k + 1).alias("step"), F.col("_n").alias(label))
    return out


def sample_categories(logits: Column, temperature: float | None = None, u: Column | None = None) -> Column:
    """The largest component's index, or with a temperature the one that ``u`` in [0, 1) draws from the softmax."""
    from ..functions.pointwise import arg_max, soft_max

    if temperature is None:
        return arg_max(logits).cast("long")
    p = soft_max(F.transform(logits, lambda x: x / F.lit(float(temperature))))
    running = F.aggregate(p, F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("k")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["k"] + F.when(a["s"] + x <= u, 1).otherwise(0)).alias("k")))
    return F.least(running["k"], (F.size(logits) - 1).cast("long"))


def vote(outputs: list[Column], weights: list[float]) -> Column:
    """The weighted sum of models' outputs, as arrays."""
    from ..functions.pointwise import weighted_sum

    return weighted_sum(outputs, weights)


def ensemble_plan(events: list[tuple[str, float, float]], sr: int, max_seconds: float) -> list[tuple[str, int, int, float]]:
    """(generator, start, samples, temperature): events one after the other; one that would pass the end becomes silence up to it,
    and what comes after is left out."""
    total, t, out = int(max_seconds * sr), 0, []
    for name, seconds, temperature in events:
        n = int(seconds * sr)
        if t >= total:
            break
        if t + n > total:
            out.append(("silence", t, total - t, temperature))
            break
        out.append((name, t, n, temperature))
        t += n
    return out


def ensemble(prompt: np.ndarray, events: list[tuple[str, float, float]], generators: dict[str, Generator], sr: int, max_seconds: float) -> np.ndarray:
    """The output of an ensemble: each event goes on from all that was made before."""
    out = prompt
    for name, _, n, temperature in ensemble_plan(events, sr, max_seconds):
        out = np.concatenate([out, np.zeros(n)]) if name == "silence" else extend(out, generators[name], n, temperature=temperature)
    return out[len(prompt) :]


def temperature_walk(n: int, start: float = 0.95, step: float = 0.02, low: float = 0.85, high: float = 0.999, seed: int = 0) -> list[float]:
    """A seeded random walk between two bounds."""
    r, out = np.random.default_rng(seed), [float(np.clip(start, low, high))]
    for d in r.uniform(-step, step, max(0, n - 1)):
        out.append(float(np.clip(out[-1] + d, low, high)))
    return out[:n]


def chunked(prompts: DataFrame, source: Names, v: str, generator: Generator, chunks: int, n: int, seed_length: int, **parameters) -> DataFrame:
    """source, chunk, v: chunks of ``n`` values, each from the last ``seed_length`` values of the one before."""
    out, now = None, prompts
    for k, temperature in enumerate(temperature_walk(chunks)):
        new = generate(now, source, v, generator, n, temperature=temperature, **parameters)
        one = new.select(*source, F.lit(k).alias("chunk"), F.slice(v, F.size(v) - n + 1, n).alias(v))
        out = one if out is None else out.union(one)
        now = new.select(*source, F.slice(v, F.size(v) - seed_length + 1, seed_length).alias(v))
    return out


def tail(df: DataFrame, source: Names, t: str, x: str, n: int) -> DataFrame:
    """The last ``n`` samples of each source, numbered from 0: the seed of the next chunk."""
    from .blocks import join_by, lengths

    d = join_by(df.select(*source, t, x), lengths(df, source, "_n"), source).where(F.col(t) >= F.col("_n") - n)
    return d.select(*source, (F.col(t) - F.greatest(F.col("_n") - n, F.lit(0))).alias(t), x)


def cadence(t: Column, frame_sizes: list[int]) -> list[tuple[Column, Column]]:
    """For each tier whether it runs at ``t``, and which of its outputs the tier below reads."""
    out = []
    for k, size in enumerate(frame_sizes):
        above = frame_sizes[k - 1] if k else size
        out.append((t % size == 0, F.floor(t / size) % max(1, above // size)))
    return out


def receptive_field(kernels: list[int], dilations: list[int]) -> int:
    return sum((k - 1) * d for k, d in zip(kernels, dilations)) + 1


def dilations(blocks: list[int], kernel: int = 2) -> list[int]:
    """Powers of the kernel size from 1 on in each block."""
    return [kernel**i for n in blocks for i in range(n)]


def gated_layer(x: np.ndarray, w_f: np.ndarray, w_g: np.ndarray, w_skip: np.ndarray, w_res: np.ndarray, dilation: int) -> tuple[np.ndarray, np.ndarray]:
    """A dilated causal layer on (time, in): tanh times sigmoid of two convolutions, a skip output, and the input plus a residual.
    Weights are (kernel, in, hidden) and (hidden, out); the first (kernel - 1) * dilation steps give no output."""
    k = len(w_f)
    n = len(x) - (k - 1) * dilation
    if n <= 0:
        raise ValueError("the input is shorter than the layer's reach")
    taps = [x[i * dilation : i * dilation + n] for i in range(k)]
    f, g = (sum(p @ w for p, w in zip(taps, ws)) for ws in (w_f, w_g))
    h = np.tanh(f) / (1 + np.exp(-g))
    return h @ w_skip, x[-n:] + h @ w_res


class GatedStack:
    """A stack of gated layers as a generator of scalars; ``step`` reads its receptive field."""

    parameters: tuple[str, ...] = ()

    def __init__(self, layers: list[tuple[np.ndarray, ...]], dilations_: list[int], head: np.ndarray):
        self.layers, self.dilations, self.head = layers, dilations_, head
        self.rf = receptive_field([len(w[0]) for w in layers], dilations_)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """(time, 1) to (time - rf + 1, out): the sum of skips through the head."""
        skips = []
        for w, d in zip(self.layers, self.dilations):
            s, x = gated_layer(x, *w, d)
            skips.append(s)
        n = len(skips[-1])
        return sum(s[-n:] for s in skips) @ self.head

    def before(self, prompt):
        return None

    def step(self, window, t, state, **parameters):
        return self.forward(window[:, None])[-1], state

    def after(self, state):
        return None

"""Forward passes of small layers as numpy kernels with given weights, for use in ``arrays.apply`` and ``generate``.

Inputs are (batch, time, features) unless said otherwise; nothing is trained here."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def linear(x: np.ndarray, w: np.ndarray, b: np.ndarray | float = 0.0) -> np.ndarray:
    """``w`` is (in, out)."""
    return x @ w + b


def framed_linear(x: np.ndarray, size: int, hop: int, w: np.ndarray, b: np.ndarray | float = 0.0) -> np.ndarray:
    """Frames of (batch, time) through one linear map: (batch, frames, out)."""
    n = 1 + (x.shape[1] - size) // hop
    return linear(np.stack([x[:, k * hop : k * hop + size] for k in range(n)], axis=1), w, b)


def chunked_linear(x: np.ndarray, w: np.ndarray, b: np.ndarray | float, chunks: int, total: bool = False):
    """A linear map whose output is split in equal parts, or summed over them."""
    parts = np.split(linear(x, w, b), chunks, axis=-1)
    return sum(parts) if total else parts


def embedding(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[ids]


def embedding_bag(ids: np.ndarray, size: int, hop: int, table: np.ndarray) -> np.ndarray:
    """The mean of the vectors of each frame of symbols."""
    n = 1 + (ids.shape[1] - size) // hop
    return np.stack([table[ids[:, k * hop : k * hop + size]].mean(axis=1) for k in range(n)], axis=1)


def conv1d(x: np.ndarray, w: np.ndarray, stride: int = 1, dilation: int = 1, b: np.ndarray | float = 0.0) -> np.ndarray:
    """``w`` is (kernel, in, out); no padding."""
    k = len(w)
    n = 1 + (x.shape[1] - (k - 1) * dilation - 1) // stride
    return sum(x[:, i * dilation : i * dilation + (n - 1) * stride + 1 : stride] @ w[i] for i in range(k)) + b


def conv_transpose1d(x: np.ndarray, w: np.ndarray, stride: int = 1) -> np.ndarray:
    """The transpose of ``conv1d`` with the same weights (kernel, out, in)."""
    k, n = len(w), x.shape[1]
    out = np.zeros((x.shape[0], (n - 1) * stride + k, w.shape[1]))
    for i in range(k):
        out[:, i : i + (n - 1) * stride + 1 : stride] += x @ w[i].T
    return out


def tied_autoencoder(x: np.ndarray, weights: list[np.ndarray], strides: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The code and the reconstruction, encoder and decoder sharing their weights."""
    z = x
    for w, s in zip(weights, strides):
        z = conv1d(z, w, s)
    y = z
    for w, s in zip(reversed(weights), reversed(strides)):
        y = conv_transpose1d(y, w, s)
    return z, y


def mlp(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], act: Callable = np.tanh, min_temperature: float | None = None) -> np.ndarray:
    """Linear layers with an activation between; with a least temperature the last output is one, and divides the others."""
    for k, (w, b) in enumerate(layers):
        x = linear(x, w, b)
        if k < len(layers) - 1:
            x = act(x)
    if min_temperature is None:
        return x
    return x[..., :-1] / np.maximum(sigmoid(x[..., -1:]), min_temperature)


def gaussian(mean: np.ndarray, log_scale: np.ndarray, noise: np.ndarray) -> np.ndarray:
    return mean + np.exp(log_scale) * noise


def affine(mean: np.ndarray, log_scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mean + np.exp(log_scale) * x


def logistic(mean: np.ndarray, log_scale: np.ndarray, u: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """A logistic draw from even numbers in (0, 1)."""
    u = np.clip(u, eps, 1 - eps)
    return mean + np.exp(log_scale) * (np.log(u) - np.log1p(-u))


def mixed(parts: list[np.ndarray], reduce: str = "sum", weights: np.ndarray | None = None) -> np.ndarray:
    """Several inputs as one: their sum, mean, or a mix by the softmax of weights."""
    if reduce == "mix":
        e = np.exp(weights - np.max(weights))
        return sum(w * p for w, p in zip(e / e.sum(), parts))
    return sum(parts) / (len(parts) if reduce == "mean" else 1)


def lstm(x: np.ndarray, w_x: np.ndarray, w_h: np.ndarray, b: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None):
    """All outputs and the last state; gates are input, forget, cell, output in that order."""
    n = w_h.shape[0]
    h, c = state or (np.zeros((x.shape[0], n)), np.zeros((x.shape[0], n)))
    out = []
    for t in range(x.shape[1]):
        g = x[:, t] @ w_x + h @ w_h + b
        i, f, o = sigmoid(g[:, :n]), sigmoid(g[:, n : 2 * n]), sigmoid(g[:, 3 * n :])
        c = f * c + i * np.tanh(g[:, 2 * n : 3 * n])
        h = o * np.tanh(c)
        out.append(h)
    return np.stack(out, axis=1), (h, c)


def encode(x: np.ndarray, weights: tuple, pooling: str = "edge_mean") -> tuple[np.ndarray, tuple]:
    """A window of ``hop`` frames as one vector: edges or all frames, summed or averaged; and the state."""
    y, state = lstm(x, *weights)
    both = y[:, :1] + y[:, -1:]
    kinds = {"edge_sum": both, "edge_mean": both / 2, "sum": y.sum(axis=1, keepdims=True), "mean": y.mean(axis=1, keepdims=True)}
    return kinds[pooling], state


def decode(code: np.ndarray, hop: int, weights: tuple, state: tuple | None = None) -> np.ndarray:
    """A vector as ``hop`` frames."""
    return lstm(np.repeat(code, hop, axis=1), *weights, state=state)[0]


def tier(x: np.ndarray, size: int, weights: tuple, up: np.ndarray, condition: np.ndarray | None = None, state: tuple | None = None):
    """A tier of (batch, time): frames of ``size`` with what the tier above gives, through a recurrent layer, spread over
    ``len(up)`` steps of the tier below. ``up`` is (steps, hidden, out)."""
    n = x.shape[1] // size
    f = x[:, : n * size].reshape(len(x), n, size)
    f = f if condition is None else np.concatenate([f, condition[:, :n]], axis=-1)
    y, state = lstm(f, *weights, state=state)
    return np.stack([y @ u for u in up], axis=2).reshape(len(x), n * len(up), -1), state


def attention(x: np.ndarray, w_q: np.ndarray, w_k: np.ndarray, w_v: np.ndarray, heads: int = 1, causal: bool = True) -> np.ndarray:
    b, t, _ = x.shape
    q, k, v = ((x @ w).reshape(b, t, heads, -1).swapaxes(1, 2) for w in (w_q, w_k, w_v))
    s = q @ k.swapaxes(2, 3) / math.sqrt(q.shape[-1])
    if causal:
        s = np.where(np.tril(np.ones((t, t), bool)), s, -np.inf)
    p = np.exp(s - s.max(axis=-1, keepdims=True))
    return ((p / p.sum(axis=-1, keepdims=True)) @ v).swapaxes(1, 2).reshape(b, t, -1)


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps)


def transformer_layer(x: np.ndarray, w_q, w_k, w_v, w_o, w_1, w_2, heads: int = 1) -> np.ndarray:
    """Causal attention and a two-layer map, each with a residual and a norm behind."""
    x = layer_norm(x + attention(x, w_q, w_k, w_v, heads) @ w_o)
    return layer_norm(x + np.maximum(x @ w_1, 0) @ w_2)


def phase_shuffle(x: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Each sequence moved by its shift, the gap mirrored."""
    return np.stack([np.pad(r, ((max(s, 0), max(-s, 0)), (0, 0)), mode="reflect")[max(-s, 0) : max(-s, 0) + len(r)] for r, s in zip(x, shifts)])


def cosine_anneal(step: int, total: int, start: float, end: float) -> float:
    """From ``start`` to ``end`` along half a cosine."""
    return end + (start - end) * (1 + math.cos(math.pi * min(step, total) / total)) / 2


def due(epoch: int, when: int | Iterable[int]) -> bool:
    """Whether something happens after an epoch: every ``when`` epochs, or in those given."""
    return (epoch % when == 0) if isinstance(when, int) else epoch in set(when)


def norm_of(gradients: Iterable[np.ndarray]) -> float:
    """The norm of all gradients together."""
    return math.sqrt(sum(float((g * g).sum()) for g in gradients))


def checked(x: np.ndarray, name: str = "value") -> np.ndarray:
    if np.isnan(x).any():
        raise ValueError(f"nan in {name}")
    return x


def reset_due(chunk: int, last: int | None) -> bool:
    """Whether a hidden state starts anew: a batch that does not go on where the last one ended."""
    return last is None or chunk != last + 1


def resampled(x: np.ndarray, t_factor: int, d_factor: float, w: np.ndarray) -> np.ndarray:
    """(batch, time, dim) to (batch, time * t_factor, dim * d_factor) by one linear map and a reshape."""
    b, t, d = x.shape
    return (x @ w).reshape(b, t * t_factor, round(d * d_factor))


class Switch:
    """One output while training, another when generating."""

    def __init__(self, train: Callable, generate: Callable):
        self.train, self.generate, self.training = train, generate, True

    def __call__(self, *args):
        return (self.train if self.training else self.generate)(*args)


class FastStack:
    """A stack of gated layers (see ``generate.GatedStack``) that keeps each layer's last inputs, so a step costs one
    column a layer and not its receptive field."""

    parameters: tuple[str, ...] = ()

    def __init__(self, stack):
        self.stack, self.rf = stack, stack.rf

    def before(self, prompt: np.ndarray):
        """Each layer's inputs over the prompt, as far back as the layer reaches."""
        from ..operators.generate import gated_layer

        held, x = [], np.asarray(prompt, float)[:, None]
        for w, d in zip(self.stack.layers, self.stack.dilations):
            reach = (len(w[0]) - 1) * d
            # the newest input comes with the step
            held.append(list(x[len(x) - 1 - reach : len(x) - 1]) if reach else [])
            x = gated_layer(x, *w, d)[1]
        return held

    def step(self, window, t, state, **parameters):
        x, skips = np.array([window[-1]], float), []
        for (w_f, w_g, w_s, w_r), d, held in zip(self.stack.layers, self.stack.dilations, state):
            held.append(x)
            taps = [held[len(held) - 1 - (len(w_f) - 1 - i) * d] for i in range(len(w_f))]
            h = np.tanh(sum(p @ w for p, w in zip(taps, w_f))) * sigmoid(sum(p @ w for p, w in zip(taps, w_g)))
            if len(held) > (len(w_f) - 1) * d:
                del held[0]
            skips.append(h @ w_s)
            x = x + h @ w_r
        return sum(skips) @ self.stack.head, state

    def after(self, state):
        return None

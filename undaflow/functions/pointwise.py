"""Per-sample functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mu_law_compress(x: Column, levels: int = 256, scale: float = 1.0) -> Column:
    """Symbol 0 to levels - 1 of a sample in [-1, 1]; the last step truncates."""
    mu = levels - 1
    y = F.signum(x) * F.log1p(mu * F.abs(x) * scale) / F.lit(math.log1p(mu * scale))
    return ((y + 1) / 2 * mu + 0.5).cast("long")


def mu_law_expand(q: Column, levels: int = 256, scale: float = 1.0) -> Column:
    mu = levels - 1
    x = q / F.lit(float(mu)) * 2 - 1
    return F.signum(x) * (F.exp(F.abs(x) * F.lit(math.log1p(mu * scale))) - 1) / F.lit(mu * scale)


def linearize(q: Column, classes: int) -> Column:
    """Class index to [-1, 1)."""
    return (q / F.lit(float(classes)) - 0.5) * 2


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def mish(x: Column) -> Column:
    return x * F.tanh(softplus(x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gate(f: Column, g: Column) -> Column:
    return F.tanh(f) * sigmoid(g)


def principal_angle(x: Column) -> Column:
    """The angle in [-pi, pi], halves rounded to even."""
    return x - F.lit(2 * math.pi) * F.rint(x / F.lit(2 * math.pi))


def safe_log(x: Column, least: float = 1e-5) -> Column:
    return F.log(F.greatest(x, F.lit(least)))


def arg_max(v: Column) -> Column:
    """Index of the first largest component."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def p_norm(v: Column, p: float) -> Column:
    if p == math.inf:
        return F.array_max(F.transform(v, F.abs))
    return F.pow(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(p))), F.lit(1.0 / p))


def a_law_compress(x: Column, a: float = 87.6, levels: int = 256) -> Column:
    """Symbol 0 to levels - 1 of a sample in [-1, 1]: how many points of an even grid lie below its companded value."""
    k, z = F.lit(1 + math.log(a)), F.abs(x)
    y = F.signum(x) * F.when(z < 1 / a, a * z / k).otherwise((1 + F.log(a * z)) / k)
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.ceil((y + 1) / 2 * (levels - 1)))).cast("long")


def a_law_expand(q: Column, a: float = 87.6, levels: int = 256, centered: bool = False) -> Column:
    """Expand 2 q / levels; ``centered`` takes 1 off before, which makes it an inverse."""
    y, k = 2 * q / F.lit(float(levels)) - (1 if centered else 0), 1 + math.log(a)
    z = F.abs(y)
    return F.signum(y) * F.when(z < 1 / k, z * k / a).otherwise(F.exp(z * k - 1) / a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def glu(v: Column, half: int) -> Column:
    """The first half of the components, gated by the second."""
    return F.zip_with(F.slice(v, 1, half), F.slice(v, half + 1, half), lambda a, b: a * sigmoid(b))


def soft_max(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, z: s + z))


def log_sum_exp(v: Column) -> Column:
    return F.array_max(v) + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(v))))


def odd_reflect(v: Column, k: int) -> Column:
    """The array with k // 2 samples more on each side, mirrored through its ends."""
    h, first, last = k // 2, F.element_at(v, 1), F.element_at(v, -1)
    left = F.transform(F.reverse(F.slice(v, 2, h)), lambda x: 2 * first - x)
    right = F.transform(F.reverse(F.slice(v, F.size(v) - h, h)), lambda x: 2 * last - x)
    return F.concat(left, v, right)


def identity(x: Column) -> Column:
    return x


#: Activations by name; each maps a Column of numbers.
ACTIVATIONS = {"identity": identity, "tanh": F.tanh, "sigmoid": sigmoid, "mish": mish, "relu": relu, "softplus": softplus, "abs": F.abs, "sin": F.sin, "cos": F.cos}


def activation(name: str):
    """The activation of a name, whatever its case."""
    if name.lower() not in ACTIVATIONS:
        raise KeyError(f"no activation {name!r}; there are {sorted(ACTIVATIONS)}")
    return ACTIVATIONS[name.lower()]


def scaled(act, v: Column, s: Column, r: Column | None = None) -> Column:
    """act(r * x / s) * s on arrays of one length; without ``r`` the rate is 1."""
    if r is None:
        return F.zip_with(v, s, lambda x, a: act(x / a) * a)
    return F.zip_with(F.arrays_zip(v.alias("x"), r.alias("r")), s, lambda p, a: act(p["r"] * p["x"] / a) * a)


def phase_cos_tanh(v: Column, psi: Column) -> Column:
    """Half pi times cos(psi * tanh(x)) on arrays."""
    return F.zip_with(v, psi, lambda x, p: F.cos(F.tanh(x) * p) * F.lit(math.pi / 2))


def phase_cos(v: Column, psi: Column) -> Column:
    return F.zip_with(v, psi, lambda x, p: F.cos(x * p) * F.lit(math.pi / 2))


def phase_tanh(x: Column) -> Column:
    return F.tanh(x) * F.lit(math.pi / 2)


def split(v: Column, n: int, size: int) -> Column:
    """An array of ``size`` components as ``n`` equal parts."""
    step = size // n
    return F.array(*[F.slice(v, k * step + 1, step) for k in range(n)])


def split_sum(v: Column, n: int, size: int) -> Column:
    """The sum of the ``n`` equal parts of an array."""
    parts, step = None, size // n
    for k in range(n):
        one = F.slice(v, k * step + 1, step)
        parts = one if parts is None else F.zip_with(parts, one, lambda a, b: a + b)
    return parts


def transpose(m: Column, width: int) -> Column:
    """Rows to columns of an array of arrays of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.transform(m, lambda row: F.get(row, i)))


def unfold(v: Column, width: int) -> Column:
    """An array as consecutive rows of ``width``; the inverse of ``flatten``."""
    return F.transform(F.sequence(F.lit(0), (F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width))


def prompt(v: Column, n_blanks: int) -> Column:
    """A prompt with ``n_blanks`` zeros behind it."""
    return F.concat(v, F.array_repeat(F.lit(0.0), n_blanks)) if n_blanks > 0 else v


def fill(v: Column | None, *parts: tuple[str | float, int]) -> Column:
    """``v`` and then each part: n zeros (``blank``), n times a number, or nothing (``data``)."""
    out = [] if v is None else [v]
    for kind, n in parts:
        if kind != "data":
            out.append(F.array_repeat(F.lit(0.0 if kind == "blank" else float(kind)), n))
    return F.concat(*out)


def causal_pad(v: Column, pad: int) -> Column:
    """Zeros on the left for a positive ``pad``, on the right for a negative one."""
    zeros = F.array_repeat(F.lit(0.0), abs(pad))
    return F.concat(zeros, v) if pad >= 0 else F.concat(v, zeros)


def unfolded_mix(parts: list[Column], weights: list[float] | None = None, reduce: str = "sum") -> Column:
    """Arrays of one length as one: their sum, mean, or a mix by the softmax of ``weights``."""
    if reduce == "mix":
        e = [math.exp(w - max(weights)) for w in weights]
        share = [x / sum(e) for x in e]
    else:
        share = [1.0 if reduce == "sum" else 1.0 / len(parts)] * len(parts)
    return weighted_sum(parts, share)


def weighted_sum(parts: list[Column], weights: list[float]) -> Column:
    """The weighted sum of arrays of one length."""
    out = None
    for p, w in zip(parts, weights):
        one = F.zip_with(p, F.array_repeat(F.lit(float(w)), F.size(p)), lambda x, y: x * y)
        out = one if out is None else F.zip_with(out, one, lambda a, b: a + b)
    return out


def affine(v: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """A linear layer with literal weights."""
    b = bias or [0.0] * len(weights)
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) + F.lit(float(c)) for row, c in zip(weights, b)])


def a_law_compress_sequence(df, source: list[str], x: str, out: str = "q", **more):
    """Symbols of a signal that is normalised first if any of its samples is over 1 in size."""
    from ..operators.blocks import join_by

    top = df.groupBy(*source).agg(F.max(F.abs(x)).alias("_top"))
    y = F.col(x) / F.when(F.col("_top") > 1, F.col("_top")).otherwise(1.0)
    return join_by(df, top, source).withColumn(out, a_law_compress(y, **more)).drop("_top")

"""Time units, conversions between them, and the spans that are built from them.

``convert`` takes numbers and Columns alike. Units are ordered Sample < Frame < Second < Step."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sample:
    sr: int | None = None
    rank = 0


@dataclass(frozen=True)
class Frame:
    frame_size: int
    hop_length: int
    padding: bool = False
    rank = 1


@dataclass(frozen=True)
class Second:
    sr: int | None = None
    rank = 2


@dataclass(frozen=True)
class Step:
    rank = 3


Unit = Sample | Frame | Second | Step


def _whole(x):
    return x.cast("long") if isinstance(x, Column) else int(x)


def _floor(x):
    return F.floor(x).cast("long") if isinstance(x, Column) else math.floor(x)


def _over(x, d):
    return x / F.lit(float(d)) if isinstance(x, Column) else x / d


def rate(*units: Unit) -> int:
    """The one sample rate that units name."""
    found = {u.sr for u in units if getattr(u, "sr", None) is not None}
    if len(found) != 1:
        raise ValueError(f"one sample rate is needed, not {sorted(found)}")
    return found.pop()


def extra(unit: Frame, as_length: bool) -> int:
    """Samples of the first frame beyond a hop, which lengths count unless frames are padded."""
    return unit.frame_size - unit.hop_length if as_length and not unit.padding else 0


def convert(x, a: Unit, b: Unit, as_length: bool = False):
    """``x`` in unit ``a`` as a number of unit ``b``. Samples of two rates are not converted; seconds stay seconds;
    a step is one of whatever it meets, but no time."""
    if isinstance(a, Sample):
        if isinstance(b, Frame):
            return _floor(_over(x - extra(b, as_length), b.hop_length))
        return _over(x, rate(a, b)) if isinstance(b, Second) else x
    if isinstance(a, Frame):
        first = int(a.padding)
        if isinstance(b, Sample):
            return _whole((x - first) * a.hop_length) + extra(a, as_length)
        if isinstance(b, Second):
            return _over((x - first) * a.hop_length + extra(a, as_length), rate(b))
        return x - first
    if isinstance(a, Second):
        if isinstance(b, Sample):
            return _whole(x * rate(a, b))
        if isinstance(b, Frame):
            return _floor(_over(_whole(x * rate(a)) - extra(b, as_length), b.hop_length))
        if isinstance(b, Second):
            return x
        raise TypeError("seconds are no steps")
    if isinstance(b, Second):
        raise TypeError("steps are no seconds")
    return x


@dataclass(frozen=True)
class ItemSpec:
    """A span: its start and length in ``unit`` and the stride of what is read from it."""

    shift: float = 0
    length: float = 0
    stride: int = 1
    unit: Unit = Step()

    def to(self, unit: Unit) -> ItemSpec:
        return replace(self, shift=convert(self.shift, self.unit, unit), length=convert(self.length, self.unit, unit, as_length=True), unit=unit)

    def __add__(self, other: ItemSpec) -> ItemSpec:
        """Shifts and lengths added up in the smaller unit, with the larger stride."""
        if type(self.unit) is type(other.unit) and self.unit != other.unit:
            raise ValueError(f"{self.unit} and {other.unit} differ in their parameters")
        unit = min(self.unit, other.unit, key=lambda u: u.rank)
        a, b = self.to(unit) if self.unit != unit else self, other.to(unit) if other.unit != unit else other
        return ItemSpec(a.shift + b.shift, a.length + b.length, max(a.stride, b.stride), unit)


def prompt_starts(seconds: list[float], sr: int) -> list[int]:
    return [convert(s, Second(sr), Sample(sr)) for s in seconds]


def n_steps(seconds: float, sr: int, unit: Unit) -> int:
    """Steps that make ``seconds`` of output: samples, or one frame more than they fill."""
    samples = convert(seconds, Second(sr), Sample(sr))
    return samples if isinstance(unit, Sample) else convert(samples, Sample(sr), unit, as_length=True) + 1


def elapsed(seconds: float) -> tuple[int, int, int, float]:
    """Days, hours, minutes and seconds."""
    minutes, s = divmod(seconds, 60)
    hours, m = divmod(int(minutes), 60)
    days, h = divmod(hours, 24)
    return days, h, m, s


def samples_to_frames(x: Column, size: int, hop: int, padded: bool = False, as_length: bool = False) -> Column:
    return convert(x, Sample(), Frame(size, hop, padded), as_length)


def frames_to_samples(x: Column, size: int, hop: int, padded: bool = False, as_length: bool = False) -> Column:
    return convert(x, Frame(size, hop, padded), Sample(), as_length).cast("long")


def samples_to_seconds(x: Column, sr: int) -> Column:
    return convert(x, Sample(sr), Second())


def seconds_to_samples(x: Column, sr: int) -> Column:
    return convert(x, Second(sr), Sample())

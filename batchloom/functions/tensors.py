"""Flat tensors with a known shape: index arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def normalise(x: Column, mean: Sequence[float], std: Sequence[float], channel_size: int, scale: float = 255.0) -> Column:
    """``(x / scale - mean) / std`` per channel of a channel-first tensor."""
    means, stds = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    channel = lambda i: F.floor(i / channel_size).cast("int")
    return F.transform(x, lambda v, i: (v / scale - F.get(means, channel(i))) / F.get(stds, channel(i)))


def to_unit_range(x: Column, scale: float = 255.0) -> Column:
    """``x / scale * 2 - 1``."""
    return F.transform(x, lambda v: v / scale * 2 - 1)


def reverse_channels(x: Column, pixels: int, channels: int) -> Column:
    """Channel order of a channel-last tensor turned round."""
    return F.transform(_places(pixels * channels), lambda i: F.get(x, i - i % channels + (channels - 1) - i % channels))


def channels_first(x: Column, pixels: int, channels: int) -> Column:
    """Height, width, channel to channel, height, width."""
    return F.transform(_places(pixels * channels), lambda i: F.get(x, i % pixels * channels + F.floor(i / pixels).cast("int")))


def mirror(x: Column, height: int, width: int) -> Column:
    """Left and right exchanged, one channel."""
    return F.transform(_places(height * width), lambda i: F.get(x, i - i % width + (width - 1) - i % width))


def reshape(x: Column, shape: Sequence[int]) -> Column:
    """The tensor when its size fits the shape, otherwise null."""
    size = 1
    for n in shape:
        size *= n
    return F.when(F.size(x) == size, x)


def center_crop(x: Column, height: int, width: int, size: int) -> Column:
    """The middle ``size`` x ``size`` part, one channel."""
    top, left = (height - size) // 2, (width - size) // 2
    return F.transform(
        _places(size * size), lambda i: F.get(x, (F.floor(i / size).cast("int") + top) * width + i % size + left)
    )

"""Zero-phase low-pass smoothing of joint series."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The rate the filter assumes, whatever the stream's own.
RATE = 250.0
ORDER = 4
#: Samples by which a series is extended at either end; series that are not longer stay as they are.
PAD = 15
#: Rows that are filtered by one matrix product.
BLOCK = 128


def normalised(cutoff: float, rate: float = RATE) -> float:
    return min(max(cutoff / (rate / 2), 0.01), 0.99)


@lru_cache
def design(wn: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the Butterworth low-pass of order 4, by the bilinear transform."""
    w = 4 * np.tan(np.pi * wn / 2)
    p = -w * np.exp(1j * np.pi * np.array([-3, -1, 1, 3]) / 8)
    a = np.poly((4 + p) / (4 - p)).real
    b = w**ORDER * (1 / np.prod(4 - p)).real * np.poly(-np.ones(ORDER)).real
    return b, a


@lru_cache
def _sections(wn: float) -> list[tuple[np.ndarray, ...]]:
    """The filter as two sections of order 2, each over a block of rows as matrices: what inputs and a state make of
    outputs and of the next state. Poles lie next to 1, where powers of a section stay exact and those of order 4 don't.
    """
    w = 4 * np.tan(np.pi * wn / 2)
    out = []
    for m in (1, 3):
        p = -w * np.exp(1j * np.pi * m / 8)
        pole, gain = (4 + p) / (4 - p), abs(2 * p / (4 - p)) ** 2 / 4  # a gain of 1 for what is constant
        b, a = gain * np.array([1.0, 2.0, 1.0]), np.array([1.0, -2 * pole.real, abs(pole) ** 2])
        step, into = np.array([[-a[1], 1.0], [-a[2], 0.0]]), b[1:] - a[1:] * b[0]
        powers = [np.eye(2)]
        for _ in range(BLOCK):
            powers.append(powers[-1] @ step)
        response = np.array([b[0], *((p @ into)[0] for p in powers[: BLOCK - 1])])
        lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        inner = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        ahead = np.stack([p @ into for p in powers[BLOCK - 1 :: -1]], 1)
        seen = np.stack([p[0] for p in powers[:BLOCK]])
        steady = np.array([1 - b[0], b[2] - a[2]])
        out.append((inner, seen, ahead, powers[BLOCK], steady))
    return out


def _run(wn: float, x: np.ndarray) -> np.ndarray:
    """The filter over the rows of x, all columns at once, from the steady state of the first row on."""
    n, width = x.shape
    for inner, seen, ahead, jump, steady in _sections(wn):
        blocks = np.zeros((-(-n // BLOCK), BLOCK, width))
        blocks.reshape(-1, width)[:n] = x
        state = steady[:, None] * x[0]
        states, pushed = np.empty((len(blocks), 2, width)), ahead @ blocks
        for i, push in enumerate(pushed):  # one step a block
            states[i] = state
            state = jump @ state + push
        x = (inner @ blocks + seen @ states).reshape(-1, width)[:n]
    return x


def zero_phase(x: np.ndarray, cutoff: float, rate: float = RATE) -> np.ndarray:
    """Filter rows in time order forward and backward; odd extension, steady state at the ends."""
    x = np.asarray(x, float)
    if len(x) <= PAD:
        return x
    whole = np.concatenate((2 * x[0] - x[PAD:0:-1], x, 2 * x[-1] - x[-2 : -PAD - 2 : -1]))
    for _ in range(2):
        whole = _run(normalised(cutoff, rate), whole)[::-1]
    return whole[PAD:-PAD]


def smoothed(readings: DataFrame, keys: list[str], cutoff: float, rate: float = RATE) -> DataFrame:
    """Readings with smoothed double ``values``; a stream is filtered as a whole by one task, all joints at once.

    A null vector, or vectors of different lengths, make a stream that stays as it is, with NaN for null; a NaN spreads over its joint.
    """
    names = [c for c in readings.columns if c != "values"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_pos")
        lists = table.column("values").combine_chunks()
        null, offsets = lists.is_null().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        width = np.diff(offsets)
        if len(width) and not null.any() and width[0] and (width == width[0]).all():
            flat = zero_phase(flat.reshape(-1, width[0]), cutoff, rate).ravel()
        values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(null))
        return table.select(names).append_column("values", values)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in readings.schema if f.name != "values")
    return readings.groupBy(*keys).applyInArrow(run, f"{fields}, values array<double>").select(*readings.columns)

"""Radiometry: Planck functions, channel grids and the three computed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants of the radiance definition.
PLANCK, LIGHT, BOLTZMANN = 6.626e-34, 2.998e8, 1.381e-23
C1 = 2.0 * PLANCK * (LIGHT * 100.0) * (LIGHT * 100.0)
C2 = PLANCK / BOLTZMANN * LIGHT * 100.0
GRID_STEP = 5.29044097730104556043
#: Stands for a radiance of zero, whose logarithm doesn't exist.
TINY = 1e-30

# Response of the broad 20 micrometre band at 16.5, 17.0, ... 30.5 micrometres.
T20_RESPONSE = (
    0.0, 0.0480, 0.3720, 0.5840, 0.6950, 0.8560, 0.9060, 1.0000, 0.9870, 0.9340,
    0.8570, 0.7720, 0.8140, 0.6750, 0.5520, 0.2590, 0.2720, 0.2940, 0.1360, 0.1910,
    0.2070, 0.1100, 0.1390, 0.1340, 0.0900, 0.0890, 0.0540, 0.0330, 0.0,
)
# For each band its first wavelength, the step, and its responses; 30 of each, zeros fill the end.
BANDS = {
    "T7": (5.8, 0.2, (0.0, 0.0795, 0.6932, 0.8431, 0.8771, 0.9858, 0.9526, 0.9839, 1.0000, 0.9852, 0.9164, 0.8239, 0.6262, 0.3141, 0.0133, 0.0020)),
    "T9": (7.2, 0.2, (0.0, 0.0023, 0.0025, 0.0036, 0.0133, 0.0649, 0.8122, 0.8801, 0.8683, 0.8313, 1.0000, 0.8781, 0.8652, 0.2299, 0.0065, 0.0013)),
    "T11": (8.8, 0.2, (0.0, 0.0004, 0.0016, 0.0131, 0.0755, 0.7113, 0.8620, 0.9200, 0.9304, 0.9922, 0.9665, 0.9575, 1.0000, 0.9485, 0.9018, 0.9319, 1.0000, 0.9154, 0.8647, 0.3260, 0.0271)),
    "T20": (16.0, 0.5, (0.0, 0.0, 0.0644, 0.3777, 0.5857, 0.6809, 0.7996, 0.9049, 0.9967, 0.9628, 0.9540, 0.9306, 0.8690, 1.0000, 0.7317, 0.5685, 0.4243, 0.3058, 0.2492, 0.2205, 0.2440, 0.2121, 0.1847, 0.1600, 0.2051, 0.1710, 0.0742, 0.0456, 0.0, 0.0)),
    "T15": (14.2, 0.1, (0.0, 0.07, 0.0941, 0.220, 0.6163, 0.7872, 0.7729, 0.9386, 0.9738, 1.0000, 0.9598, 0.7987, 0.6540, 0.370, 0.2305, 0.120)),
}
BAND_POINTS = 30
COLDEST, HOTTEST, TEMPERATURE_STEP = 120.0, 350.0, 0.01


def planck(wave_number: Column | float, temperature: Column) -> Column:
    """Black-body radiance; 0 at and below absolute zero."""
    w = F.lit(wave_number) if isinstance(wave_number, int | float) else wave_number
    value = F.lit(C1) * w * w * w / (F.exp(F.lit(C2) * w / temperature) - 1.0)
    return F.when(temperature > 0, value).otherwise(F.lit(0.0))


def brightness_temperature(wave_number: Column | float, radiance: Column) -> Column:
    """Temperature of the black body with this radiance."""
    w = F.lit(wave_number) if isinstance(wave_number, int | float) else wave_number
    return F.when(radiance > 0, F.lit(C2) * w / F.log(1.0 + F.lit(C1) * w * w * w / radiance))


@cache
def channel_wave_numbers(channels: int) -> tuple[float, ...]:
    """The grid of 148 or 296 channels, in wave numbers cut to four decimals."""
    i = np.arange(channels)
    return tuple((np.floor((28.0 + (296 // channels) * i) * GRID_STEP * 1e4) / 1e4).tolist())


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def scan_of(scan_len: Column) -> Column:
    """1 for a single scan, else 2."""
    return F.when(F.substring(scan_len, 1, 1) == "1", F.lit(1)).otherwise(F.lit(2))


def emissivity(scan_len: Column, radiance: Column, temperature: Column) -> Column:
    """array<double>: radiance over that of a black body at the target's temperature; null without radiances."""

    def on(channels: int) -> Column:
        grid = F.slice(_doubles(channel_wave_numbers(channels)), F.lit(1), F.least(F.size(radiance), F.lit(channels)))
        cut = F.slice(radiance, F.lit(1), F.least(F.size(radiance), F.lit(channels)))
        return F.zip_with(cut, grid, lambda r, w: F.when(r > 0, F.try_divide(r.cast("double"), planck(w, temperature))).otherwise(F.lit(0.0)))

    return F.when(scan_of(scan_len) == 1, on(148)).otherwise(on(296))


@cache
def t20_window(scan: int) -> tuple[int, tuple[tuple[float, float], ...]]:
    """(first channel, (wave number, weight) of each channel) of the 20 micrometre window."""
    n = 143 * scan
    first, last = (17, 43) if scan == 1 else (34, 86)
    i = np.arange(first, last + 1)
    length = 1e8 / np.trunc((28.0 + i * 286.0 / n) * 5.29 * 1e4)
    weight = np.interp(length, 16.5 + 0.5 * np.arange(len(T20_RESPONSE)), T20_RESPONSE, left=0.0, right=0.0)
    return first, tuple(zip((1e4 / length).tolist(), (weight / weight.sum()).tolist(), strict=True))


def t20(scan_len: Column, radiance: Column, _temperature: Column | None = None) -> Column:
    """Response-weighted brightness temperature of the 20 micrometre window; 0 where it can't be had."""

    def on(scan: int) -> Column:
        first, pairs = t20_window(scan)
        grid = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in pairs])
        cut = F.slice(radiance, first + 1, len(pairs))
        terms = F.zip_with(cut, grid, lambda r, g: g["p"] * C2 * g["w"] / F.log(C1 * g["w"] * g["w"] * g["w"] / F.when(r == 0, F.lit(TINY)).otherwise(r.cast("double")) + 1.0))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    usable = (F.size(radiance) >= 88) & ~F.exists(F.slice(radiance, 18, 70), lambda r: r < 0)
    value = F.when(scan_of(scan_len) == 1, on(1)).otherwise(on(2))
    return F.coalesce(F.when(radiance.isNotNull() & usable, value), F.lit(0.0))


@dataclass(frozen=True)
class Band:
    """A broad band on the double grid: response of channels first..last, and the ends of the single grid."""

    first: int
    last: int
    single_first: int
    single_last: int
    response: np.ndarray
    table: np.ndarray

    def sum(self, scan: int) -> float:
        if scan == 2:
            return float(self.response.sum())
        return float(self.response[self.first % 2 :: 2].sum())


@cache
def bands() -> tuple[Band, ...]:
    """The five bands with their radiances at 120.00, 120.01, ... 350.00 kelvin."""
    grid = 1e8 / np.floor((28.0 + np.arange(286)) * GRID_STEP * 1e4)
    steps = int(round((HOTTEST - COLDEST) / TEMPERATURE_STEP)) + 1
    temperatures = np.concatenate([[COLDEST], COLDEST + np.cumsum(np.full(steps - 1, TEMPERATURE_STEP))])
    out = []
    for start, step, response in BANDS.values():
        points = start + step * np.arange(BAND_POINTS)
        weights = np.zeros(BAND_POINTS)
        weights[: len(response)] = response
        inside = np.flatnonzero((grid >= points[0]) & (grid <= points[-1]))
        values = np.interp(grid[inside], points, weights)
        inside, values = inside[np.argmax(values != 0) :], values[np.argmax(values != 0) :]
        first, last = int(inside[0]), int(inside[-1])
        w = 1e4 / grid[inside]
        radiance = (C1 * w**3 / (np.exp(C2 * w / temperatures[:, None]) - 1.0)) @ values / values.sum()
        out.append(Band(first, last, first + first % 2, last - last % 2, values, radiance.astype(np.float32).astype(np.float64)))
    return tuple(out)


def band_temperatures(number: int, scan: int, radiances: np.ndarray) -> np.ndarray:
    """For each row of radiances the temperature whose band radiance is nearest to the weighted mean of its channels; 0 where it can't be had."""
    band = bands()[number - 1]
    step = 2 if scan == 1 else 1
    first, last = (band.single_first, band.single_last) if scan == 1 else (band.first, band.last)
    if last // step >= radiances.shape[1]:
        return np.zeros(len(radiances))
    r = radiances[:, first // step : last // step + 1].astype(np.float64)
    weights = band.response[first - band.first :: step][: r.shape[1]]
    mean = np.where(r == 0, TINY, r) @ weights / band.sum(scan)
    at = np.searchsorted(band.table, mean, "left")
    inside = np.minimum(at, len(band.table) - 1)
    exact = band.table[inside] == mean
    usable = ~(r < 0).any(axis=1) & (at < len(band.table)) & ((at > 0) | exact)
    below = np.maximum(inside - 1, 0)
    nearer = np.abs(mean - band.table[inside]) < np.abs(mean - band.table[below])
    return np.where(usable, COLDEST + np.where(exact | nearer, inside, below) * TEMPERATURE_STEP, 0.0)


def irtm(scan_len: Column, radiance: Column, _temperature: Column | None = None) -> Column:
    """array<double>: the temperatures of the five bands. A lookup in a table of 23,001 rows, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for scans, rows in parts:
            out = np.zeros((len(rows), len(BANDS)))
            sizes = np.array([0 if r is None else len(r) for r in rows])
            for scan, size in set(zip(scans.tolist(), sizes.tolist(), strict=True)):
                own = np.flatnonzero((scans.to_numpy() == scan) & (sizes == size))
                stacked = np.stack([np.asarray(rows.iloc[k], dtype=np.float64) for k in own]) if size else np.zeros((len(own), 0))
                for k in range(len(BANDS)):
                    out[own, k] = band_temperatures(k + 1, int(scan), stacked)
            yield pd.Series(list(out))

    return look_up(scan_of(scan_len), radiance)


@dataclass(frozen=True)
class Virtual:
    """A computed column: the fields it needs, in the builder's order, and its size (1: a single value)."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., Column]
    channels: int
    open_name: str | None = None


VIRTUAL: dict[str, Virtual] = {}


def register_virtual(virtual: Virtual) -> None:
    """Make a computed column known by its name; needs of the form ``field[]`` are whole arrays, ``field`` physical values."""
    VIRTUAL[virtual.name.lower()] = virtual


_NEEDS = ("obs.scan_len", "rad.cal_rad[]", "rad.target_temp")
register_virtual(Virtual("emissivity", _NEEDS, emissivity, 296, "emissivity[...]"))
register_virtual(Virtual("t20", _NEEDS[:2], t20, 1))
register_virtual(Virtual("irtm", _NEEDS[:2], irtm, 5))

"""Metrics of short series held as arrays (radial profiles, line profiles, image rows).

Everything is a column expression on one array: no shuffle, no Python. The index of a value is its
radius in pixels; a NULL value is an empty bin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from axonframe.functions.scalar import ColumnLike, col, near_zero


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a lambda variable is not expanded again)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _indices(first, last) -> Column:
    """first..last as an array, empty when last < first."""
    first, last = (F.lit(v) if isinstance(v, int) else v for v in (first, last))
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _first_index(first, last, test) -> Column:
    return F.get(F.filter(_indices(first, last), test), F.lit(0))


def first_difference(series: ColumnLike) -> Column:
    return let(
        col(series), lambda a: F.transform(_indices(0, F.size(a) - 2), lambda i: F.get(a, i + 1) - F.get(a, i))
    )


def moving_average(series: ColumnLike, width: int = 5) -> Column:
    """Centred mean of ``width`` values; outside the series counts as 0, the divisor is always ``width``."""
    half = width // 2

    def smooth(a):
        reach = range(-half, half + 1)
        return F.transform(a, lambda _, i: sum((F.coalesce(F.get(a, i + k), F.lit(0.0)) for k in reach), F.lit(0.0)) / width)

    return let(col(series), smooth)


def savgol_weights(window: int = 11, order: int = 3) -> np.ndarray:
    """Row i: weights that give the fitted polynomial's value at position i of a window."""
    v = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def savgol(series: ColumnLike, window: int = 11, order: int = 3) -> Column:
    """Savitzky-Golay smoothing. Near an end the value comes from the polynomial of the end window.

    NULL for a series shorter than the window.
    """
    half = window // 2
    weights = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in savgol_weights(window, order)])

    def smooth(a):
        def at(_, i):
            start = F.greatest(F.lit(0), F.least(i - half, F.size(a) - window))
            terms = F.zip_with(F.get(weights, i - start), F.slice(a, start + 1, window), lambda w, v: w * v)
            return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)

        return F.when(F.size(a) >= window, F.transform(a, at))

    return let(col(series), smooth)


def half_width(series: ColumnLike, level: float = 0.5) -> Column:
    """Radius of the first fall to ``level``, linearly interpolated."""

    def crossing(a):
        def interpolate(i):
            before, after = F.get(a, i - 1), F.get(a, i)
            return (i - 1) + F.coalesce(F.try_divide(level - before, after - before), F.lit(1.0))

        return let(_first_index(1, F.size(a) - 1, lambda k: F.get(a, k) <= level), interpolate)

    return let(col(series), crossing)


def first_trough_value(series: ColumnLike) -> Column:
    """Value of the first local minimum below 0."""

    def trough(a):
        low = lambda k: (F.get(a, k) < 0) & (F.get(a, k) < F.get(a, k - 1)) & (F.get(a, k) < F.get(a, k + 1))
        return F.get(a, _first_index(1, F.size(a) - 2, low))

    return let(col(series), trough)


def first_peak_index(series: ColumnLike) -> Column:
    """Radius of the first local maximum above 0, the central peak left out."""

    def peak(a):
        high = lambda k: (F.get(a, k) > 0) & (F.get(a, k) > F.get(a, k - 1)) & (F.get(a, k) > F.get(a, k + 1))
        return _first_index(1, F.size(a) - 2, high)

    return let(col(series), peak)


def negative_run_trough(series: ColumnLike) -> Column:
    """struct(index, value) of the smallest value in the first run of negative values."""

    def locate(a):
        negative = lambda k: F.coalesce(F.get(a, k) < 0, F.lit(False))

        def smallest(start):
            stop = F.coalesce(_first_index(start + 1, F.size(a) - 1, lambda k: ~negative(k)), F.size(a))
            run = F.when(start.isNotNull(), F.slice(a, start + 1, stop - start))
            return let(
                run,
                lambda run: F.struct(
                    (start + F.array_position(run, F.array_min(run)).cast("int") - 1).alias("index"),
                    F.array_min(run).alias("value"),
                ),
            )

        return let(_first_index(0, F.size(a) - 1, negative), smallest)

    return let(col(series), locate)


def second_peak_after(smoothed: ColumnLike, trough: Column, variant: str = "line") -> Column:
    """Index of the second positive peak: where the smoothed derivative is near 0 after the trough.

    ``variant='line'``: index of that derivative value; without one, of the first value <= 0.
    ``variant='radial'``: one further; without one, the first change of sign.
    """
    if variant not in ("line", "radial"):
        raise ValueError(f"variant must be 'line' or 'radial', not {variant!r}")

    def locate(s):
        d, last = s["d"], F.size(s["d"]) - 1
        start = s["t"] + 1
        flat = _first_index(start, last, lambda k: near_zero(F.get(d, k)))
        if variant == "line":
            return F.coalesce(flat, _first_index(start, last, lambda k: F.get(d, k) <= 0))
        turn = _first_index(start, last - 1, lambda k: F.signum(F.get(d, k)) != F.signum(F.get(d, k + 1)))
        return F.coalesce(flat, turn) + 1

    return let(F.struct(col(smoothed).alias("d"), trough.alias("t")), locate)


def argmax_index(series: ColumnLike) -> Column:
    """0-based index of the first largest value."""
    return let(col(series), lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1)


def profile_metrics(profile: ColumnLike, um_per_px: ColumnLike, method: str = "local_max") -> Column:
    """struct of half width, first trough and second peak, in pixels and microns.

    ``local_max``: first local extrema of a radial profile. ``derivative``: lowest point of the first
    negative run, then the smoothed derivative. ``line``: the same rules for a line profile.
    """
    if method not in ("local_max", "derivative", "line"):
        raise ValueError(f"method must be 'local_max', 'derivative' or 'line', not {method!r}")

    def measure(p):
        if method == "local_max":
            return F.struct(half_width(p).alias("h"), first_trough_value(p).alias("t"), first_peak_index(p).alias("s"))
        variant = "line" if method == "line" else "radial"
        smooth = savgol(first_difference(p))
        return let(
            negative_run_trough(p),
            lambda t: F.struct(
                half_width(p).alias("h"), t["value"].alias("t"), second_peak_after(smooth, t["index"], variant).alias("s")
            ),
        )

    def scaled(m):
        second = m["s"].cast("double")
        return F.struct(
            m["h"].alias("r_half_pixels"),
            (m["h"] * col(um_per_px)).alias("r_half_microns"),
            m["t"].alias("first_negative_amp"),
            second.alias("second_positive_distance_pixels"),
            (second * col(um_per_px)).alias("second_positive_distance_microns"),
        )

    return let(let(col(profile), measure), scaled)

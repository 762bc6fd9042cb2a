"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, places: int = 0) -> Column:
    """Round halves towards positive infinity."""
    scale = F.lit(float(10**places))
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sample_sd(c: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def histogram_bin(c: Column, low: float, high: float, bins: int) -> Column:
    """Bin of equal width, 0 to bins-1; the top edge belongs to the last bin."""
    return F.least(F.lit(bins - 1), F.floor((c - low) / F.lit((high - low) / bins))).cast("int")

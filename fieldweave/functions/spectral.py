"""Index and mask formulas on band columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _c
from .values import clamp

# Classes that count as good, quality bits, cloud score weights.
GOOD_CLASSES = [4, 5, 6, 7, 11]
CLOUD_BITS = [10, 11]
SCALE = 10_000.0
EPS = 1e-6


def ndvi(nir="b8", red="b4", eps: float = EPS) -> Column:
    n, r = _c(nir), _c(red)
    return F.try_divide((n - r).cast("double"), n + r + eps)


def ndwi_swir(nir="b8", swir="b11") -> Column:
    n, s = _c(nir), _c(swir)
    return (n - s) / (n + s + EPS)


def ndwi_green(green="b3", nir="b8") -> Column:
    g, n = _c(green), _c(nir)
    return (g - n) / (g + n + EPS)


def evi_scaled(nir="b8", red="b4", blue="b2", eps: float = EPS) -> Column:
    """On reflectance 0..1."""
    n, r, b = (_c(x) / SCALE for x in (nir, red, blue))
    return 2.5 * (n - r) / (n + 6.0 * r - 7.5 * b + 1.0 + eps)


def evi_clipped(nir="b8", red="b4", blue="b2") -> Column:
    """On reflectance, tiny divisors replaced, clipped to -1..1."""
    n, r, b = (_c(x) / SCALE for x in (nir, red, blue))
    d = n + 6.0 * r - 7.5 * b + 1.0
    return clamp(2.5 * (n - r) / F.when(F.abs(d) < EPS, EPS).otherwise(d), -1.0, 1.0)


def evi_raw(nir="b8", red="b4", blue="b2") -> Column:
    """On stored numbers, as the fairness study has it."""
    n, r, b = (_c(x) for x in (nir, red, blue))
    return 2.5 * (n - r) / (n + 6.0 * r - 7.5 * b + 1.0 + EPS)


def ndvi_rounded(nir="b8", red="b4") -> Column:
    """Clipped NDVI cut to four decimals toward zero."""
    x = clamp(F.try_divide((_c(nir) - _c(red)).cast("double"), _c(nir) + _c(red)), -1.0, 1.0)
    return (x * SCALE).cast("int") / SCALE


def good_by_class(scl="scl") -> Column:
    return F.coalesce(_c(scl).isin(*GOOD_CLASSES), F.lit(False))


def bad_by_bits(qa="qa60") -> Column:
    bad = F.lit(False)
    for b in CLOUD_BITS:
        bad = bad | (F.getbit(_c(qa), F.lit(b)) != 0)
    return bad


def cloud_score(blue="b2", green="b3", red="b4", nir="b8", swir="b11") -> Column:
    """Brightness .4, short-wave .2, blue ratio .2, whiteness .2; each 0..1."""
    b, g, r, s = (_c(x) / SCALE for x in (blue, green, red, swir))
    mean = (b + g + r) / 3.0
    spread = F.sqrt(((b - mean) * (b - mean) + (g - mean) * (g - mean) + (r - mean) * (r - mean)) / 3.0)
    bright = clamp((mean - 0.30) / 0.15, 0.0, 1.0)
    short = clamp((s - 0.12) / 0.10, 0.0, 1.0)
    ratio = clamp((b / (s + EPS) - 1.2) / 0.5, 0.0, 1.0)
    white = 1.0 - clamp(spread / 0.06, 0.0, 1.0)
    return bright * 0.4 + short * 0.2 + ratio * 0.2 + white * 0.2


def is_cloud(threshold: float = 0.55, green_limit: float = 0.55, **bands) -> Column:
    """Score above the threshold where the pixel is not clearly vegetation."""
    nir, red = _c(bands.get("nir", "b8")) / SCALE, _c(bands.get("red", "b4")) / SCALE
    return (cloud_score(**bands) > threshold) & ((nir - red) / (nir + red + EPS) <= green_limit)

"""Fixed-length series held as arrays, NULL for missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _c, hash_normal, hash_uniform

GREEN = 0.4


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is run again for every element; as the
    element of a one-element array it is computed once and bound to a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbours(v: Column, order: Column) -> Column:
    """For each visited index the last non-missing index seen, in visiting order: one pass."""
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(None).cast("int").alias("last"))

    def step(acc, i):
        last = F.when(F.get(v, i).isNotNull(), i).otherwise(acc["last"])
        return F.struct(F.concat(acc["seen"], F.array(last)).alias("seen"), last.alias("last"))

    return F.aggregate(order, start, step, lambda acc: acc["seen"])


def interpolate(v, fill=0.0) -> Column:
    """Linear fill along time; ends held constant; an all-missing series gets the fill value.

    Two linear passes find the neighbours on the left and on the right.
    """
    def filled(v):
        ahead = F.sequence(F.lit(0), F.size(v) - 1)
        prev = _neighbours(v, ahead)
        nxt = F.reverse(_neighbours(v, F.reverse(ahead)))

        def at(pair, i):
            p, q = pair["p"], pair["q"]
            a, b = F.get(v, p), F.get(v, q)
            inner = a + (b - a) * (i - p) / (q - p)
            return F.when(p.isNull() & q.isNull(), F.lit(fill)).when(p.isNull(), b).when(q.isNull() | (p == q), a).otherwise(inner)

        return F.transform(F.arrays_zip(prev.alias("p"), nxt.alias("q")), at)

    return bind(_c(v), filled)


def smooth(v, window: int = 3) -> Column:
    """Moving average of a full series; the edge value is repeated beyond the ends."""
    shifts = [k - window // 2 for k in range(window)]

    def averaged(v):
        top = F.size(v) - 1

        def mean(_, i):
            total = None
            for k in shifts:
                x = F.get(v, F.least(F.greatest(i + k, F.lit(0)), top))
                total = x if total is None else total + x
            return total / window

        return F.transform(v, mean)

    return bind(_c(v), averaged)


def valid_share(v) -> Column:
    v = _c(v)
    return F.size(F.filter(v, lambda x: x.isNotNull())) / F.size(v)


def nan_mean(v: Column) -> Column:
    s = F.aggregate(v, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct(
        (a["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (a["n"] + F.when(x.isNotNull(), 1).otherwise(0)).alias("n")))
    return F.try_divide(s["s"], s["n"])


def summary(v, prefix: str = "") -> Column:
    """Struct of eleven numbers of a full series: mean, max, min, population std, amplitude, first and last three,
    their difference, slope, area, green steps."""
    def whole(v):
        sums = F.aggregate(
            F.transform(v, lambda x, i: F.struct(x.alias("x"), i.cast("double").alias("i"))),
            F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("si")),
            lambda a, p: F.struct((a["s"] + p["x"]).alias("s"), (a["si"] + p["x"] * p["i"]).alias("si")),
        )
        parts = F.struct(sums.alias("a"), F.array_max(v).alias("hi"), F.array_min(v).alias("lo"),
                         nan_mean(F.slice(v, 1, 3)).alias("early"), nan_mean(F.slice(v, -3, 3)).alias("late"))

        def pack(k):
            n = F.size(v).cast("double")
            mean = k["a"]["s"] / n
            slope = (n * k["a"]["si"] - n * (n - 1) / 2 * k["a"]["s"]) / (n * n * (n * n - 1) / 12)
            spread = bind(mean, lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n))
            out = {
                "mean": mean, "max": k["hi"], "min": k["lo"], "std": spread, "amp": k["hi"] - k["lo"],
                "early": k["early"], "late": k["late"], "late_minus_early": k["late"] - k["early"], "slope": slope, "auc": mean * n,
                "n_green": F.size(F.filter(v, lambda x: x > GREEN)),
            }
            return F.struct(*[c.alias(f"{prefix}{name}") for name, c in out.items()])

        return bind(parts, pack)

    return bind(_c(v), whole)


def temporal_summary(v, prefix: str = "") -> Column:
    """Struct of five numbers that skip missing steps: mean, population std, max, min, amplitude."""
    def five(s):
        ok = s["mean"].isNotNull()
        return F.struct(*[F.when(ok, s[k]).alias(f"{prefix}{k}") for k in ("mean", "std", "max", "min", "amp")])

    kept = F.filter(_c(v), lambda x: x.isNotNull())
    return bind(bind(kept, lambda k: F.when(F.size(k) > 0, summary(k))), five)


def degrade(v, ids: Sequence, drop: Column | float, noise: Column | float, seed: int, fill: Column | float = 0.0) -> Column:
    """Drop a share of steps, refill, add noise. Repeats exactly: every draw is a hash of (seed, id, step)."""
    v = _c(v)
    drop_c = F.lit(drop) if isinstance(drop, (int, float)) else drop
    noise_c = F.lit(noise) if isinstance(noise, (int, float)) else noise
    kept = F.transform(v, lambda x, i: F.when(hash_uniform(seed, *ids, i) >= drop_c, x))
    filled = interpolate(kept, fill)
    return F.transform(filled, lambda x, i: x + F.when(noise_c > 0, noise_c * hash_normal(seed + 1, *ids, i)).otherwise(0.0))


def pick_steps(v, steps: Sequence[int | Sequence[int]]) -> Column:
    """Single steps or means of groups of steps."""
    v = _c(v)
    parts = []
    for s in steps:
        if isinstance(s, int):
            parts.append(F.get(v, F.lit(s)))
        else:
            total = None
            for k in s:
                x = F.get(v, F.lit(k))
                total = x if total is None else total + x
            parts.append(total / len(s))
    return F.array(*parts)

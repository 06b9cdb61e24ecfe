"""Easing curves and time-parameterised signals as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Curve = Callable[[Column], Column]


def _c(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast("double")


def _cube(t: Column) -> Column:
    return t * t * t


#: Curves without parameters, each from 0 at 0 to 1 at 1 except where its shape says otherwise.
CURVES: dict[str, Curve] = {
    "linear": lambda t: t,
    "quad": lambda t: t * t,
    "inverse_quad": lambda t: 2 * t - t * t,
    "cubic": _cube,
    "inverse_cubic": lambda t: 1 - _cube(1 - t),
    "quart": lambda t: _cube(t) * t,
    "quint": lambda t: _cube(t) * t * t,
    "sine": lambda t: 1 - F.cos(t * (math.pi / 2)),
    "circle": lambda t: 1 - F.sqrt(1 - t * t),
    "inverse_circle": lambda t: F.sqrt(2 * t - t * t),
    "swing": lambda t: 0.5 - F.cos(t * math.pi) * 0.5,
    "smooth_bounce": lambda t: 1 - F.abs(F.cos(t * (10 * math.pi)) * F.exp(t * -6)),
    "linear_bounce": lambda t: 1 - F.abs(2 * t - 1),
    "square": lambda t: F.sqrt(t),
    "curves": lambda t: t * t * (3 - 2 * t),
    "quads": lambda t: F.when(t < 0.5, 2 * t * t).otherwise(4 * t - 1 - 2 * t * t),
    "inverse_quads": lambda t: F.when(t < 0.5, 2 * (t - t * t)).otherwise(1 - 2 * (t - t * t)),
    "cubics": lambda t: F.when(t < 0.5, 4 * _cube(t)).otherwise(1 + 4 * _cube(t - 1)),
}


def exponent(base: float = 2.0, rate: float = 10.0) -> Curve:
    if base <= 0:
        raise ValueError("the base must be positive")
    return lambda t: F.pow(F.lit(float(base)), (t - 1) * rate)


def elastic(amplitude: float = 1.0, period: float = 0.3, damping: float = 0.075) -> Curve:
    if period == 0:
        raise ValueError("the period can't be 0")
    return lambda t: F.pow(F.lit(2.0), t * -10) * amplitude * F.sin((t - damping) * (2 * math.pi / period)) + 1


def back(scale: float = 2.70158, offset: float = 1.70158) -> Curve:
    if not 2 <= scale <= 4 or not 1.70158 <= offset <= 2.59491:
        raise ValueError("the scale must be from 2 to 4, the offset from 1.70158 to 2.59491")
    return lambda t: scale * _cube(t) - offset * t * t


def constant(value: float) -> Curve:
    return lambda t: F.lit(float(value))


def logarithm(base: float = 2.0) -> Curve:
    if base <= 0 or base == 1:
        raise ValueError("the base must be positive and not 1")
    return lambda t: F.ln(1 + t * (base - 1)) / math.log(base)


def custom(points: list[tuple[float, float]], precision: int) -> Curve:
    """The point nearest in x of a Bezier curve with these controls, cut in ``precision`` parts; x must ascend."""
    if precision < 1:
        raise ValueError("the precision must be positive")
    n = len(points) - 1
    at = [[sum(math.comb(n, i) * (1 - u) ** (n - i) * u**i * p[axis] for i, p in enumerate(points)) for axis in (0, 1)] for u in (k / precision for k in range(precision + 1))]
    if any(a[0] >= b[0] for a, b in zip(at[:-1], at[1:], strict=True)):
        raise ValueError("the curve must ascend in x")
    table = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in at))
    return lambda t: F.array_min(F.transform(table, lambda p: F.struct(F.abs(p["x"] - t).alias("d"), (-p["x"]).alias("x"), p["y"].alias("y"))))["y"]


def ease(t, curve: str | Curve, option: str = "in", strong: bool = False, inflection: str = "normal") -> Column:
    """A curve at t from 0 to 1, which raises outside. ``option``: "in", "out", "in_out"; ``strong`` applies it twice; ``inflection`` "fast" or
    "slow" then applies a square curve or its inverse with the same option."""
    f = CURVES[curve] if isinstance(curve, str) else curve
    if option not in ("in", "out", "in_out") or inflection not in ("normal", "fast", "slow"):
        raise ValueError("unknown option or inflection")

    def repeated(g: Curve) -> Curve:
        return (lambda x: g(g(x))) if strong else g

    def turned(g: Curve) -> Curve:
        out = repeated(lambda x: 1 - g(1 - x))
        if option == "in":
            return repeated(g)
        if option == "out":
            return out
        return lambda x: F.when(x <= 0.5, repeated(g)(x * 2) / 2).otherwise((out(x * 2 - 1) + 1) / 2)

    t = _c(t)
    value = turned(f)(t)
    if inflection != "normal":
        value = turned(CURVES["quad" if inflection == "fast" else "inverse_quad"])(value)
    return F.when(t.between(0, 1), value).when(t.isNotNull(), F.raise_error(F.lit("a time outside 0 to 1")).cast("double"))


# Motion: what a signal's time does, and closed forms of (position, velocity, acceleration).


def map_time(t, duration, behaviour: str) -> Column:
    """"free", "clamp", "loop" or "oscillate" within a duration; a duration that isn't positive leaves the time as it is."""
    t, d = _c(t), _c(duration)
    swing = F.pmod(t, 2 * d)
    forms = {"free": t, "clamp": F.greatest(F.lit(0.0), F.least(t, d)), "loop": F.pmod(t, d), "oscillate": F.when(swing <= d, swing).otherwise(2 * d - swing)}
    return F.when(d > 0, forms[behaviour]).otherwise(t)


def progress(t, duration, behaviour: str) -> Column:
    d = _c(duration)
    return F.when(d > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), map_time(t, d, behaviour) / d))).otherwise(0.0)


def finished(t, duration, behaviour: str) -> Column:
    d = _c(duration)
    return F.lit(False) if behaviour in ("loop", "oscillate") else (d > 0) & (_c(t) >= d)


def state(position, velocity=0.0, acceleration=0.0) -> Column:
    return F.struct(_c(position).alias("position"), _c(velocity).alias("velocity"), _c(acceleration).alias("acceleration"))


def still(value) -> Column:
    return state(value)


def uniform(t, start, velocity) -> Column:
    return state(_c(start) + _c(velocity) * _c(t), velocity)


def accelerated(t, start, velocity, acceleration) -> Column:
    t, v, a = _c(t), _c(velocity), _c(acceleration)
    return state(_c(start) + v * t + a * t * t / 2, v + a * t, a)


def time_scaled(s: Column, k: float) -> Column:
    """The state of a signal run k times as fast, given its state at k t."""
    return state(s["position"], s["velocity"] * k, s["acceleration"] * k * k)


def offset(s: Column, by) -> Column:
    return state(s["position"] + _c(by), s["velocity"], s["acceleration"])


def scaled(s: Column, by) -> Column:
    by = _c(by)
    return state(s["position"] * by, s["velocity"] * by, s["acceleration"] * by)


def added(a: Column, b: Column) -> Column:
    return state(a["position"] + b["position"], a["velocity"] + b["velocity"], a["acceleration"] + b["acceleration"])


def sample_times(rows: DataFrame, start, end, n: int, name: str = "t") -> DataFrame:
    """n + 1 equally spaced times from start to end for each row; one for n = 0."""
    start, end = _c(start), _c(end)
    step = (end - start) / n if n else F.lit(0.0)
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn(name, start + step * F.col("_i")).drop("_i")


def channels(states: dict[int, DataFrame]) -> DataFrame:
    """Several one-channel tables as one with a ``channel`` column."""
    out = None
    for i, df in sorted(states.items()):
        part = df.withColumn("channel", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a signal has one channel at least")
    return out


def is_finite(s: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return ok(s["position"]) & ok(s["velocity"]) & ok(s["acceleration"])


def jumps(rows: DataFrame, by: list[str], order: str, value: str, most: float) -> DataFrame:
    """Rows whose value is farther than ``most`` from the one before."""
    from pyspark.sql.window import Window

    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_jump", F.abs(F.col(value) - before)).where(F.col("_jump") > most).drop("_jump")

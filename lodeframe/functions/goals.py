"""Goal scoring as columns, and a kernel that solves a problem in each group of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a priority weighs in a weighted sum. Fixed values.
WEIGHTS = {"low": 1.0, "medium": 10.0, "high": 100.0, "critical": 1000.0, "compulsory": 1_000_000.0}
ORDER = list(WEIGHTS)
KINDS = ("equal", "range", "upper", "lower", "minimize", "maximize")


@dataclass
class Goal:
    """What a metric should be. Infinite bounds don't bind; a scale divides the metric's excess."""

    metric: str
    kind: str
    priority: str = "medium"
    target: float = 0.0
    low: float = float("-inf")
    high: float = float("inf")
    tolerance: float = 1e-8
    weight: float = 1.0
    scale: float = 1.0

    def __post_init__(self):
        if self.kind not in KINDS or self.priority not in WEIGHTS:
            raise ValueError("unknown kind or priority of a goal")
        if self.scale <= 0:
            raise ValueError("a scale is positive")

    def penalty(self, v, squared: bool, largest, absolute):
        """For columns or numbers alike, given their maximum and absolute functions."""
        zero = F.lit(0.0) if isinstance(v, Column) else 0.0
        if self.kind == "equal":
            parts = [largest(zero, absolute(v - self.target) - self.tolerance)]
        elif self.kind in ("minimize", "maximize"):
            parts = [v if self.kind == "minimize" else -v]
        else:
            parts = [largest(zero, self.low - v)] * (self.kind in ("range", "lower") and self.low > float("-inf")) + [largest(zero, v - self.high)] * (self.kind in ("range", "upper") and self.high < float("inf"))
        total = zero
        for p in parts:
            e = p / self.scale
            total = total + (e * e if squared else absolute(e))
        return total * (WEIGHTS[self.priority] * (self.weight if self.kind in ("minimize", "maximize") else 1.0))


def contribution(goal: Goal, squared: bool = True) -> Column:
    """A goal's penalty from the column of its metric."""
    return goal.penalty(F.col(goal.metric).cast("double"), squared, F.greatest, F.abs)


def score(goals: list[Goal], squared: bool = True) -> Column:
    """The weighted sum of all goals' penalties."""
    total = F.lit(0.0)
    for goal in goals:
        total = total + contribution(goal, squared)
    return total


@dataclass
class Model:
    """Minimise ``objective(x)`` within bounds, under constraints ``(f, kind, rhs)`` with kinds "<=", "=", ">="."""

    objective: Callable[[np.ndarray], float]
    start: list[float]
    low: list[float] | None = None
    high: list[float] | None = None
    constraints: list[tuple[Callable[[np.ndarray], float], str, float]] = field(default_factory=list)

    def clamp(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, -np.inf if self.low is None else self.low, np.inf if self.high is None else self.high)

    def residuals(self, x: np.ndarray) -> list[tuple[float, str]]:
        """Signed: positive where an inequality is broken."""
        return [((f(x) - rhs) * (-1 if kind == ">=" else 1), kind) for f, kind, rhs in self.constraints]

    def violation(self, x: np.ndarray) -> float:
        return sum(max(0.0, abs(r) - 1e-8) if kind == "=" else max(0.0, r) for r, kind in self.residuals(x))


@dataclass
class Rule:
    """A constraint over columns: ``value`` held "<=", "=" or ">=" ``bound``."""

    name: str
    value: Column
    kind: str
    bound: float

    def __post_init__(self):
        if self.kind not in ("<=", "=", ">="):
            raise ValueError("unknown kind of a rule")

    def residual(self) -> Column:
        """Signed: positive where an inequality is broken."""
        apart = self.value.cast("double") - F.lit(float(self.bound))
        return -apart if self.kind == ">=" else apart

    def violation(self) -> Column:
        r = self.residual()
        return F.abs(r) if self.kind == "=" else F.greatest(F.lit(0.0), r)


def _terms(rules: list[Rule], added: Callable[[int, Rule], Column]) -> Column:
    rows = [F.struct(F.lit(r.name).alias("name"), r.value.cast("double").alias("value"), r.violation().alias("violation"), added(i, r).alias("contribution")) for i, r in enumerate(rules)]
    return F.array(*rows).cast("array<struct<name:string,value:double,violation:double,contribution:double>>")


def penalty_terms(rules: list[Rule], weight: float = 1.0, squared: bool = True) -> Column:
    """What each rule adds to a penalised objective, with its value and how far it is broken."""
    return _terms(rules, lambda i, r: F.lit(float(weight)) * (r.violation() * r.violation() if squared else r.violation()))


def lagrangian_terms(rules: list[Rule], multipliers: list, weight: float = 1.0) -> Column:
    """The same for an augmented Lagrangian objective; multipliers are numbers or columns, one a rule."""
    if len(multipliers) != len(rules):
        raise ValueError("one multiplier a rule")
    held = [m if isinstance(m, Column) else F.lit(float(m)) for m in multipliers]
    w = F.lit(float(weight))

    def added(i: int, rule: Rule) -> Column:
        r = rule.residual()
        if rule.kind == "=":
            return held[i] * r + w / 2 * r * r
        pushed = F.greatest(F.lit(0.0), held[i] + w * r)
        return (pushed * pushed - held[i] * held[i]) / (2 * w)

    return _terms(rules, added)


def next_multipliers(rules: list[Rule], multipliers: list, weight: float = 1.0) -> list[Column]:
    """The multipliers of the round after: an inequality's is never negative."""
    held = [m if isinstance(m, Column) else F.lit(float(m)) for m in multipliers]
    moved = [m + F.lit(float(weight)) * r.residual() for m, r in zip(held, rules, strict=True)]
    return [m if r.kind == "=" else F.greatest(F.lit(0.0), m) for m, r in zip(moved, rules, strict=True)]


def with_terms(objective: Column, terms: Column) -> Column:
    """An objective plus what its rules add."""
    return F.aggregate(terms, objective.cast("double"), lambda total, t: total + t["contribution"])


def gradient(f: Callable[[np.ndarray], float], x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Central differences with a step relative to each variable."""
    out = np.zeros(len(x))
    for i in range(len(x)):
        h = eps * max(1.0, abs(x[i]))
        step = np.zeros(len(x))
        step[i] = h
        out[i] = (f(x + step) - f(x - step)) / (2 * h)
    return out


def nelder_mead(f, x, clamp, steps: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    n = len(x)
    points = [clamp(np.array(x, float))] + [clamp(np.array(x, float) + np.eye(n)[i] * (0.1 * max(1.0, abs(x[i])))) for i in range(n)]
    simplex = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda v: v[:2])
    for k in range(steps):
        if abs(simplex[-1][0] - simplex[0][0]) <= tolerance and max(np.abs(p - simplex[0][2]).max() for _, _, p in simplex) <= 1e-9:
            break
        centre, (worst, _, w) = np.mean([p for _, _, p in simplex[:-1]], axis=0), simplex[-1]
        tries = clamp(centre + (centre - w))
        value = f(tries)
        if value < simplex[0][0]:
            far = clamp(centre + 2 * (centre - w))
            tries, value = min(((tries, value), (far, f(far))), key=lambda v: v[1])
        elif value >= simplex[-2][0]:
            near = clamp(centre + 0.5 * ((tries if value < worst else w) - centre))
            tries, value = near, f(near)
            if value >= min(worst, f(clamp(centre + (centre - w)))):
                best = simplex[0][2]
                simplex = sorted(((f(q), n + k + i, q) for i, q in enumerate(clamp(best + 0.5 * (p - best)) for _, _, p in simplex)), key=lambda v: v[:2])
                continue
        simplex[-1] = (value, n + k + 1, tries)
        simplex.sort(key=lambda v: v[:2])
    return simplex[0][2]


def lbfgs(f, x, clamp, steps: int = 300, memory: int = 8) -> np.ndarray:
    x = clamp(np.array(x, float))
    g, pairs = gradient(f, x), []
    for _ in range(steps):
        if np.linalg.norm(g) < 1e-9:
            break
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            q *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        if g @ q <= 0:
            q, pairs = g.copy(), []
        step, value = 1.0, f(x)
        while step > 1e-12:
            new = clamp(x - step * q)
            if f(new) <= value - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        while step >= 1.0 and step < 1e6 and f(clamp(x - 2 * step * q)) < min(f(new), value - 2e-4 * step * (g @ q)):
            step *= 2  # a longer step shows more of the curvature
            new = clamp(x - step * q)
        new_g = gradient(f, new)
        if (new - x) @ (new_g - g) > 1e-12:  # only curvature that is positive
            pairs = [*pairs, (new - x, new_g - g)][-memory:]
        x, g = new, new_g
    return x


def cma_es(f, x, clamp, steps: int = 400, seed: int = 1, sigma: float = 0.3) -> np.ndarray:
    """Covariance matrix adaptation, with a fixed seed: the best half of a generation moves the mean, two paths of its moves set the
    step's length and the shape of the next generation."""
    rng, mean = np.random.default_rng(seed), np.array(x, float)
    n = len(mean)
    step = sigma * max(1.0, float(np.abs(mean).max()))
    size = 4 + int(3 * np.log(n)) + 4
    weights = np.log(size / 2 + 0.5) - np.log(np.arange(1, size // 2 + 1))
    weights /= weights.sum()
    mass = 1 / (weights**2).sum()
    fade_shape, fade_step = (4 + mass / n) / (n + 4 + 2 * mass / n), (mass + 2) / (n + mass + 5)
    one = 2 / ((n + 1.3) ** 2 + mass)
    many = min(1 - one, 2 * (mass - 2 + 1 / mass) / ((n + 2) ** 2 + mass))
    damping = 1 + 2 * max(0.0, np.sqrt((mass - 1) / (n + 1)) - 1) + fade_step
    usual = np.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
    path_step, path_shape, shape = np.zeros(n), np.zeros(n), np.eye(n)
    best = (f(clamp(mean)), clamp(mean))
    for k in range(1, steps + 1):
        values, axes = np.linalg.eigh(shape)
        lengths = np.sqrt(np.maximum(values, 1e-20))
        if step * lengths.max() < 1e-11:
            break
        moves = (rng.normal(size=(size, n)) * lengths) @ axes.T
        tries = [clamp(mean + step * m) for m in moves]
        ranked = sorted((f(t), i) for i, t in enumerate(tries))
        best = min(best, (ranked[0][0], tries[ranked[0][1]]), key=lambda v: v[0])
        # What the bounds cut off counts as not moved.
        chosen = (np.array([tries[i] for _, i in ranked[: len(weights)]]) - mean) / step
        move = weights @ chosen
        mean = mean + step * move
        path_step = (1 - fade_step) * path_step + np.sqrt(fade_step * (2 - fade_step) * mass) * (axes / lengths) @ (axes.T @ move)
        far = np.linalg.norm(path_step) / np.sqrt(1 - (1 - fade_step) ** (2 * k))
        small = far < (1.4 + 2 / (n + 1)) * usual
        path_shape = (1 - fade_shape) * path_shape + small * np.sqrt(fade_shape * (2 - fade_shape) * mass) * move
        spread = (chosen * weights[:, None]).T @ chosen
        kept = 1 - one - many + (not small) * one * fade_shape * (2 - fade_shape)
        shape = kept * shape + one * np.outer(path_shape, path_shape) + many * spread
        step *= float(np.exp(min(1.0, fade_step / damping * (np.linalg.norm(path_step) / usual - 1))))
    return best[1]


ALGORITHMS = {"nelder_mead": nelder_mead, "lbfgs": lbfgs, "cma_es": cma_es}


def solve(model: Model, algorithm: str | Callable = "nelder_mead", method: str = "penalty") -> tuple[np.ndarray, float, float]:
    """``(x, objective, violation)``. Constraints by penalties of 1, 10 and 100, or by six rounds of an augmented Lagrangian."""
    run = ALGORITHMS[algorithm] if isinstance(algorithm, str) else algorithm
    x = model.clamp(np.array(model.start, float))
    if not model.constraints:
        x = run(model.objective, x, model.clamp)
    elif method == "penalty":
        for weight in (1.0, 10.0, 100.0, 1e4, 1e6):
            x = run(lambda v, w=weight: model.objective(v) + w * sum(r * r if kind == "=" or r > 0 else 0.0 for r, kind in model.residuals(v)), x, model.clamp)
    else:
        multipliers, weight = np.zeros(len(model.constraints)), 10.0
        for _ in range(6):

            def lagrangian(v, m=multipliers, w=weight):
                total = model.objective(v)
                for a, (r, kind) in zip(m, model.residuals(v), strict=True):
                    total += a * r + w / 2 * r * r if kind == "=" else (max(0.0, a + w * r) ** 2 - a * a) / (2 * w)
                return total

            x = run(lagrangian, x, model.clamp)
            multipliers = np.array([a + weight * r if kind == "=" else max(0.0, a + weight * r) for a, (r, kind) in zip(multipliers, model.residuals(x), strict=True)])
            weight *= 10
    return x, float(model.objective(x)), float(model.violation(x))


def compile_goals(goals: list[Goal], metrics: dict[str, Callable[[np.ndarray], float]], start: list[float], hard: str | None = None, **bounds) -> Model:
    """A weighted sum of all goals; with ``hard``, goals of that priority or higher become constraints, but for wishes."""
    firm = [g for g in goals if hard and ORDER.index(g.priority) >= ORDER.index(hard) and g.kind not in ("minimize", "maximize")]
    soft = [g for g in goals if g not in firm]
    rules = []
    for g in firm:
        f = metrics[g.metric]
        if g.kind == "equal":
            rules += [(f, "<=", g.target + g.tolerance), (f, ">=", g.target - g.tolerance)]
        if g.kind in ("range", "upper") and g.high < float("inf"):
            rules.append((f, "<=", g.high))
        if g.kind in ("range", "lower") and g.low > float("-inf"):
            rules.append((f, ">=", g.low))
    return Model(lambda x: float(sum(g.penalty(metrics[g.metric](x), True, max, abs) for g in soft)), start, constraints=rules, **bounds)


def solve_by_priority(goals: list[Goal], metrics: dict, start: list[float], **bounds) -> np.ndarray:
    """From compulsory goals to low ones: each level is solved from the last one's answer with the higher levels held as they are."""
    x = np.array(start, float)
    for i in reversed(range(len(ORDER))):
        own = [g for g in goals if g.priority == ORDER[i]]
        if not own:
            continue
        held = [(lambda v, g=g: float(g.penalty(metrics[g.metric](v), True, max, abs)), "<=", float(g.penalty(metrics[g.metric](x), True, max, abs)) + 1e-9) for g in goals if ORDER.index(g.priority) > i]
        model = Model(lambda v, own=own: float(sum(g.penalty(metrics[g.metric](v), True, max, abs) for g in own)), list(x), constraints=held, **bounds)
        x = solve(model)[0]
    return x


def solve_groups(rows: DataFrame, by: str, build: Callable[[pd.DataFrame], Model], algorithm: str = "nelder_mead", method: str = "penalty") -> DataFrame:
    """One problem a group, solved where the group is: ``(by, x, objective, violation)``. A group's rows must fit in a worker."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, value, broken = solve(build(group), algorithm, method)
        return pd.DataFrame({by: [group[by].iloc[0]], "x": [list(map(float, x))], "objective": [value], "violation": [broken]})

    kind = rows.schema[by].dataType.simpleString()
    return rows.groupBy(by).applyInPandas(run, f"{by} {kind}, x array<double>, objective double, violation double")

"""Combinatorics of arrays and multisets."""

from __future__ import annotations

from itertools import permutations as _permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FOR_POWER_SET = 20


def cartesian_product(*arrays) -> Column:
    """All ways to take one item of each array, as an array of arrays; empty if any is empty. The size is the product of the sizes."""
    arrays = [F.col(a) if isinstance(a, str) else a for a in arrays]
    out = F.transform(arrays[0], lambda x: F.array(x))
    for more in arrays[1:]:
        out = _paired(out, more)
    return out


def _paired(heads: Column, more: Column) -> Column:
    return F.flatten(F.transform(heads, lambda h: F.transform(more, lambda x: F.concat(h, F.array(x)))))


def power_set(items) -> Column:
    """All subsets in the order of their masks; raises for arrays of more than 20 items."""
    items = F.col(items) if isinstance(items, str) else items
    n = F.size(items)
    masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), n) - 1)
    sets = F.transform(masks, lambda m: F.filter(items, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    return F.when(n <= MOST_FOR_POWER_SET, sets).otherwise(F.raise_error(F.lit("too many items for a power set")).cast("array<array<string>>"))


def combinations(items, k: int) -> Column:
    """All choices of k positions in ascending order; equal items at different places count apart."""
    items = F.col(items) if isinstance(items, str) else items
    last = F.size(items) - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    heads = F.array(F.array().cast("array<int>"))
    for _ in range(k):
        heads = _longer(heads, places)
    return F.transform(heads, lambda h: F.transform(h, lambda i: F.get(items, i)))


def _longer(heads: Column, places: Column) -> Column:
    return F.flatten(F.transform(heads, lambda h: F.transform(F.filter(places, lambda p: (F.size(h) == 0) | (p > F.coalesce(F.try_element_at(h, F.lit(-1)), F.lit(-1)))), lambda p: F.concat(h, F.array(p)))))


def permutations(items) -> Column:
    """All different orders of the items, ascending by place of first use."""

    @F.pandas_udf("array<array<string>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else [list(p) for p in dict.fromkeys(_permutations([str(v) for v in x]))])

    return run(items)


def multiset_intersection(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as it comes in both tables."""
    return left.select(*columns).intersectAll(right.select(*columns))


def factorial(n) -> Column:
    """Exact to 33!; NULL beyond, where DECIMAL(38) ends."""
    n = F.col(n) if isinstance(n, str) else n
    one = F.lit(1).cast("decimal(38,0)")
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one, lambda a, x: (a * x.cast("decimal(2,0)")).cast("decimal(38,0)"))
    return F.when((n >= 0) & (n <= 33), product)


def choose(n, k) -> Column:
    """How many choices of k among n there are, exact while the result and its steps fit DECIMAL(38)."""
    n, k = (F.col(x) if isinstance(x, str) else x for x in (n, k))
    steps = F.sequence(F.lit(1), F.greatest(F.least(k, n - k), F.lit(1)))
    one = F.lit(1).cast("decimal(38,0)")
    value = F.aggregate(steps, one, lambda a, i: F.floor((a * (n - i + 1).cast("decimal(5,0)")).cast("decimal(38,0)") / i.cast("decimal(5,0)")).cast("decimal(38,0)"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("decimal(38,0)")).when((k == 0) | (k == n), one).otherwise(value)

"""Named reducers: an associative and commutative operation with its own identity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    identity: float
    combine: Callable[[Column, Column], Column]
    aggregate: Callable[[Column], Column]
    ufunc: np.ufunc
    # Compiled function over one array, where Spark has one.
    of_array: Callable[[Column], Column] | None = None

    def of_items(self, items: list[Column]) -> Column:
        """Reduce several columns of one row."""
        total = items[0]
        for item in items[1:]:
            total = self.combine(total, item)
        return total


MONOIDS = {
    "sum": Monoid(0.0, lambda a, x: a + x, F.sum, np.add),
    "prod": Monoid(1.0, lambda a, x: a * x, F.product, np.multiply),
    # Spark orders NaN above all numbers, so a minimum is NaN only if all values are; fmin agrees with that.
    "min": Monoid(float("inf"), lambda a, x: F.least(a, x), F.min, np.fmin, F.array_min),
    "max": Monoid(float("-inf"), lambda a, x: F.greatest(a, x), F.max, np.maximum, F.array_max),
}


def monoid(name: str) -> Monoid:
    if name not in MONOIDS:
        raise ValueError(f"unknown reducer {name!r}; expected one of {sorted(MONOIDS)} or a NumPy ufunc")
    return MONOIDS[name]

"""Column functions on ``array<double>`` vectors. All stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NORM_FLOOR = 1e-12
ENTROPY_FLOOR = 1e-8
SHARPEN_TEMPERATURE = 0.5


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Expressions named inside a lambda are evaluated anew for every element;
    a bound variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_normalize(v: Column) -> Column:
    def scale(w: Column) -> Column:
        norm = F.sqrt(F.greatest(inner_product(w, w), F.lit(NORM_FLOOR)))
        return let(norm, lambda n: F.transform(w, lambda x: x / n))

    return let(v, scale)


def scale_to_one(v: Column) -> Column:
    """Divide by the sum of the elements."""
    return let(v, lambda w: let(total(w), lambda t: F.transform(w, lambda x: x / t)))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Exponentials of ``v / temperature`` relative to the largest, summing to 1."""

    def exponentials(w: Column) -> Column:
        return let(
            F.array_max(w), lambda top: F.transform(w, lambda x: F.exp((x - top) / F.lit(temperature)))
        )

    return scale_to_one(let(v, exponentials))


def sharpen(v: Column, temperature: float = SHARPEN_TEMPERATURE) -> Column:
    return softmax(v, temperature)


def log_softmax(v: Column) -> Column:
    def run(w: Column) -> Column:
        def shift(top: Column) -> Column:
            log_sum = F.log(total(F.transform(w, lambda x: F.exp(x - top))))
            return let(top + log_sum, lambda base: F.transform(w, lambda x: x - base))

        return let(F.array_max(w), shift)

    return let(v, run)


def entropy(p: Column) -> Column:
    """Entropy of a probability array, each entry floored."""
    floored = F.transform(p, lambda x: F.greatest(x, F.lit(ENTROPY_FLOOR)))
    return -total(F.transform(floored, lambda x: x * F.log(x)))


def argmax(v: Column) -> Column:
    """Zero-based place of the largest element; the first one on ties."""
    return let(v, lambda w: (F.array_position(w, F.array_max(w)) - 1).cast("int"))


def one_hot(code: Column, size: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == code).cast("int")
    )


def sigmoid_cross_entropy(logit: Column, target: Column) -> Column:
    """Binary cross-entropy on a logit, in the overflow-safe form."""
    return (
        F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    )


def piecewise_linear(t: Column, schedule: dict[float, float]) -> Column:
    """Interpolate a step table; it starts at (0, 0) and stays flat after its end."""
    knots = sorted(schedule.items())
    if knots[0][0] != 0:
        knots = [(0.0, 0.0), *knots]
    out = F.when(t < knots[0][0], F.lit(float(knots[0][1])))
    for (t0, v0), (t1, v1) in zip(knots, knots[1:]):
        rise = (v1 - v0) / (t1 - t0)
        out = out.when(t < t1, F.lit(float(v0)) + F.lit(rise) * (t - F.lit(float(t0))))
    return out.otherwise(F.lit(float(knots[-1][1])))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def confidence_threshold(step: int, steps: int, classes: int) -> float:
    """Label-side threshold that rises from 1/C to 1 over the run."""
    share = step / steps
    return share * (1 - 1 / classes) + 1 / classes


def two_sided_normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))

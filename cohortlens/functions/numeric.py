"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def named(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    """a / b as a double; null when b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def half_even(column: Column, digits: int) -> Column:
    """Round half to even, as reports do."""
    return F.bround(column, digits)


def log_gamma(a: Column) -> Column:
    """ln of the gamma function for a > 0: Stirling's series, after ten steps of the recurrence where a is small."""
    steps = 10
    far = F.when(a < steps, a + float(steps)).otherwise(a)
    series = 1 / (12 * far) - 1 / (360 * far * far * far) + 1 / (1260 * F.pow(far, F.lit(5.0))) - 1 / (1680 * F.pow(far, F.lit(7.0))) + 1 / (1188 * F.pow(far, F.lit(9.0)))
    value = (far - 0.5) * F.ln(far) - far + 0.9189385332046727 + series  # ln(2 pi) / 2
    product = a
    for k in range(1, steps):
        product = product * (a + float(k))
    return F.when(a < steps, value - F.ln(product)).otherwise(value)


def upper_gamma(a: Column, x: Column) -> Column:
    """Share of the gamma integral above x, for a > 0 and x >= 0: the power series below a + 1, the continued fraction above.

    Both end after a number of terms that grows with the root of a, so results hold for any a.
    """
    a, x = a.cast("double"), x.cast("double")
    terms = F.sequence(F.lit(1), (60 + 12 * F.sqrt(a)).cast("int"))
    scale = F.exp(a * F.ln(x) - x - log_gamma(a))

    def add(s, n):
        term = s["term"] * x / (a + n)
        return F.struct((s["total"] + term).alias("total"), term.alias("term"))

    one = F.lit(1.0)
    below = F.aggregate(terms, F.struct((one / a).alias("total"), (one / a).alias("term")), add, lambda s: s["total"])

    def step(s, n):
        up = n * (a - n)
        b = s["b"] + 2.0
        d = 1.0 / (up * s["d"] + b)
        c = b + up / s["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    b = x + 1.0 - a
    first = F.struct(b.alias("b"), F.lit(1e300).alias("c"), (one / b).alias("d"), (one / b).alias("h"))
    above = F.aggregate(terms, first, step, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(1.0 - scale * below, F.lit(0.0))).otherwise(scale * above)

"""Seeded order and uniform numbers from a key: equal on every run and for every partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_STEPS = float(1 << 52)


def order_hash(key: Column, seed: int) -> Column:
    """32 hex digits; sorting by them shuffles the rows in a way that anyone can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def uniform(key: Column, name: str, seed: int) -> Column:
    """A double in [0, 1) that depends on (key, name, seed) only."""
    return F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(_STEPS)


def normal(key: Column, name: str, seed: int) -> Column:
    """A standard normal number from two uniform ones (Box-Muller)."""
    u = F.greatest(uniform(key, name + "/radius", seed), F.lit(1.0 / _STEPS))
    angle = uniform(key, name + "/angle", seed) * F.lit(2 * math.pi)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(angle)

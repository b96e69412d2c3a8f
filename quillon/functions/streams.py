"""Random streams by counter: a draw is a function of a row's key, a seed and the draw's number, so the same rows come out
whatever the partitions, the order of work or the engine (the hash is MD5)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, draw: int | Column) -> Column:
    """In (0, 1): (the first 13 hexadecimal digits of md5(key:seed:draw) + 1/2) / 2**52."""
    number = draw.cast("string") if isinstance(draw, Column) else F.lit(str(draw))
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), number)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(key: Column, seed: int, draw: int | Column) -> Column:
    """Standard normal, from the uniform draws 2 * draw and 2 * draw + 1 of the same key and seed (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(key, seed, draw * 2))) * F.cos(2 * math.pi * uniform(key, seed, draw * 2 + 1))


def normals(key: Column, seed: int, count: int) -> Column:
    """An array of the standard normal draws 0, 1, ..."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: normal(key, seed, k))

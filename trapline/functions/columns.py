"""Reusable column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    """Deterministic decimal rounding written the same way in the DuckDB
    oracle: floor(x * 10^d + 0.5) / 10^d (IEEE ops only, so both engines
    produce the identical double)."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


ASCII_WS = " \t\n\r\x0b\x0c"


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace like ``str.strip()`` (Spark's
    ``trim`` only removes spaces); ``btrim`` with the ASCII whitespace set
    avoids a regex per row."""
    return F.btrim(c, F.lit(ASCII_WS))


def literal_alternation(needles: Iterable[str]) -> str:
    """Java regex matching any of the literal needles (each \\Q..\\E quoted)."""
    return "(?:" + "|".join(r"\Q" + n + r"\E" for n in needles) + ")"


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    """True when any needle is a substring of ``c``.  One precompiled regex
    instead of an OR chain keeps generated code small."""
    needles = list(needles)
    if not needles:
        return F.lit(False)
    if len(needles) <= 8:
        # short lists: byte-level contains, no regex / string conversion
        return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])
    return c.rlike(literal_alternation(needles))


def count_contained(c: Column, needles: Iterable[str]) -> Column:
    """Number of needles that occur as substrings of ``c``."""
    return reduce(lambda a, b: a + b,
                  [F.when(c.contains(n), 1).otherwise(0) for n in needles])


def lookup(c: Column, mapping: Mapping, default) -> Column:
    """Literal map lookup with a default (compiled once per task)."""
    pairs = []
    for k, v in mapping.items():
        pairs.extend([F.lit(k), F.lit(v)])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def in_list(c: Column, values: Iterable[str]) -> Column:
    """``c`` is one of ``values`` (null if ``c`` is).  A loop over one literal array:
    ``isin`` writes a comparison per value into the generated code, and the JVM never
    compiles a method above 8,000 bytes."""
    return F.array_contains(F.array(*[F.lit(v) for v in values]), c)


EXACT_SCALE = 1_000_000_000


def micro_units(c: Column, scale: int = EXACT_SCALE) -> Column:
    """Value as an integer count of 1/scale units (floor(x*scale + 0.5))."""
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")


def exact_sum(c: Column, scale: int = EXACT_SCALE) -> Column:
    """Order-independent sum of short decimals: sum integer micro-units, then
    scale back.  Float sums depend on the order rows arrive in, which varies
    with partitioning; this does not."""
    return F.sum(micro_units(c, scale)).cast("double") / F.lit(float(scale))


def exact_avg(c: Column, scale: int = EXACT_SCALE) -> Column:
    return exact_sum(c, scale) / F.count(c).cast("double")

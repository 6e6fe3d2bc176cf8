"""Small column expressions: time, hash randomness, intervals of proportions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(name: str) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {name})")


def minutes_between(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / 60e6


def draw(*parts: object) -> Column:
    """A number in 0 .. 2**32 - 1 from md5 of the parts; independent of partitions, and the same in any engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def day_part(hour: Column) -> Column:
    """night 0-5, morning 6-11, afternoon 12-17, evening 18-23."""
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the score interval of a proportion; both 0 for no trials."""
    n, p = total.cast("double"), successes / F.nullif(total, F.lit(0))
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    none = total <= 0
    return (
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin)),
        F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + margin)),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def rounded_cents(x: Column) -> Column:
    """Two digits, as SQL rounds a double: the hundredfold to a whole number, halves away from zero, and back.  (Spark's round goes by
    a number's decimal writing: 2421.575 becomes 2421.58 there, though 242157.49999999997 is its hundredfold.)"""
    return F.round(x * 100) / 100


def text_ratio(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer text's length; 1 for two empty texts, null if one is null."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)

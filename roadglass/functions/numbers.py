"""Numbers in text, by the grammar of Python's int() and float()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

INTEGER = r"^[+-]?\d+(_\d+)*$"
FLOAT = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"


def is_integer(c: Column) -> Column:
    return c.rlike(INTEGER)


def is_float(c: Column) -> Column:
    """A number in text; integers are floats too."""
    return c.rlike(FLOAT)


def value(c: Column) -> Column:
    """The double that a number in text stands for, else null; integers too large are infinite, signed nan is null."""
    return F.when(c.rlike(FLOAT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def number(c: Column) -> Column:
    """A cell as double; null where it is no number."""
    return value(strip(c.cast("string")))


def integer(c: Column) -> Column:
    """A cell as long, cut toward zero; null where it is no finite number that fits."""
    return number(c).try_cast("long")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded half to even to two places; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(F.try_divide(part, whole) * 100, 2))

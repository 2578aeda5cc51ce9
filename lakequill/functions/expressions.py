"""Column expressions with the dialect's semantics where Spark's own differ. They expect a session without ANSI errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("int", "bigint", "double")
#: Texts that may be dates: year, month and day. Spark alone would take a year for a date as well.
DATE = r"^\s*[0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}\s*$"


def supertype(a: str, b: str) -> str:
    """The wider of two numeric types."""
    return NUMERIC[max(NUMERIC.index(a), NUMERIC.index(b))]


def divide(a: Column, b: Column) -> Column:
    """Always a double; NULL for a zero divisor."""
    return a.cast("double") / b.cast("double")


def modulo(a: Column, b: Column, kind: str) -> Column:
    """Integers: NULL for a zero divisor. Doubles: NaN, as IEEE has it."""
    if kind != "double":
        return a.cast(kind) % b.cast(kind)
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(a % b)


def date_difference(a: Column, b: Column) -> Column:
    """Days from b to a as an integer."""
    return F.datediff(a, b)


def plain_like(value: Column, pattern: str) -> Column:
    """LIKE without an escape character: the one that Spark needs is a character that the pattern does not hold."""
    escape = next(c for c in map(chr, (*range(33, 127), *range(161, 1000))) if c not in pattern and c not in "%_")
    return F.like(value, F.lit(pattern), F.lit(escape))


def cast(value: Column, source: str, target: str) -> Column | None:
    """The cast, or None where the dialect has none."""
    if source == target or source == "null":
        return value.cast(target)
    if source in NUMERIC and target in NUMERIC or source == "boolean" and target in NUMERIC:
        return value.cast(target)
    if source == "date" and target in ("int", "bigint"):
        return F.unix_date(value).cast(target)
    if source == "int" and target == "date":
        return F.date_from_unix_date(value)
    if target == "string":
        return value.cast("string")
    if source == "string" and target == "date":
        day = F.when(value.rlike(DATE), value.cast("date"))
        return F.when(value.isNotNull() & day.isNull(), F.raise_error(F.concat(F.lit("cannot cast '"), value, F.lit("' to DATE"))).cast("date")).otherwise(day)
    if source.startswith("timestamp") and target == "date":
        return value.cast("date")
    return None


def total(value: Column, kind: str) -> Column:
    """sum: integers and booleans as wrapping 64-bit integers."""
    return F.sum(value if kind == "double" else value.cast("bigint"))


def mean(value: Column, kind: str) -> Column:
    return F.avg(value.cast("double") if kind != "boolean" else value.cast("int").cast("double"))

"""Scalar helpers, saturating where the contract says so; registered for SQL by `register`."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

INT_MAX, INT_MIN, LONG_MAX = 2**31 - 1, -(2**31), 2**63 - 1


def _fibonacci_table() -> list[int]:
    out, a, b = [], 0, 1
    while a <= LONG_MAX:
        out.append(a)
        a, b = b, a + b
    return out


FIBONACCI = _fibonacci_table()


def clamp_int(x: Column) -> Column:
    """`x` within the range of an int; least and greatest alone would pass over a null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x.cast("long"), F.lit(INT_MIN)), F.lit(INT_MAX)).cast("int"))


def hello() -> Column:
    return F.lit("hello")


def add_numbers(a: Column, b: Column) -> Column:
    return clamp_int(a.cast("long") + b.cast("long"))


def fibonacci(n: Column) -> Column:
    """The n-th Fibonacci number; 0 below 1, the largest long where it overflows."""
    table = F.array(*(F.lit(x).cast("long") for x in FIBONACCI))
    return F.when(n <= 0, F.lit(0).cast("long")).when(n >= len(FIBONACCI), F.lit(LONG_MAX)).otherwise(F.get(table, n))


def array_sum(values: Column) -> Column:
    """Sum that saturates after each element, so order matters; nulls count as 0."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: clamp_int(acc + F.coalesce(x, F.lit(0))).cast("long")).cast("int")


def shout(text: Column) -> Column:
    return F.concat(F.upper(text), F.lit("!"))


def greatest_of(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(a, b, c)


def is_even(n: Column) -> Column:
    return F.pmod(n, F.lit(2)) == 0


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def double_or_none(n: Column) -> Column:
    return clamp_int(n.cast("long") * 2)


def greeting(name: Column, age: Column | None = None) -> Column:
    return F.format_string("Hello, %s! You are %d years old.", name, F.lit(20) if age is None else age)


def saturating_backoff(attempts: Column) -> Column:
    """Seconds to wait after a number of failed attempts: doubling, at most an hour."""
    return F.least(F.lit(3600), F.pow(F.lit(2.0), F.least(F.lit(12), attempts - 1)).cast("int"))


def register(spark: SparkSession) -> None:
    """SQL functions of the same names, as native expressions rather than Python ones."""
    bodies = {
        "add_numbers(a INT, b INT) RETURNS INT": "if(a + cast(b as bigint) is null, null, cast(least(greatest(cast(a as bigint) + b, -2147483648L), 2147483647L) as int))",
        "shout(t STRING) RETURNS STRING": "concat(upper(t), '!')",
        "greatest_of(a INT, b INT, c INT) RETURNS INT": "greatest(a, b, c)",
        "is_even(n INT) RETURNS BOOLEAN": "pmod(n, 2) = 0",
        "double_or_none(n INT) RETURNS INT": "if(n is null, null, cast(least(greatest(cast(n as bigint) * 2, -2147483648L), 2147483647L) as int))",
        "greeting(name STRING, age INT DEFAULT 20) RETURNS STRING": "format_string('Hello, %s! You are %d years old.', name, age)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

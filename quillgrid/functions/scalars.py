"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_index(text: Column) -> Column:
    """An index written as text: an integer literal, else null. '2.0' and 'x' are null, ' 2 ' and '+2' are 2."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def number(text: Column) -> Column:
    """A decimal or exponent literal as a double, else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def truncated(value: Column) -> Column:
    """A double cut to a whole number toward zero."""
    return value.try_cast("bigint")


def uniform(seed: int, *keys: Column) -> Column:
    """A reproducible uniform number in (0, 1) of keys: unlike rand(), it doesn't depend on partitions."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def below(limit: Column | int, seed: int, *keys: Column) -> Column:
    """A reproducible whole number from 0 up to a limit, not included."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.least(F.floor(uniform(seed, *keys) * limit), limit - 1).cast("bigint")


#: Rounds of the permutation, and walks for numbers that it sends beyond the range.
ROUNDS, WALKS = 4, 16


def permuted(number: Column, n: int, seed: int, *keys: Column) -> Column:
    """A keyed permutation of the whole numbers from 0 up to n, not included: distinct numbers give distinct ones, in every order of the
    key about as likely as any. The range is a grid of r x c; each round adds to one coordinate a hash of the other. What falls
    into the grid's last cells beyond n is permuted again."""
    c = max(1, int(n**0.5))
    r = -(-n // c)

    def once(x: Column) -> Column:
        def turn(k: int, xy: Column) -> Column:
            a, b = xy["a"], xy["b"]
            a = F.pmod(a + F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * k), b, *keys), F.lit(r)), F.lit(r))
            return F.struct(a.alias("a"), F.pmod(b + F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * k + 1), a, *keys), F.lit(c)), F.lit(c)).alias("b"))

        xy = F.struct(F.floor(x / c).cast("bigint").alias("a"), F.pmod(x, F.lit(c)).cast("bigint").alias("b"))
        for k in range(ROUNDS):
            xy = F.get(F.transform(F.array(xy), lambda v, k=k: turn(k, v)), F.lit(0))
        return F.get(F.transform(F.array(xy), lambda v: v["a"] * c + v["b"]), F.lit(0))

    first = once(number.cast("bigint"))
    return first if r * c == n else F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def normal(seed: int, *keys: Column) -> Column:
    """A reproducible standard normal number of keys."""
    return F.sqrt(-2 * F.log(uniform(seed, F.lit(0), *keys))) * F.cos(2 * F.pi() * uniform(seed, F.lit(1), *keys))


def winner(speedup: Column, first: str, second: str) -> Column:
    """Which of two is faster, by the quotient of the second's time and the first's."""
    return F.when(speedup > 1, first).otherwise(second)


def rate(n: Column, seconds: Column) -> Column:
    """Entries a second; null for no time."""
    return F.when(seconds > 0, n / seconds)


def grouped_digits(n: Column) -> Column:
    """A whole number as text with commas between thousands."""
    return F.format_number(n, 0)


def stamp() -> Column:
    """The time of the query as text, year to second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")

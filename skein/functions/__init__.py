"""Column expressions: percentiles, buckets, keys, retries and fees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, in the unit of the value.
HISTOGRAM_BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500]


def nearest_rank(p: float, column: str) -> Column:
    """Exact percentile by nearest rank: the smallest value at or above p percent of the rows."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def signed_md5_key(column: str) -> Column:
    """The first 32 bits of the md5 as a signed number."""
    bits = F.conv(F.substring(F.md5(F.col(column).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(bits >= 2**31, bits - 2**32).otherwise(bits)


def keyed_hash(column: str) -> Column:
    """A 64-bit key of a text: XXH64 of its UTF-8 bytes with seed 42, as a signed number."""
    return F.xxhash64(F.col(column))


def uuid_of(*columns: str) -> Column:
    """A UUID made of a row's values, the same in every run: their md5, null values as empty."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def jittered(seconds: int, spread: int, column: str) -> Column:
    """A time to live of `seconds` give or take `spread`, drawn from a key's md5."""
    bits = F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.lit(seconds - spread).cast("long") + bits % (2 * spread + 1)


def labels_text(pairs: dict[str, Column]) -> Column:
    """{name="value",...} of a metric's labels, in their order; quotes, backslashes and line ends are escaped."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    parts = [F.concat(F.lit(f'{name}="'), plain(c.cast("string")), F.lit('"')) for name, c in pairs.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def collision_probability(n: Column, bits: int) -> Column:
    """Birthday bound of a collision among n keys."""
    n = n.cast("double")
    return 1 - F.exp(-n * (n - 1) / F.lit(float(2 ** (bits + 1))))


def backoff(attempt: Column, base: int, most: int) -> Column:
    """Upper bound of a retry's wait: doubling from `base`, capped."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))


def fee_cents(amount: Column) -> Column:
    """2.9 per cent, rounded half up, and 30 cents."""
    return F.floor((amount * 29 + 500) / 1000).cast("long") + 30


def keyset_after(columns: list[tuple[str, str, object]]) -> Column:
    """Rows after a cursor in ascending order of (column, type, value): a typed tuple comparison.

    The first column's bound is added as a conjunct of its own, which the scan can use.
    """
    left = F.struct(*[F.col(c) for c, _, _ in columns])
    right = F.struct(*[F.lit(v).cast(t).alias(c) for c, t, v in columns])
    first, kind, value = columns[0]
    return (F.col(first) >= F.lit(value).cast(kind)) & (left > right)


def month_range(column: str, month: str) -> Column:
    """`date_trunc('month', column) = month` as a half-open range, which the scan can use."""
    start = F.lit(month).cast("timestamp_ntz")
    return (F.col(column) >= start) & (F.col(column) < F.expr(f"timestamp_ntz'{month}' + interval 1 month"))

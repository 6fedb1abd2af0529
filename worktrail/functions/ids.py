"""Identifiers, hashes, splits and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_id(c: Column, default: str = "unknown") -> Column:
    """Letters and digits stay, all else becomes an underscore; none at either end."""
    slug = F.regexp_replace(F.regexp_replace(c, "[^\\p{L}\\p{N}]", "_"), "^_+|_+$", "")
    return F.regexp_replace(slug, "^$", default)


def safe_condition(c: Column) -> Column:
    return safe_id(F.lower(c), "value")


def reviewer_slug(c: Column) -> Column:
    return F.regexp_replace(safe_condition(c), "(_reviewer|_review)$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits over parts that each end in a NUL."""
    return F.substring(F.sha2(sample_key_text(*parts), 256), 1, 16)


def sample_key_text(*parts: Column) -> Column:
    nul = F.lit("\u0000")
    return F.concat(*[x for p in parts for x in (p.cast("string"), nul)])


def hash_bucket(c: Column) -> Column:
    """The sha256 value modulo 10. 16 is 6 modulo 10 at every power, so the value is
    six times the sum of all digits but the last, plus the last."""
    hexed = F.sha2(c, 256)
    digits = F.transform(F.split(F.substring(hexed, 1, 63), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return (total * 6 + F.conv(F.substring(hexed, 64, 1), 16, 10).cast("int")) % 10


def split_of(c: Column) -> Column:
    bucket = hash_bucket(c)
    return F.when(bucket < 6, "train").when(bucket < 8, "dev").otherwise("test")


def split_key(candidates: list[Column], project_id: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], project_id)


def exact_round(c: Column, places: int) -> Column:
    """Round half to even on the exact binary value, as correctly rounded decimals do.

    ``bround`` looks at the shortest decimal text, so 1/160 = 0.00625 would be a tie
    there although its binary value lies above it. Here the distance to the half-way
    point is taken with the error term of the scaled product, which makes its sign exact.
    """
    scale = float(2 * 10**places)

    def rounded(v: Column) -> Column:
        p = v * F.lit(scale)
        big = v * F.lit(134217729.0)
        high = big - (big - v)
        error = (high * F.lit(scale) - p) + (v - high) * F.lit(scale)
        down = F.floor(p / 2)
        beyond_half = (p - (down * 2 + 1).cast("double")) + error
        up = (beyond_half > 0) | ((beyond_half == 0) & (F.pmod(down, F.lit(2)) == 1))
        return F.when(up, down + 1).otherwise(down) / F.lit(float(10**places))

    return F.transform(F.array(c.cast("double")), rounded)[0]


def stable_sum(c: Column | str) -> Column:
    """Sum that does not depend on row order: twelve-decimal terms, nine-decimal total.
    Floating sums differ in the last bit from run to run, which would flip rounded ties."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(col.cast("decimal(38,12)")), 9).cast("double")


def stable_mean(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return stable_sum(col) / F.nullif(F.count(col), F.lit(0))


def confidence(c: Column) -> Column:
    return exact_round(F.least(F.lit(0.95), F.greatest(F.lit(0.1), c)), 3)


def iso_wall(wall: Column) -> Column:
    """ISO text of a UTC wall-clock time, microseconds only where there are any."""
    text = wall.cast("timestamp_ntz").cast("string")
    return F.concat(
        F.substring(text, 1, 10),
        F.lit("T"),
        F.substring(text, 12, 8),
        F.when(F.length(text) > 19, F.concat(F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"))).otherwise(""),
        F.lit("+00:00"),
    )


def iso_seconds(ts: Column) -> Column:
    """ISO text of an instant, in UTC whatever the session's time zone is."""
    return iso_wall(F.convert_timezone(None, F.lit("UTC"), ts.cast("timestamp_ntz")))

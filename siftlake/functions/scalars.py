"""Scalar expressions: hashes, seeds, distances, geometry, sign tests, path checks and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns joined by NUL; a null is told apart from an empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def hash_order(seed: int | str, key: Column) -> Column:
    """A seeded order of keys that depends on nothing else: hex SHA-256 of ``seed:key``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def derived_seed(*parts: Column | str | int) -> Column:
    """The first 8 bytes of a SHA-256 of the NUL-joined parts, as an unsigned 64-bit number (DECIMAL(20, 0))."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.sha2(F.concat_ws("\0", *[c.cast("string") for c in columns]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two integers."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two hashes kept as arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def opposite_signs(a: Column, b: Column) -> Column:
    """True where one is above and the other below zero; zero agrees with either."""
    return F.signum(a) * F.signum(b) == -1


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(abs_), F.lit(rel) * F.greatest(F.abs(a), F.abs(b)))


def cosine_schedule(step: Column, total: int, base: float, floor: float = 0.0) -> Column:
    """A learning-rate schedule that falls from ``base`` to ``floor`` along half a cosine."""
    share = F.least(F.lit(1.0), step.cast("double") / F.lit(float(total)))
    return F.lit(floor) + F.lit(base - floor) * (1 + F.cos(share * F.lit(math.pi))) / 2


def log_z(x: Column, mean_log: Column, std_log: Column) -> Column:
    """z-score of ``ln x``; without spread 0 at the mean and infinite elsewhere."""
    d = F.ln(x) - mean_log
    flat = F.when(F.abs(d) <= 1e-12, F.lit(0.0)).otherwise(F.signum(d) * F.lit(float("inf")))
    return F.when(std_log > 1e-12, d / std_log).otherwise(flat)


def safe_relative_path(path: Column) -> Column:
    """Not absolute, no drive letter, no backslash, and no ``..`` part."""
    return ~path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)") & (F.length(path) > 0)


def portable_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def square_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, ratio: float) -> Column:
    """The square around a box's centre, ``ratio`` times its longer side, moved into and cut to the frame.

    The side is rounded half to even. The result is a struct ``x0, y0, x1, y1``.
    """
    side = F.least(F.bround(F.greatest(x1 - x0, y1 - y0) * F.lit(ratio)).cast("int"), width, height)
    left = F.floor((x0 + x1 - side) / 2).cast("int")
    top = F.floor((y0 + y1 - side) / 2).cast("int")
    left = F.greatest(F.lit(0), F.least(left, width - side))
    top = F.greatest(F.lit(0), F.least(top, height - side))
    return F.struct(left.alias("x0"), top.alias("y0"), (left + side).alias("x1"), (top + side).alias("y1"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector in double precision divided by its length; a zero vector is an error."""
    n = norm(a)
    checked = F.when(n > 0, n).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("double"))
    return F.transform(a, lambda x: x.cast("double") / checked)

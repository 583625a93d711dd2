"""Vector expressions: built-in functions only, sums in DOUBLE whatever the elements are."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; NULL if either vector is, or if their lengths differ."""
    a, b = _col(a), _col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; NaN where a vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.when(length != 0, length))


def cosine_normalized(a: Column | str, b: Column | str) -> Column:
    """1 - inner product: the distance that every search uses; vectors are taken as they are."""
    return 1 - dot(a, b)


def normalize(a: Column | str) -> Column:
    """The vector at length 1, as doubles; a zero vector stays as it is."""
    # the lambdas give the vector and its length names, so that neither is worked out for each element
    def divided(v: Column) -> Column:
        scaled = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / F.when(n != 0, n))))
        return scaled[0]

    return F.transform(F.array(_col(a).cast("array<double>")), divided)[0]


def is_normalized(a: Column | str, tolerance: float = 1e-4) -> Column:
    return F.abs(norm(a) - 1) <= tolerance


def parse_literal(text: Column | str) -> Column:
    """A vector written as numbers with commas: blanks and empty parts are skipped; a part that is
    no number makes the whole NULL."""
    parts = F.filter(F.transform(F.split(_col(text), ","), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("float"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def name_prefix(text: Column | str, size: int = 256) -> Column:
    """The first bytes of a text, which may end inside a character."""
    return F.substring(_col(text).cast("binary"), 1, size)


def text_fits(text: Column | str, most: int) -> Column:
    return F.octet_length(_col(text)) <= most


def hash_uniform(*parts: Column) -> Column:
    """In (0, 1], from the first 32 bits of an MD5: the same on every engine and every run."""
    first = F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, 8), 16, 10).cast("double")
    return (first + 1) / F.lit(4294967296.0)


def level(seed: int, row_id: Column | str, m: int = 16, most: int = 15) -> Column:
    """The layer of a graph node: floor(-ln(u) / ln(m)), drawn from its id."""
    u = hash_uniform(F.lit(str(seed)), _col(row_id).cast("string"))
    return F.least(F.lit(most), F.floor(-F.log(u) / F.lit(math.log(m)))).cast("int")


def hash_embedding(text: Column | str, dim: int) -> Column:
    """A unit vector that a text alone determines: a stand-in for an embedding model."""
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: hash_uniform(_col(text), i.cast("string")) * 2 - 1,
    )
    return normalize(raw)


def random_unit_vectors(spark, rows: int, dim: int, seed: int = 0):
    """(id, vec) of seeded unit vectors, the same whatever the partitions are."""
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 24)) / F.lit(float(1 << 23)) - 1,
    )
    return spark.range(rows).select("id", normalize(raw).cast("array<float>").alias("vec"))

"""Vector arithmetic as Column builders: higher-order functions only, so everything stays in the JVM.

Vectors are arrays of numbers; arithmetic is done in double unless a builder says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_NORM = 1e-10


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, never square-rooted."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2sq_int(a: Column, b: Column) -> Column:
    """Squared distance of 8-bit vectors, exact."""
    return F.aggregate(F.zip_with(a.cast("array<int>"), b.cast("array<int>"), lambda x, y: (x - y) * (x - y)), F.lit(0), lambda s, x: s + x)


def inner(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def ip_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - inner(a, b)


def norm2(a: Column) -> Column:
    return _sum(F.transform(as_double(a), lambda x: x * x))


def l2sq_by_norms(a: Column, b: Column) -> Column:
    """The form used for matrix products: both norms less twice the inner product."""
    return norm2(a) + norm2(b) - 2.0 * inner(a, b)


def normalize(a: Column) -> Column:
    n = F.sqrt(norm2(a))
    safe = F.when(n == 0, F.lit(ZERO_NORM)).otherwise(n)
    return F.get(F.transform(F.array(safe), lambda s: F.transform(as_double(a), lambda x: x / s)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return inner(a, b) / (F.sqrt(norm2(a)) * F.sqrt(norm2(b)))


def segment_means(a: Column, segments: int, order: list[int] | None = None) -> Column:
    """Means of `segments` runs of equal length, after the dimensions are taken in `order`."""
    v = as_double(a)
    if order is not None:
        v = F.transform(F.array(*map(F.lit, order)), lambda i: F.get(v, i))
    width = (F.size(v) / segments).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: _sum(F.slice(v, s * width + 1, width)) / width)


def early_abandoned(a: Column, b: Column, threshold: Column | float, step: int = 32, eps: float = 2.1) -> Column:
    """Squared distance, or the negative of its estimate once a prefix of the dimensions rules it out.

    After i of D dimensions the estimate is the partial sum times D / i; a pair is given up when that exceeds
    threshold * (1 + eps / sqrt(i)) ** 2, which is how far a random rotation lets a prefix stray.
    """
    gaps = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))

    def run(g: Column) -> Column:
        n = F.size(g)
        far = F.lit(threshold).cast("double") if not isinstance(threshold, Column) else threshold

        def take(s: Column, i: Column) -> Column:
            upto = F.least(i + step, n)
            part = s["d"] + _sum(F.slice(g, i + 1, upto - i))
            scaled = part * n / upto
            out = (upto < n) & (scaled > far * F.pow(1 + eps / F.sqrt(upto.cast("double")), F.lit(2.0)))
            new = F.struct(part.alias("d"), F.when(out, -scaled).alias("given_up"))
            return F.when(s["given_up"].isNotNull(), s).otherwise(new)

        start = F.struct(F.lit(0.0).alias("d"), F.lit(None).cast("double").alias("given_up"))
        return F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(step)), start, take, lambda s: F.coalesce(s["given_up"], s["d"]))

    return F.get(F.transform(F.array(gaps), run), F.lit(0))


#: Distances by name: the extension point for further metrics.
METRICS = {"l2": l2sq, "ip": ip_distance, "cosine": lambda a, b: F.lit(1.0) - cosine(a, b)}

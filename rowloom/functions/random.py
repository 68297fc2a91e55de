"""Randomness as a pure function of (seed, stream, row id).

``rand(seed)`` depends on how rows are partitioned, so a lost and recomputed task may
draw other numbers. ``xxhash64`` of the row id stays inside code generation, gives the
same value wherever the row is computed, and needs no state.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, functions as F


def stream_key(seed: int, stream: str) -> int:
    """Signed 64-bit key of a named stream of random numbers."""
    digest = hashlib.sha256(f"{seed}/{stream}".encode()).digest()
    return int.from_bytes(digest[:8], "big", signed=True)


def _ids(ids) -> list[Column]:
    return [(F.col(i) if isinstance(i, str) else i).cast("bigint") for i in ids]


def hash_bits(seed: int, stream: str, *ids) -> Column:
    """64 hashed bits of the integer row id (one or several columns)."""
    return F.xxhash64(F.lit(stream_key(seed, stream)).cast("bigint"), *_ids(ids))


def uniform(seed: int, stream: str, *ids) -> Column:
    """Uniform number strictly inside (0, 1), with 52 random bits."""
    return (F.shiftrightunsigned(hash_bits(seed, stream, *ids), 12) + F.lit(0.5)) * F.lit(2.0**-52)


def normal(seed: int, stream: str, *ids) -> Column:
    """Standard normal number (Box-Muller on two uniform streams)."""
    u = uniform(seed, stream + "/r", *ids)
    v = uniform(seed, stream + "/a", *ids)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)


def index_below(u: Column, n: Column | int) -> Column:
    """Integer in 0..n-1 from a uniform number."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor(u * n), n.cast("bigint") - 1).cast("bigint")


# fixed values: the rational approximations of algorithm AS 241 (Wichura 1988), highest power first
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
     1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077,
     687.1870074920579083, 42.313330701600911252, 1.0),
)
_TAIL = (
    (7.7454501427834140764e-4, 2.27238449892691845833e-2, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504,
     5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 1.51986665636164571966e-2, 0.14810397642748007459, 0.68976733498510000455,
     1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.2426609473880784386e-3, 2.65321895265761230930e-2, 0.29656057182850489123,
     1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 1.48753612908506148525e-2,
     0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(polynomials, x: Column) -> Column:
    def value(coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    return value(polynomials[0]) / value(polynomials[1])


def upper_quantile(q: Column) -> Column:
    """The ``z`` above which a standard normal number lies with probability ``q``, precise also for tiny ``q``."""
    centre = F.lit(0.5) - q
    r = F.sqrt(-F.ln(F.least(q, F.lit(1.0) - q)))
    far = F.when(r <= 5.0, _ratio(_TAIL, r - F.lit(1.6))).otherwise(_ratio(_FAR_TAIL, r - F.lit(5.0)))
    middle = _ratio(_MIDDLE, F.lit(0.180625) - centre * centre) * centre
    return F.when(F.abs(centre) <= 0.425, middle).otherwise(F.when(q < 0.5, far).otherwise(-far))

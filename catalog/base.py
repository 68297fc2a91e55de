"""Registry of the queries and helpers for the SQL they are checked against."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.functions.random import stream_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RK_SQL = ", ".join(RK)


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the equivalent SQL, if there is any."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = " ".join(sql.split())
        return function

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem_orders(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey)


LO_SQL = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def r6(column, name: str):
    """Doubles are compared to six places."""
    return F.round(column, 6).alias(name)


# -- the row hash in SQL ---------------------------------------------------------------
# fixed values: primes of the public xxHash64 definition
_P1, _P2, _P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_P4, _P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_MASK = f"{2**64 - 1}::HUGEINT"


def _mul(x: str, prime: int) -> str:
    signed = prime - 2**64 if prime >= 2**63 else prime
    return f"(({x}) * ({signed})::HUGEINT & {_MASK})"


def _rotate(x: str, r: int) -> str:
    return f"((({x}) << {r} & {_MASK}) | (({x}) >> {64 - r}))"


def with_bits(source: str, ids: list[str], seed: int, stream: str, name: str) -> str:
    """``source`` (a FROM item) with the 64 hash bits of the ids, one step per subquery."""
    q, seed_text = source, "42::HUGEINT"
    for c in [str(stream_key(seed, stream) % 2**64), *ids]:
        drop = ", _h" if seed_text == "_h" else ""
        q = f"(SELECT *, {_mul(f'({c})::HUGEINT', _P2)} AS _a FROM {q})"
        q = f"(SELECT * EXCLUDE (_a), {_mul(_rotate('_a', 31), _P1)} AS _b FROM {q})"
        q = f"(SELECT * EXCLUDE (_b), xor(({seed_text}) + {_P5 + 8}::HUGEINT & {_MASK}, _b) AS _c FROM {q})"
        q = f"(SELECT * EXCLUDE (_c{drop}), ({_mul(_rotate('_c', 27), _P1)} + {_P4}::HUGEINT) & {_MASK} AS _d FROM {q})"
        q = f"(SELECT * EXCLUDE (_d), {_mul('xor(_d, _d >> 33)', _P2)} AS _e FROM {q})"
        q = f"(SELECT * EXCLUDE (_e), {_mul('xor(_e, _e >> 29)', _P3)} AS _f FROM {q})"
        q = f"(SELECT * EXCLUDE (_f), xor(_f, _f >> 32) AS _h FROM {q})"
        seed_text = "_h"
    return f"(SELECT * EXCLUDE (_h), _h AS {name} FROM {q})"


def with_u(source: str, ids: list[str], seed: int, stream: str, name: str = "u") -> str:
    """``source`` with the uniform number of a stream as column ``name``."""
    bits = with_bits(source, ids, seed, stream, f"{name}_bits")
    return f"(SELECT * EXCLUDE ({name}_bits), (({name}_bits >> 12)::DOUBLE + 0.5) * {2.0**-52!r} AS {name} FROM {bits})"


def with_normal(source: str, ids: list[str], seed: int, stream: str, name: str = "z") -> str:
    """``source`` with the standard normal number of a stream as column ``name``."""
    q = with_u(with_u(source, ids, seed, stream + "/r", "_ur"), ids, seed, stream + "/a", "_ua")
    return f"(SELECT * EXCLUDE (_ur, _ua), sqrt(-2.0 * ln(_ur)) * cos({2 * math.pi!r} * _ua) AS {name} FROM {q})"


def below(u: str, n: str) -> str:
    return f"least(floor({u} * ({n})), ({n}) - 1)::BIGINT"

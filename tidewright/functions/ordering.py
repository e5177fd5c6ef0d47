"""Deterministic random orders and draws: SHA-256 of seed, tag and key, equal in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int, tag: str, *keys: Column | str) -> Column:
    """A hex string to order by; sorting by it is a shuffle of the keys that any engine repeats."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[p.cast("string") for p in parts]), 256)


def hash_number(seed: int, tag: str, *keys: Column | str) -> Column:
    """A long in [0, 2**32): the first eight hex digits of the hash."""
    return F.conv(F.substring(hash_order(seed, tag, *keys), 1, 8), 16, 10).cast("long")


def hash_uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """A double in [0, 1)."""
    return hash_number(seed, tag, *keys) / F.lit(float(1 << 32))


def hash_choice(seed: int, tag: str, options: Column, *keys: Column | str) -> Column:
    """One element of an array, null for an empty one."""
    size = F.size(options)
    return F.when(size > 0, F.get(options, F.pmod(hash_number(seed, tag, *keys), F.greatest(size, F.lit(1))).cast("int")))

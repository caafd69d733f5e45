"""Joins that spread a hot key of the large side, or leave the large side where it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import written

#: Rows of short keys that may be sent to every executor.
SMALL_SIDE = 1_000_000


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Equi join where rows of one key of ``big`` go to ``salts`` tasks.

    ``small`` has few rows per key and is repeated once per salt. ``how`` is a join type
    that keeps ``big`` on the left: inner, left, left_semi or left_anti.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    all_salts = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    repeated = small.withColumn("_salt", F.explode(all_salts))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def small_side(keys: DataFrame) -> DataFrame:
    """``keys`` written once and, if the count is small, marked to be sent to the other side of a join."""
    kept = written(keys)
    return F.broadcast(kept) if kept.count() <= SMALL_SIDE else kept

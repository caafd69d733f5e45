"""Governance expressions: sensitivity order, retention comparison, recall eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.temporal import valid_at


def sensitivity_rank(s: Column) -> Column:
    return F.when(s == "personal", 0).when(s == "sensitive", 1).when(s == "restricted", 2)


def retention_no_later(
    d_mode: Column, d_expires: Column, d_policy: Column,
    s_mode: Column, s_expires: Column, s_policy: Column,
) -> Column:
    """A derived retention ends no later than its source; policies compare only by id."""
    rule = (
        F.when((d_mode == "until_deleted") & (s_mode == "until_deleted"), True)
        .when((d_mode == "until_time") & (s_mode == "until_deleted"), True)
        .when((d_mode == "until_time") & (s_mode == "until_time"), d_expires <= s_expires)
        .when((d_mode == "policy") & (s_mode == "policy"), d_policy == s_policy)
        .otherwise(F.lit(False))
    )
    return F.coalesce(rule, F.lit(False))


def not_weaker(derived: str, source: str) -> Column:
    """Derived governance is at least as strict as its source (column prefixes)."""
    d, s = (lambda c: F.col(f"{derived}{c}")), (lambda c: F.col(f"{source}{c}"))
    return (
        (sensitivity_rank(d("sensitivity")) >= sensitivity_rank(s("sensitivity")))
        & retention_no_later(
            d("retention_mode"), d("retention_expires_at"), d("retention_policy_id"),
            s("retention_mode"), s("retention_expires_at"), s("retention_policy_id"),
        )
        & ((s("deletion_state") == "active") | (d("deletion_state") != "active"))
    )


def expired(mode: Column, expires: Column, as_of: Column) -> Column:
    """Retention has ended: until_time with no end, or an end at or before ``as_of``."""
    return (mode == "until_time") & (expires.isNull() | (expires <= as_of))


def reject_reason(as_of: Column, allowed: Sequence[str], namespace: Column | None = None) -> Column:
    """First reason a recall row is not eligible, null when it is.

    Works on the columns of a recall row; the tests run in the order given here.
    """
    if not allowed:
        raise ValueError("at least one sensitivity must be allowed")
    reason = F.when(~F.col("sensitivity").isin(*allowed), F.lit("sensitivity"))
    if namespace is not None:
        reason = F.when(F.col("namespace_id") != namespace, F.lit("namespace")).when(
            ~F.col("sensitivity").isin(*allowed), F.lit("sensitivity")
        )
    return (
        reason.when(F.col("available_at") > as_of, F.lit("not_available"))
        .when(
            expired(F.col("retention_mode"), F.col("retention_expires_at"), as_of),
            F.lit("retention"),
        )
        .when(
            (F.col("object_kind") == "memory_record")
            & ~valid_at(F.col("valid_mode"), F.col("valid_start"), F.col("valid_end"), as_of),
            F.lit("valid_time"),
        )
    )


def eligible(as_of: Column, allowed: Sequence[str], namespace: Column | None = None) -> Column:
    return reject_reason(as_of, allowed, namespace).isNull()

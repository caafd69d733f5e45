"""SHA-256 digests of bytes, NFC text, JSON columns and unbounded id sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import nfc

# fixed values: digest profile names
PROFILES = [
    "exact-bytes-v1",
    "nfc-text-v1",
    "canonical-json-v1",
    "context-pack-v1",
    "deletion-evidence-v1",
]
HEX64 = "^[0-9a-f]{64}$"


def exact_digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def nfc_digest(text: Column) -> Column:
    return F.sha2(nfc(text), 256)


def json_digest(text: Column) -> Column:
    """Digest of the JSON value, not its spelling: sorted keys, no spaces.

    Null for bad syntax or a repeated key.
    """
    return F.sha2(F.to_json(F.try_parse_json(text)), 256)


def json_flags(text: Column) -> Column:
    """Reasons why a JSON text has no canonical digest (empty array when it has one)."""
    parsed = F.try_parse_json(text)
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    return F.filter(
        F.array(
            F.when(parsed.isNull(), F.lit("Syntax")),
            F.when(bare.rlike(r"\bnull\b"), F.lit("NullForbidden")),
            F.when(
                bare.rlike(r"\d[eE][+-]?\d") | bare.rlike(r"\d{39,}"),
                F.lit("NumberExpansionLimit"),
            ),
        ),
        lambda r: r.isNotNull(),
    )


def digest_by_profile(profile: Column, text: Column) -> Column:
    """Digest for a named profile; null for a profile that is not known."""
    return (
        F.when(profile == "exact-bytes-v1", exact_digest(text))
        .when(profile == "nfc-text-v1", nfc_digest(text))
        .when(
            profile.isin("canonical-json-v1", "context-pack-v1", "deletion-evidence-v1"),
            json_digest(text),
        )
    )


def stable_id(scenario: Column, kind: Column, key: Column) -> Column:
    """Deterministic id of an object by scenario, kind and logical key."""
    return F.concat_ws(":", F.lit("urn"), F.lit("memlake"), F.lower(scenario), F.lower(kind), key)


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(HEX64), F.lit(False))


def row_fingerprint(*cols: Column | str) -> Column:
    """Digest of a row's named values; changes with any value, name or null."""
    packed = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return F.sha2(packed, 256)


def set_digest(df: DataFrame, keys: list[str], member: Column, name: str = "set_digest", parts: int | None = None) -> DataFrame:
    """``n_members`` and the digest of the set of ``member`` texts per key.

    One definition for every size: the SHA-256 of each distinct member is cut into eight
    32-bit numbers; the digest is that of the member count and the eight sums, joined by
    colons. Sums need no order and no group is gathered, so a key of any size is added up
    in parts. With ``parts`` the members are dealt to so many tasks before copies are dropped,
    so no task holds more than its share of them.
    """
    m = df.select(*keys, F.unhex(F.sha2(member, 256)).alias("_h"))
    m = (m.repartition(parts, *keys, "_h") if parts else m).distinct()
    limb = lambda i: F.sum(F.conv(F.hex(F.substring("_h", 4 * i + 1, 4)), 16, 10).cast("decimal(38,0)"))
    sums = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members"), *[limb(i).alias(f"_s{i}") for i in range(8)])
    return sums.select(*keys, "n_members", F.sha2(F.concat_ws(":", "n_members", *[F.col(f"_s{i}").cast("string") for i in range(8)]), 256).alias(name))

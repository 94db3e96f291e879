"""Deterministic ids and hashes as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of the ids.
NAMESPACE = "7308095f-9773-5212-acef-a4c9f422b66c"
#: The hash that the first batch of a chain follows.
GENESIS = "0" * 64


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a name, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def raw_id(topic: Column, partition: Column, offset: Column) -> Column:
    return uuid5(F.concat_ws(":", topic, partition.cast("string"), offset.cast("string")))


def event_id(raw: Column, rule_version: Column) -> Column:
    return uuid5(F.concat_ws(":", raw, rule_version.cast("string")))


def content_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def merkle_level(hashes: Column) -> Column:
    """The level above an array of hex hashes: pairs are hashed as bytes, an odd last one with itself."""
    at = F.sequence(F.lit(0), F.greatest(F.floor((F.size(hashes) - 1) / 2).cast("int"), F.lit(0)))
    pair = lambda i: F.sha2(F.concat(F.unhex(F.get(hashes, 2 * i)), F.unhex(F.coalesce(F.get(hashes, 2 * i + 1), F.get(hashes, 2 * i)))), 256)
    return F.transform(at, pair)


def merkle_root(leaves: Column) -> Column:
    """Root over an array of hex hashes: pairs are hashed as bytes, an odd last one with itself.

    A single leaf is the root; no leaves give null. 40 levels cover any array.
    """
    levels = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size(leaves))).cast("int"), F.lit(1)))
    return F.get(F.aggregate(levels, leaves, lambda hashes, _: F.when(F.size(hashes) > 1, merkle_level(hashes)).otherwise(hashes)), F.lit(0))


def merkle_subtree(leaves: Column, height: int) -> Column:
    """The node that stands height levels above an aligned block of at most 2^height hex hashes of a longer row."""
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(height)), leaves, lambda hashes, _: merkle_level(hashes)), F.lit(0))

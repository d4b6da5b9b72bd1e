"""Canonical hashes, unit-interval hashes and deterministic buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Partitions in order, with their weights.
PARTITIONS = ("pruning", "quant", "recovery", "validation", "golden", "torture")
WEIGHTS = {"pruning": 0.35, "quant": 0.20, "recovery": 0.20, "validation": 0.10, "golden": 0.10, "torture": 0.05}


def sha256_hex(c: Column) -> Column:
    """Lower-case hex digest of a string's UTF-8 bytes."""
    return F.sha2(c.cast("string"), 256)


def short_id(c: Column, n: int = 24) -> Column:
    return F.substring(sha256_hex(c), 1, n)


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in order and no spaces, for hashing; nulls are written as such."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def stable_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def unit_hash(salt: str, key: Column) -> Column:
    """A number in [0, 1): the first 16 hex digits of sha256(salt|key) over 16**16."""
    h = F.substring(F.sha2(F.concat(F.lit(salt + "|"), key.cast("string")), 256), 1, 16)
    return F.conv(h, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def weighted_bucket(u: Column, names: Sequence[str], weights: Mapping[str, float]) -> Column:
    """First name whose running weight exceeds ``u``; the last one if none does. The running
    sums are taken in order, in double precision. Weights must cover the names and sum to 1."""
    if sorted(weights) != sorted(names) or abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError(f"need one weight a name, adding up to 1; got {dict(weights)}")
    total, out = 0.0, None
    for n in names:
        total += weights[n]
        out = F.when(u < total, n) if out is None else out.when(u < total, n)
    return out.otherwise(names[-1])

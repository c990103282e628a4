"""Portable hashed randomness and content fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from barwright.functions.numeric import col


def hashed_int(*parts) -> Column:
    """A 32-bit integer from md5 of the colon-joined parts; the same in any engine that has md5."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A number in [0, 1) drawn from the parts."""
    return hashed_int(*parts) / F.lit(4294967296.0)


def draw_index(size, *parts) -> Column:
    """A position in 0..size-1 drawn from the parts."""
    return F.floor(uniform(*parts) * col(size)).cast("bigint")


def canonical(columns: Sequence[str]) -> Column:
    """Text of the columns that no other values share: each with its length in front, a dash where it is missing."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def record_hash(version: str, columns: Sequence[str]) -> Column:
    """Content hash of a row, salted with the dataset version."""
    return F.sha2(F.concat(F.lit(f"{len(version)}:{version}"), canonical(columns)), 256)


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """Aggregates that identify a table's content whatever its row order or partitioning."""
    digest = F.md5(canonical(columns))
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return [F.count(F.lit(1)).alias("row_count"),
            F.sum(high.cast("decimal(38,0)")).alias("hash_sum"),
            F.bit_xor(low).alias("hash_xor")]

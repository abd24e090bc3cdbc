"""Held-out folds by CRC-32 of the id as text; a null id is in no fold and is never learned from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sampled(doc_id: Column, share: Column | float) -> Column:
    """True for about ``share`` of the ids, the same ones every time."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < (share if isinstance(share, Column) else F.lit(share)) * 1_000_000

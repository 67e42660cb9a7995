"""Which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of doc_id as text leaves 1 modulo 3; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def bounded(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The most rows of least hash of key; a row's place does not depend on partitions."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(11)), key).limit(most)

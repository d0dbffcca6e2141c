"""Queries against all rows, in blocks: each block of packed rows meets each pack of queries in one cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(blocks: DataFrame, packs: DataFrame, *, slots: int, n_packs: int) -> DataFrame:
    """blocks (block, ...) beside packs (pack, ...), each with each. A block is sent once for each pack and a pack once for
    each of the slots that blocks are dealt to by hash, as many as there are blocks: so all cells are spread over the
    tasks, however few blocks or packs there are. Neither side is broadcast: the copies of packs grow with the blocks."""
    slot = F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot")
    left = blocks.select("*", slot).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))).alias("pack"))
    right = packs.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    return left.join(right.hint("merge"), ["pack", "slot"])


def pack_of(key: str, n_packs: int):
    """The pack of a query, by hash."""
    return F.pmod(F.xxhash64(key), F.lit(n_packs)).cast("int")

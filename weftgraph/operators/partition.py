"""Block layouts: which block an index falls in, and its place there."""

from __future__ import annotations

from pyspark.sql import functions as F


def ceil_block(index, n: int, blocks: int):
    """(block, local) for blocks of ceil(n / blocks); later blocks may be empty."""
    b = -(-n // blocks)
    return F.floor(index / b), index % b


def floor_block(index, n: int, blocks: int):
    """(block, local) for blocks of floor(n / blocks); the last takes what remains."""
    b = max(1, n // blocks)
    block = F.least(F.floor(index / b), F.lit(blocks - 1))
    return block, index - block * b


def stage_owner(block, parts: int, replicas: int):
    """Which replica multiplies a source block in the replicated layout."""
    return F.least(F.floor(block / max(1, parts // replicas // replicas)), F.lit(replicas - 1))


def grid_side(size: int, dims: int) -> int:
    """Side of a square or cubic grid of ``size`` blocks."""
    side = round(size ** (1 / dims))
    if side**dims != size:
        raise ValueError(f"{size} isn't a whole number to the power {dims}")
    return side

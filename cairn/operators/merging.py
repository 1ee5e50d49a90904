"""Deterministic merging of block streams."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import numbered


def round_robin(blocks: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Blocks with their ``slot`` in the source and ``position`` in the merge that takes one block of each source in turn.

    With all sources active at once a source that ends is just left out of later rounds, so a block's place is (slot, source).
    """
    slotted = blocks.withColumn("slot", (F.row_number().over(Window.partitionBy(source).orderBy(*order)) - 1).cast("long"))
    return numbered(slotted, ["slot", source], "position")


def merge_positions(counts: dict, active: int) -> list[tuple]:
    """The merge of sources with the given numbers of blocks when only ``active`` are open at once, as (source, slot).

    The next source takes the slot of one that has ended.  Only counts are needed, not blocks.
    """
    waiting = deque(counts)
    ring: list = []
    taken = {s: 0 for s in counts}
    while len(ring) < active and waiting:
        ring.append(waiting.popleft())
    out, at = [], 0
    while ring:
        at %= len(ring)
        s = ring[at]
        if taken[s] < counts[s]:
            out.append((s, taken[s]))
            taken[s] += 1
        if taken[s] >= counts[s]:
            if waiting:
                ring[at] = waiting.popleft()
            else:
                ring.pop(at)
                continue
        at += 1
    return out

"""Filling fixed-capacity containers with items (problem 7): best-two-fit.

A bin is filled greedily with the largest items that fit.  If room is left, its smallest item goes back and the two
unpacked items that fill the widened gap most tightly take its place, if they fill it better than the one did.  Sizes are
whole numbers up to the capacity, so the unpacked sizes are one bit set; "the largest that fits" and "two that add up
to t" are a few operations on it.

Items are dealt to shards of about ``shard_items`` by a hash of their id and each shard is packed by itself, so no task
grows with the input; what sharding costs is at most the unfilled last bins of each shard.  Only ids and sizes are
shuffled, never texts.

Defined results: an item above the capacity is cut into full containers and a rest, which is packed like an item; no
other item is split; items of size zero (empty or null texts) go into their shard's first bin; repeated rows are items of
their own; null ids are ids like others; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 20_000


def pack(sizes: Sequence[int], capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each size (all from 1 to ``capacity``), and the number of bins."""
    held: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        held.setdefault(int(size), []).append(i)
    mask = 0
    for size in held:
        mask |= 1 << size
    mirror = 0  # bit capacity - s for each unpacked size s
    for size in held:
        mirror |= 1 << (capacity - size)
    where = np.full(len(sizes), -1, dtype=np.int64)
    bins = 0

    def take(size: int) -> int:
        nonlocal mask, mirror
        stack = held[size]
        item = stack.pop()
        if not stack:
            mask &= ~(1 << size)
            mirror &= ~(1 << (capacity - size))
        return item

    def put_back(size: int, item: int) -> None:
        nonlocal mask, mirror
        held[size].append(item)
        mask |= 1 << size
        mirror |= 1 << (capacity - size)

    while mask:
        gap, inside = capacity, []
        while gap:
            fits = mask & ((1 << (gap + 1)) - 1)
            if not fits:
                break
            size = fits.bit_length() - 1
            inside.append((size, take(size)))
            gap -= size
        if gap and mask:
            smallest, item = min(inside)
            room = gap + smallest
            for total in range(room, smallest, -1):
                pairs = mask & (mirror >> (capacity - total)) & ((1 << total) - 1)
                if total % 2 == 0 and pairs >> (total // 2) & 1 and len(held[total // 2]) < 2:
                    pairs &= ~(1 << (total // 2))
                pairs &= ~1
                if pairs:
                    one = pairs.bit_length() - 1
                    inside.remove((smallest, item))
                    inside += [(one, take(one)), (total - one, take(total - one))]
                    put_back(smallest, item)
                    break
        for _, item in inside:
            where[item] = bins
        bins += 1
    return where, bins


_PACKED = "container string, capacity int, bin bigint, id bigint, piece int, first bigint, size bigint"


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    container, capacity, shard = pdf["container"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
    pdf = pdf.sort_values(["id", "size"], kind="stable")  # the same bins whatever the order of arrival
    size, ids = pdf["size"].to_numpy(np.int64), pdf["id"]
    full = np.where(size > capacity, size // capacity, 0)
    rest = size - full * capacity
    cut = np.repeat(np.arange(len(size)), full)
    piece = np.arange(len(cut)) - np.repeat(np.cumsum(full) - full, full)
    loose = np.flatnonzero((rest > 0) | (size == 0))
    sized = loose[rest[loose] > 0]
    where, bins = pack(rest[sized].tolist(), capacity)
    bin_of = np.zeros(len(size), dtype=np.int64)
    bin_of[sized] = where
    bins = max(bins, 1 if len(loose) else 0)
    take = np.concatenate([loose, cut])
    out = pd.DataFrame({
        "container": container,
        "capacity": np.int32(capacity),
        "bin": (np.int64(shard) << 32) + np.concatenate([bin_of[loose], bins + np.arange(len(cut))]),
        "id": ids.to_numpy()[take],
        "piece": np.concatenate([full[loose], piece]).astype(np.int32),
        "first": np.concatenate([full[loose] * capacity, piece * capacity]),
        "size": np.concatenate([rest[loose], np.full(len(cut), capacity, dtype=np.int64)]),
    })
    return out


def pack_items(items: DataFrame, containers: Sequence[tuple[str, int]], item_count: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``items`` (``id bigint, size bigint``) assigned to each kind of container, given as (name, capacity).

    One row per item, or per piece of an item above the capacity: ``container, capacity, bin, id, piece, first, size``,
    where ``first`` is the offset of the piece within its item.  ``item_count`` only sets the number of shards.
    """
    shards = max(1, -(-item_count // shard_items))
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(int(c)).alias("capacity")) for n, c in containers])
    dealt = items.select("id", "size", F.pmod(F.xxhash64("id", "size"), F.lit(shards)).cast("int").alias("shard"), F.explode(kinds).alias("kind"))
    dealt = dealt.select("id", "size", "shard", "kind.container", "kind.capacity")
    return dealt.groupBy("container", "capacity", "shard").applyInPandas(_pack_shard, _PACKED)

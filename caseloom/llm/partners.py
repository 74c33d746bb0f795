"""Which sets may have a partner at all: signatures of parts, and sketches of parities.

Sets of a and b elements that reach percent of their union differ in at most
(a + b)(100 - percent) / (100 + percent) elements. Elements are dealt to one part more than
that by a hash, so two such sets are equal in a part: both hold the same elements there, or
none. Sets that are equal in a part meet, and are compared by bits that tell whether an even
or odd number of elements falls on each: as many bits differ as elements do, at most. What
meets no set within the bound links with none. Both steps only ever keep too much.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import common

#: Bits of a sketch.
BITS = 512
#: Sets that are equal in a part are compared if so many at most; more all stay, as what decides on them is the join itself.
HOT = 4096
#: Rows that are compared at a time.
ROWS = 50_000


@lru_cache(maxsize=8)
def classes(percent: int, longest: int = 1 << 34) -> tuple[list[int], list[int]]:
    """Smallest and largest size of each class; sizes of sets that link are in one class or in neighbours."""
    low, high = [1], [100 // percent]
    while high[-1] < longest:
        low.append(high[-1] + 1)
        high.append(low[-1] * 100 // percent)
    return low, high


def differing(percent: int, both):
    """Most elements in which sets of so many together differ if they link."""
    return both * (100 - percent) // (100 + percent)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """Each value spread over 64 bits anew, in another way for each odd number."""
    x = x * np.uint64(by)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def signatures(items: np.ndarray, percent: int) -> np.ndarray:
    """A value for each part of the set, in its own class and the next larger one."""
    low, high = classes(percent)
    own = int(np.searchsorted(high, len(items)))
    found = []
    place, value = _mixed(items, 0x9E3779B97F4A7C15), _mixed(items, 0xC2B2AE3D27D4EB4F)
    for c in (own, own + 1):
        parts = differing(percent, 2 * high[c]) + 1
        if parts == 1:  # only equal sets would link
            continue
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, (place % np.uint64(parts)).astype(np.int64), value)
        found.append(_mixed(sums + _mixed(np.arange(parts, dtype=np.uint64) + np.uint64(c << 40), 0x165667B19E3779F9), 0x27D4EB2F165667C5))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def sketch(items: np.ndarray) -> bytes:
    at = (_mixed(items, 0x85EBCA77C2B2AE63) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS) & 1).tobytes()


def close(keys: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """Which rows are within the bound of another one with the same key; keys ascend."""
    end = np.searchsorted(keys, keys, side="right")
    hit = np.zeros(len(keys), bool)
    at, step = np.arange(len(keys)), 1
    while len(at := at[at + step < end[at]]):
        to = at + step
        a, b = sizes[at], sizes[to]
        bound = np.where(100 * np.minimum(a, b) >= percent * np.maximum(a, b), differing(percent, a + b), -1)
        near = np.bitwise_count(sketches[at] ^ sketches[to]).sum(axis=1, dtype=np.int64) <= bound
        hit[at[near]] = True
        hit[to[near]] = True
        step += 1
    return hit


def with_partners(sets: DataFrame, percent: int) -> DataFrame:
    """node of each of the sets (node, items: distinct unsigned 64-bit elements) that may link with another one.

    Each node comes once. Nodes are distinct and so are their sets; sets of which only equal
    ones would link have none.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                items = np.frombuffer(data, np.uint64)
                keys = signatures(items, percent).view(np.int64)
                one = [pa.array([x] * len(keys), k) for x, k in ((node, pa.int64()), (len(items), pa.int64()), (sketch(items), pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *one], names=["key", "node", "n", "sketch"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out(all_of_it: bool) -> pa.RecordBatch:
            nonlocal held, size
            keys, nodes, sizes, sketches = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(keys) if all_of_it else int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            found = np.unique(nodes[:cut][close(keys[:cut], sizes[:cut], sketches[:cut], percent)])
            held, size = [(keys[cut:], nodes[cut:], sizes[cut:], sketches[cut:])], len(keys) - cut
            return pa.RecordBatch.from_arrays([pa.array(found)], names=["node"])

        for b in batches:
            if not b.num_rows:
                continue
            numbers = [b.column(i).to_numpy() for i in range(3)]
            held.append((*numbers, np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(-1, BITS // 64)))
            size += b.num_rows
            if size > ROWS:
                yield out(False)
        if size:
            yield out(True)

    sent = common.kept(sets.select("node", "items").mapInArrow(send, "key long, node long, n long, sketch binary"), "part-signatures")
    many = common.kept(sent.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "part-counts")
    hot = sent.join(many.where(F.col("many") > HOT), "key").select("node")
    few = sent.join(many.where(F.col("many") <= HOT).select("key"), "key").select("key", "node", "n", "sketch")
    met = few.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "node long")
    return common.kept(met.unionByName(hot).distinct(), "partners")

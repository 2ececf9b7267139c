"""Blocked Bloom filters that many tasks build together.

A filter is a run of 64-byte blocks.  A key sets ``probes`` bits in one block,
so a probe reads one cache line.  Each task fills a filter of its own and
returns the pages of it that hold anything; pages are merged one after another
in page order, so merging holds one page at a time.  A pair of filters can be
kept: once-seen keys, and keys that were seen twice, in one task or in two.
Neither misses a key; a key that was not seen may look as if it was.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridframe.llm.common import mix64

BLOCK_BYTES = 64
PAGE_BYTES = 4096
#: Bits of the largest filter that is broadcast (32 MB), whatever the input.
MAX_BITS = 1 << 28

PAGES = "page int, once binary, twice binary"


def blocks_for(keys: int, bits_per_key: int, max_bits: int = MAX_BITS) -> int:
    """Blocks that give each key its bits; never more than ``max_bits`` hold."""
    return max(1, min(-(-keys * bits_per_key // (8 * BLOCK_BYTES)), max_bits // (8 * BLOCK_BYTES)))


def empty_filter(blocks: int) -> np.ndarray:
    """A filter of ``blocks`` blocks, filled up to whole pages."""
    return np.zeros(-(-blocks * BLOCK_BYTES // PAGE_BYTES) * PAGE_BYTES, np.uint8)


def _block_and_bits(keys: np.ndarray, first, blocks) -> tuple[np.ndarray, np.ndarray]:
    g = mix64(keys + np.uint64(0x9E3779B97F4A7C15))
    at = np.asarray(first, np.uint64) + (((g >> np.uint64(32)) * np.asarray(blocks, np.uint64)) >> np.uint64(32))
    return (at * np.uint64(BLOCK_BYTES)).astype(np.int64), mix64(g + np.uint64(0xD1B54A32D192ED03))


def add_keys(bits: np.ndarray, keys: np.ndarray, first, blocks, probes: int) -> None:
    """Set the bits of ``keys`` in the filter part of ``blocks`` blocks from ``first`` on."""
    base, r = _block_and_bits(keys, first, blocks)
    for j in range(probes):
        bit = ((r >> np.uint64(9 * j)) & np.uint64(511)).astype(np.int64)
        np.bitwise_or.at(bits, base + (bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))


def has_keys(bits: np.ndarray, keys: np.ndarray, first, blocks, probes: int) -> np.ndarray:
    """Which of ``keys`` may have been added; a key is given up at its first clear bit."""
    base, r = _block_and_bits(keys, first, blocks)
    left = np.arange(len(keys))
    for j in range(probes):
        bit = ((r >> np.uint64(9 * j)) & np.uint64(511)).astype(np.int64)
        hit = (bits[base + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
        left, base, r = left[hit], base[hit], r[hit]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out


def filled_pages(once: np.ndarray, twice: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The pages of a task's filters that hold anything, packed."""
    pages = once.reshape(-1, PAGE_BYTES)
    used = np.flatnonzero(pages.any(axis=1))
    schema = pa.schema([("page", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    for lo in range(0, len(used), 1024):
        part = used[lo : lo + 1024]
        second = [None] * len(part)
        if twice is not None:
            held = twice.reshape(-1, PAGE_BYTES)
            second = [zlib.compress(held[p].tobytes(), 1) if held[p].any() else None for p in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array([zlib.compress(pages[p].tobytes(), 1) for p in part], pa.binary()),
             pa.array(second, pa.binary())], schema=schema,
        )


def _unpacked(page: bytes | None) -> np.ndarray | None:
    return None if page is None else np.frombuffer(zlib.decompress(page), np.uint8)


def merged_filter(parts: DataFrame, blocks: int, twice: bool = False) -> np.ndarray:
    """The filter of all tasks' pages (``PAGES``): of all keys, or with ``twice``
    of those seen twice.  Its size is fixed by ``blocks``, not by the rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, once, second = None, None, None
        done: list[tuple[int, bytes]] = []

        def close() -> None:
            held = second if twice else once
            if page is not None and held is not None and held.any():
                done.append((page, zlib.compress(held.tobytes(), 1)))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in done], pa.int32()), pa.array([b for _, b in done], pa.binary())], names=["page", "bits"]
            )

        for batch in batches:
            for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("page", "once", "twice")), strict=True):
                if p != page:
                    close()
                    page, once, second = p, np.zeros(PAGE_BYTES, np.uint8), np.zeros(PAGE_BYTES, np.uint8)
                a, b = _unpacked(a), _unpacked(b)
                second |= a & once
                if b is not None:
                    second |= b
                once |= a
            yield out()
            done.clear()
        close()
        yield out()

    merged = parts.repartition("page").sortWithinPartitions("page").mapInArrow(merge, "page int, bits binary")
    bits = empty_filter(blocks)
    for row in merged.toLocalIterator():
        bits[row.page * PAGE_BYTES : (row.page + 1) * PAGE_BYTES] = _unpacked(bytes(row.bits))
    return bits

"""Benchmark decontamination by greedy string tiling.

Texts are sequences of tokens (runs of ASCII letters and digits and of bytes
from 0x80 on; A-Z and the Latin-1 capitals in lower case).  Runs of
``min_match`` tokens, hashed by a running Karp-Rabin hash over token hashes, are
the seeds.  Documents and benchmark items are joined on shared seeds; a fixed
bitmap of the benchmark's seeds goes to the tasks first, so that only seeds
that may match are moved.  For each pair of a document and an item, matches are
the maximal runs of shared seeds; the longest is marked again and again, and
what overlaps marked tokens is cut down to its unmarked parts, until no match
of ``min_match`` tokens is left.  The tiles cover an item whatever the order of
its parts.  The test is the share of the item's tokens that tiles cover within
a stretch of the document of ``spread`` times the item's length; each stretch is
tiled on its own, so copies of an item do not take each other's tokens.  Parts
that lie further apart count over the whole document, at a higher share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import (
    CHUNK_BYTES, byte_table, join_few, prefix_hash, row_chunks, row_identity, span_hash, staged, text_buffer, whole_rows,
    word_spans,
)

#: Bits of the seed filter; its size does not depend on the benchmark.
FILTER_BITS = 1 << 21

_CODES = byte_table(53, lower_ascii=True)
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, and the tokens before each row boundary."""
    starts, ends = word_spans(data, bounds, _TOKEN[data])
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, side="right")), lo + 1)
        piece = data[starts[lo] : ends[hi - 1]]
        capital = np.zeros(len(piece), bool)  # U+00C0 to U+00DE but U+00D7, in UTF-8
        capital[1:] = (piece[:-1] == 0xC3) & (piece[1:] >= 0x80) & (piece[1:] <= 0x9E) & (piece[1:] != 0x97)
        prefix = prefix_hash(_CODES[np.where(capital, piece + np.uint8(32), piece)])
        out[lo:hi] = span_hash(prefix, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
        lo = hi
    return out, np.searchsorted(starts, bounds)


def seeds(tokens: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, row, place) of every run of k tokens, by a running Karp-Rabin hash."""
    n = np.maximum(np.diff(counts) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = counts[row] + place
    out = np.empty(len(row), np.uint64)
    lo = 0
    while lo < len(row):
        hi = int(np.searchsorted(at, at[lo] + (1 << 18)))
        prefix = prefix_hash(tokens[at[lo] : at[hi - 1] + k])
        out[lo:hi] = span_hash(prefix, at[lo:hi] - at[lo], at[lo:hi] - at[lo] + k)
        lo = hi
    return out, row, place


def tiles(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of shared seeds at (doc, item) places: non-overlapping
    (length, doc place, item place), longest first, ties at the earliest places."""
    order = np.lexsort((doc, doc - item))
    doc, item = doc[order], item[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 1) | (np.diff(item) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    heap = [(-(int(n) + k - 1), int(doc[f]), int(item[f])) for f, n in zip(first, count, strict=True)]
    heapq.heapify(heap)
    in_doc, in_item, out = set(), set(), []
    while heap:
        size, d, i = heapq.heappop(heap)
        free = [d + j not in in_doc and i + j not in in_item for j in range(-size)]
        if all(free):
            out.append((-size, d, i))
            in_doc.update(range(d, d - size))
            in_item.update(range(i, i - size))
            continue
        at = 0
        while at < len(free):
            to = at
            while to < len(free) and free[to]:
                to += 1
            if to - at >= k:
                heapq.heappush(heap, (at - to, d + at, i + at))
            at = to + 1
    return out


def most_tokens(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, k: int, span: int) -> np.ndarray:
    """For each stretch of ``span`` doc tokens from ``starts`` on, the item tokens
    that its seeds cover: tiles in it have no more."""
    order = np.lexsort((doc, item))
    doc, item = doc[order], item[order]
    place, first = np.unique(item, return_index=True)
    edges = np.append(first, len(doc))
    until = np.full(len(starts), -1)
    out = np.zeros(len(starts), np.int64)
    for n, at in enumerate(place):
        of = doc[edges[n] : edges[n + 1]]
        nearest = of[np.minimum(np.searchsorted(of, starts), len(of) - 1)]
        held = (nearest >= starts) & (nearest + k <= starts + span)
        out += np.where(held, at + k - np.maximum(until, at), 0)
        until = np.where(held, at + k, until)
    return out


def best_stretch(doc: np.ndarray, item: np.ndarray, k: int, span: int, least: float) -> tuple[int, int, int, int]:
    """(tokens, tiles, first and last doc place + 1) of the stretch of at most
    ``span`` doc tokens whose own tiles have the most tokens, all zero if none has
    ``least``."""
    order = np.argsort(doc, kind="stable")
    doc, item = doc[order], item[order]
    starts = np.unique(doc)
    most = most_tokens(doc, item, starts, k, span)
    best = (0, 0, 0, 0)
    # Stretches that may hold most come first, so few are tiled.
    for n in np.argsort(-most, kind="stable"):
        if most[n] < least or most[n] <= best[0]:
            break
        lo, hi = np.searchsorted(doc, [starts[n], starts[n] + span - k + 1])
        found = _sums(tiles(doc[lo:hi], item[lo:hi], k))
        if found[0] >= least and found[0] > best[0]:
            best = found
    return best


def _sums(found: list[tuple[int, int, int]]) -> tuple[int, int, int, int]:
    """(tokens, tiles, first and last doc place + 1) of all tiles."""
    return sum(t[0] for t in found), len(found), min(t[1] for t in found), max(t[1] + t[0] for t in found)


def _seed_rows(rows: DataFrame, k: int, bits: np.ndarray | None) -> DataFrame:
    """(row_key, row_tag, seed, place, n_tokens) of ``rows`` (row_key, row_tag,
    text); only seeds that ``bits`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else np.unpackbits(bits).view(bool)
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            key, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_key", "row_tag"))
            for lo, hi in row_chunks(bounds):
                part = bounds[lo : hi + 1]
                tokens, counts = token_hashes(data[part[0] : part[-1]], part - part[0])
                seed, row, place = seeds(tokens, counts, k)
                if held is not None:
                    some = held[(seed & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
                    seed, row, place = seed[some], row[some], place[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[lo + row]), pa.array(tag[lo + row]), pa.array(seed.view(np.int64)),
                     pa.array(place), pa.array(np.diff(counts)[row])],
                    names=["row_key", "row_tag", "seed", "place", "n_tokens"],
                )

    return rows.select("row_key", "row_tag", "text").mapInArrow(
        run, "row_key long, row_tag long, seed long, place long, n_tokens long"
    )


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, spread: float = 3.0,
    scattered: float = 0.8,
) -> DataFrame:
    """(row_key, row_tag, doc_id, item_id, item_tokens, matched_tokens, coverage,
    n_tiles, doc_start, doc_end) of each pair of a document and a benchmark
    item whose tiles cover at least ``coverage`` of the item within a stretch of
    ``spread`` times its length, or else at least ``scattered`` of it anywhere; the
    last two are token places in the document.

    Null and empty texts and items of fewer than ``min_match`` tokens match
    nothing; null ids are kept as null; rows that repeat both id and text give
    one pair; an empty table gives no pairs; other columns are ignored."""
    items = benchmark.select("item_id", *row_identity("item_id"), "text").dropDuplicates(["row_key", "row_tag"])
    item_seeds = staged(_seed_rows(items, min_match, None), "item-seeds")
    # At most FILTER_BITS rows reach the driver.
    bit = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")
    set_bits = item_seeds.select(bit).distinct().toArrow()["bit"].to_numpy()
    held = np.zeros(FILTER_BITS, bool)
    held[set_bits] = True
    doc_seeds = _seed_rows(docs.select(*row_identity(), "text"), min_match, np.packbits(held))
    doc_seeds = staged(doc_seeds.drop("n_tokens"), "doc-seeds")
    of_item = item_seeds.select(
        "seed", F.col("row_key").alias("item_key"), F.col("row_tag").alias("item_tag"),
        F.col("place").alias("item_place"), F.col("n_tokens").alias("item_tokens"),
    )
    shared = (
        doc_seeds.join(of_item, "seed")
        .groupBy("row_key", "row_tag", "item_key", "item_tag", "item_tokens")
        # One text against one item: bounded by the text, however common either is.
        .agg(F.collect_set(F.struct("place", "item_place")).alias("hits"))
        # Each seed covers min_match tokens at most.
        .where(F.size("hits") * min_match >= F.lit(min(coverage, scattered)) * F.col("item_tokens"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            hits = batch.column("hits")
            for n, size in enumerate(batch.column("item_tokens").to_pylist()):
                pairs = hits[n].values
                d, i = (pairs.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
                found = best_stretch(d, i, min_match, max(int(spread * size), min_match), coverage * size)
                if not found[0] and len(np.unique(i)) * min_match >= scattered * size:
                    found = _sums(tiles(d, i, min_match))
                    if found[0] < scattered * size:
                        continue
                if found[0]:
                    rows.append((n, found[0], found[0] / size, *found[1:]))
            at = pa.array([r[0] for r in rows], pa.int64())
            kept = [batch.column(c).take(at) for c in ("row_key", "row_tag", "item_key", "item_tag", "item_tokens")]
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            found = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays(kept + found, names=names)

    names = ["row_key", "row_tag", "item_key", "item_tag", "item_tokens", "matched_tokens", "coverage", "n_tiles", "doc_start", "doc_end"]
    kinds = ["long"] * 5 + ["long", "double", "long", "long", "long"]
    found = shared.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    # Ids come back by key and tag: -1 with the tag of a null id is a null id.
    item_ids = items.select(F.col("row_key").alias("item_key"), F.col("row_tag").alias("item_tag"), "item_id")
    ids = docs.select(*row_identity(), "doc_id")
    found = staged(found, "pairs")
    return (
        found.join(item_ids, ["item_key", "item_tag"])
        .join(ids, ["row_key", "row_tag"])
        .select("row_key", "row_tag", "doc_id", "item_id", *names[4:])
        .distinct()  # rows that repeat id and text
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item (see
    ``contaminated_pairs``); all other rows and columns stay as they are."""
    bad = staged(contaminated_pairs(docs, benchmark, **options).select("row_key", "row_tag").distinct(), "contaminated")
    return join_few(whole_rows(docs), bad, ["row_key", "row_tag"], "left_anti").select("row.*")

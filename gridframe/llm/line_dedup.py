"""Lines that other documents hold as well, found through two Bloom filters.

A first pass fills a filter of line keys seen once and one of keys seen twice;
a document counts a key once.  A second pass asks the twice-seen filter: only
lines that it suspects are moved, as 16-byte digests, to be grouped exactly.
The group's smallest doc_id keeps its lines.  A last pass moves the texts of
documents with suspected lines to their lists of dropped keys; all other texts
stay where they are.

The filter has ``bits_per_line`` bits for each line, but never more than
``max_bits``: what is broadcast is bounded.  Beyond that size more lines are
suspected without need and are cleared by the exact grouping.

Keys are told apart by 128-bit BLAKE2 digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import bloom
from gridframe.llm.common import CHUNK_BYTES, byte_table, prefix_hash, row_chunks, row_identity, span_hash, staged, text_buffer

#: Bits that a key sets in its block.
PROBES = 4
#: A key with more than this share of all suspected lines is joined by broadcast: there are at most so many.
HOT_KEYS = 2000
#: The id that rows without one take; it comes after all others.
NO_ID = (1 << 63) - 1

_LOWER = byte_table(71, lower_ascii=True)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def line_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all lines, in order, with blanks at both ends left out.
    Every row has one line more than it has line feeds."""
    feeds = np.flatnonzero(data == 10)
    n_lines = np.searchsorted(feeds, bounds[1:]) - np.searchsorted(feeds, bounds[:-1]) + 1
    row = np.repeat(np.arange(len(n_lines)), n_lines)
    starts = np.sort(np.concatenate([bounds[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([feeds, bounds[1:]]))
    inked = np.flatnonzero(~_BLANK[data])
    if not len(inked):
        return row, starts, starts
    i = np.minimum(np.searchsorted(inked, starts), len(inked) - 1)
    j = np.searchsorted(inked, ends) - 1
    first, last = inked[i], inked[np.maximum(j, 0)] + 1
    full = (first >= starts) & (first < ends)
    return row, np.where(full, first, starts), np.where(full, last, starts)


def line_keys(data: np.ndarray, bounds: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """(row, line, start, end, hash) of the lines whose keys have ``min_chars``
    code points; ``line`` counts all lines of ``data`` from 0."""
    row, start, end = line_spans(data, bounds)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    line = np.flatnonzero(points[end] - points[start] >= min_chars)
    row, start, end = row[line], start[line], end[line]
    out = np.empty(len(line), np.uint64)
    lo = 0
    while lo < len(line):
        if end[lo] - start[lo] > CHUNK_BYTES:
            out[lo] = int.from_bytes(_digest(data, start[lo], end[lo])[:8], "little")
            lo += 1
            continue
        hi = max(int(np.searchsorted(end, start[lo] + CHUNK_BYTES, side="right")), lo + 1)
        at = start[lo]
        prefix = prefix_hash(_LOWER[data[at : end[hi - 1]]])
        out[lo:hi] = span_hash(prefix, start[lo:hi] - at, end[lo:hi] - at)
        lo = hi
    return row, line, start, end, out


def _digest(data: np.ndarray, start: int, end: int) -> bytes:
    return blake2b(data[start:end].tobytes().lower(), digest_size=16).digest()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about CHUNK_BYTES of text, with their bytes and row offsets."""
    for batch in batches:
        _, bounds = text_buffer(batch.column("text"))
        for lo, hi in row_chunks(bounds):
            part = batch.slice(lo, hi - lo)
            yield part, *text_buffer(part.column("text"))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 10, bits_per_line: int = 12, max_bits: int = bloom.MAX_BITS
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row: its text without the
    lines whose key, of at least ``min_chars`` code points, a document with a
    smaller doc_id holds as well.

    Null and empty texts are one empty line.  Lines that repeat within one
    document alone stay; rows with the same doc_id are one document, and rows
    without one are one document that comes after all others (so is the doc_id
    2^63 - 1).  Repeated rows all stay as rows.  An empty table gives no rows;
    other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *row_identity())
    n_lines = rows.agg(
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")
    ).first().n
    blocks = bloom.blocks_for(n_lines or 0, bits_per_line, max_bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = bloom.empty_filter(blocks), bloom.empty_filter(blocks)
        for _, data, bounds in _chunks(batches):
            row, _, _, _, key = line_keys(data, bounds, min_chars)
            order = np.lexsort((row, key))
            row, key = row[order], key[order]
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), bool)  # in another row of this chunk
            again[1:] = ~new_key[1:] & (row[1:] != row[:-1])
            distinct = key[new_key]
            known = bloom.has_keys(once, distinct, 0, blocks, PROBES)
            bloom.add_keys(twice, np.concatenate([key[again], distinct[known]]), 0, blocks, PROBES)
            bloom.add_keys(once, distinct, 0, blocks, PROBES)
        yield from bloom.filled_pages(once, twice)

    filled = rows.select("text").mapInArrow(fill, bloom.PAGES)
    twice = spark.sparkContext.broadcast(bloom.merged_filter(filled, blocks, twice=True))

    def suspected(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        row, line, start, end, key = line_keys(data, bounds, min_chars)
        hit = np.flatnonzero(bloom.has_keys(twice.value, key, 0, blocks, PROBES))
        return row[hit], line[hit], start[hit], end[hit]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in _chunks(batches):
            row, _, start, end = suspected(data, bounds)
            found = sorted({(int(r), _digest(data, s, e)) for r, s, e in zip(row, start, end, strict=True)})
            owner = pa.array([r for r, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(owner) for c in ("id", "row_key", "row_tag")]
                + [pa.array([k for _, k in found], pa.binary())],
                names=["id", "row_key", "row_tag", "key"],
            )

    ids = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row_key", "row_tag", "text")
    suspects = staged(ids.mapInArrow(report, "id long, row_key long, row_tag long, key binary"), "line-suspects")
    repeated = staged(
        suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        .where("first < last").select("key", "first", "n"),
        "line-repeats",
    )
    hot = F.col("n") > F.lit(suspects.count() // HOT_KEYS)
    later = [suspects.join(side, "key").where("id > first").select("row_key", "row_tag", "key")
             for side in (F.broadcast(repeated.where(hot)), repeated.where(~hot))]
    drops = later[0].union(later[1]).groupBy("row_key", "row_tag").agg(F.collect_set("key").alias("keys"))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without a suspected line, as they are."""
        for part, data, bounds in _chunks(batches):
            clean = np.ones(part.num_rows, bool)
            clean[suspected(data, bounds)[0]] = False
            feeds = np.flatnonzero(data == 10)
            n = np.searchsorted(feeds, bounds[1:]) - np.searchsorted(feeds, bounds[:-1]) + 1
            kept = part.column("text").fill_null("")
            whole = pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), np.int64)), kept],
                names=["doc_id", "n_lines", "n_dropped", "kept"],
            )
            yield whole.filter(pa.array(clean))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in _chunks(batches):
            yield part.take(pa.array(np.unique(suspected(data, bounds)[0]), pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in _chunks(batches):
            gone = [set(k or ()) for k in part.column("keys").to_pylist()]
            lines = [(t or "").split("\n") for t in part.column("text").to_pylist()]
            first = np.cumsum([0] + [len(x) for x in lines])
            drop: list[set[int]] = [set() for _ in lines]
            for r, at, s, e in zip(*suspected(data, bounds), strict=True):
                if gone[r] and _digest(data, s, e) in gone[r]:
                    drop[r].add(int(at - first[r]))
            kept = ["\n".join(x for i, x in enumerate(own) if i not in d) for own, d in zip(lines, drop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in lines], pa.int64()),
                 pa.array([len(d) for d in drop], pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept"],
            )

    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    moved = rows.mapInArrow(touched, rows.schema).join(drops, ["row_key", "row_tag"], "left")
    return rows.select("doc_id", "text").mapInArrow(untouched, schema).union(
        moved.select("doc_id", "text", "keys").mapInArrow(cut, schema)
    )

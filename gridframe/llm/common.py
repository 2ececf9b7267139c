"""Shared pieces of the text operators: staged tables, Arrow text access and
vectorised word hashing in numpy.

Hash identity.  Words and byte windows are identified by 64-bit polynomial
hashes over a fixed random byte table, finished with a mixing step; different
strings collide with a probability of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.session import scratch_path

#: Bytes of text that one vectorised step handles at once.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of slim tables that one task may write.
ROWS_PER_PART = 100_000


def staged(df: DataFrame, name: str, rows: int | None = None, batch: int | None = None) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it
    back: lineage is cut, lost executors lose nothing.  Where ``rows``, about
    its size, is known, as many tasks write it as that takes.  ``batch`` bounds
    the rows that pass between the JVM and Python at once, for wide ones."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_PART)
    before = int(spark.conf.get(ARROW_BATCH))
    # 0 and less stand for no bound.
    if batch is not None and not 0 < before <= batch:
        spark.conf.set(ARROW_BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_BATCH, str(before))
    return spark.read.schema(df.schema).parquet(path)


def whole_rows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` as (row, row_key, row_tag, text): all columns in one struct, so
    that no name can clash, and two columns that identify a row's id and text."""
    return rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *row_identity(key), F.col("text").alias("text")
    )


def row_identity(key: str = "doc_id") -> list[Column]:
    """(row_key, row_tag): rows that agree in both share their id and text."""
    tag = F.xxhash64(F.col("text"), F.col("text").isNull(), F.col(key).isNull())
    return [F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("row_key"), tag.alias("row_tag")]


#: Bits of a filter for each key, and of the largest one, whatever the input.
FILTER_BITS = 16
MAX_FILTER_BITS = 1 << 25


def suspected(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``suspected``: true for every row whose ``keys`` (same types
    in both) the table ``few`` has, and for a few others.  A blocked Bloom filter
    of 64-bit words, two bits a key, goes to all tasks; its size is bounded, and
    with more keys than it is made for more rows are suspected."""
    words = 1 + min(few.count() * FILTER_BITS, MAX_FILTER_BITS) // 64
    names = ", ".join(f"`{k}`" for k in keys)
    word = F.expr(f"pmod(xxhash64({names}, 29), {words}L)").alias("filter_word")
    bit = "shiftleft(1L, cast(pmod(xxhash64({}, {}), 64) as int))"
    bits = F.expr(f"{bit.format(names, 31)} | {bit.format(names, 37)}").alias("filter_bits")
    held = few.select(word, bits).groupBy("filter_word").agg(F.bit_or("filter_bits").alias("filter_held"))
    found = rows.select("*", word, bits).join(F.broadcast(held), "filter_word", "left")
    hit = F.coalesce(F.expr("filter_held & filter_bits = filter_bits"), F.lit(False))
    return found.withColumn("suspected", hit).drop("filter_word", "filter_bits", "filter_held")


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows.join(few, keys, how)``, inner, left, left_semi or left_anti, for wide
    or many ``rows`` of which most have no partner: only ``suspected`` ones are
    dealt by key.  ``few`` is a staged table, as it is read twice; the plan is the
    same at any size of it, so no hash table of it has to fit a task."""
    marked = suspected(rows, few, keys)
    held = marked.where("suspected").drop("suspected").join(few.hint("merge"), keys, how)
    if how in ("inner", "left_semi"):
        return held
    return marked.where("not suspected").drop("suspected").unionByName(held, allowMissingColumns=True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (nulls as empty) and its row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_chunks(
    bounds: np.ndarray, max_bytes: int = CHUNK_BYTES, max_rows: int = 1 << 16
) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` and at most ``max_rows`` each; a longer
    row makes its own range."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + max_rows, n)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def byte_table(seed: int, lower_ascii: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; A-Z as a-z on request."""
    t = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    if lower_ascii:
        t[65:91] = t[97:123]
    return t


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INV)):
            p = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                p[filled : 2 * filled] = p[:filled] * np.uint64(pow(base, filled, 1 << 64))
                filled *= 2
            _POWERS[i] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the hash of codes[i:j], times base^i."""
    pw, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * pw[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(
    data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; none crosses a row.

    ``is_word``: a flag for each byte of ``data``; by default every byte but
    space and 0x09 to 0x0D."""
    w = ~_SPACE[data] if is_word is None else is_word
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = bounds[(bounds > 0) & (bounds < len(w))]
    before = np.zeros(len(w), bool)
    before[1:] = w[:-1]
    before[cut] = False
    after = np.zeros(len(w), bool)
    after[:-1] = w[1:]
    after[cut - 1] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


_LOWER = byte_table(17, lower_ascii=True)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (A-Z as a-z) of the words of all rows, and the words before each
    row boundary, so row r has words counts[r]:counts[r + 1].  Works in blocks
    that end at word ends, so memory follows the block and not the text."""
    starts, ends = word_spans(data, bounds)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, side="right"))
        hi = max(hi, lo + 1)
        at = starts[lo]
        prefix = prefix_hash(_LOWER[data[at : ends[hi - 1]]])
        out[lo:hi] = span_hash(prefix, starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return out, np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and their row numbers.  A row
    with fewer than k words, but any, has its whole word sequence as one."""
    n = len(words)
    per_row = np.diff(counts)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(per_row)), per_row)
    h = np.zeros(n, np.uint64)
    place = np.arange(n)
    last = counts[row + 1]
    for j in range(k):
        inside = place + j < last
        step = np.where(inside, words[np.minimum(place + j, n - 1)], np.uint64(0))
        h = np.where(inside, mix64(h * np.uint64(_BASE) + step + np.uint64(j + 1)), h)
    first = counts[row]
    keep = (place + k <= last) | ((last - first < k) & (place == first))
    return h[keep], row[keep]

"""Spelling variants: words one edit apart, found by probing generated edits.

Words and their counts come from all texts.  Their 64-bit hashes fill blocked
Bloom filters, one for each word length, which are broadcast.  Every word's
deletions and its replacements by a later letter are hashed from prefix sums
(an insertion is the deletion of the longer word, an earlier letter the
replacement seen from the other word) and probed in the filter of their length.
Only positives are moved: they join the vocabulary on the hash, which removes
false positives, and the two words are compared at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import bloom
from gridframe.llm.common import byte_table, mix64, powers, staged

#: Letters of a word: A-Z are lowered first, and no others.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
#: Words of at least this length share one filter.
LONG = 48
PROBES = 6
#: Distinct words that a task counts before it passes its counts on.
HELD_WORDS = 1 << 18
#: Edits hashed in one numpy step.
STEP = 1 << 20

_CODES = byte_table(97, lower_ascii=False)


def spelled(run: str, start: int, every: int) -> str:
    """The lowered run; where ``every`` divides its checksum (continued from
    ``start``), less one letter."""
    h = crc32(run.encode(), start)
    if h % every:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, min_chars: int, every: int) -> DataFrame:
    """(word, n) over all texts, words of at least ``min_chars`` letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return batch

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = crc32(f"{'' if i is None else i}:".encode())
                own: Counter[str] = Counter()
                for run, n in Counter(RUN.findall(text.as_py() or "")).items():
                    own[run.encode("latin-1").lower().decode("latin-1")] += n
                for run, n in own.items():
                    word = spelled(run, start, every)
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def same_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, letters) of the words of each length; ``letters`` one row a word."""
    lengths = np.array([len(w) for w in words], np.int64)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        step = max(1, STEP // int(size))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            raw = "".join(words[i] for i in part).encode("latin-1")
            yield part, np.frombuffer(raw, np.uint8).reshape(len(part), int(size))


def prefix_sums(letters: np.ndarray) -> np.ndarray:
    """Sums of letter codes times powers, one column more than letters."""
    n, size = letters.shape
    out = np.zeros((n, size + 1), np.uint64)
    np.cumsum(_CODES[letters] * powers(size)[0], axis=1, out=out[:, 1:])
    return out


def finish(sums: np.ndarray, size: int) -> np.ndarray:
    return mix64(sums + np.uint64(size))


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for at, letters in same_length(words):
        out[at] = finish(prefix_sums(letters)[:, -1], letters.shape[1])
    return out


def edits(letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word, hash, length) of all deletions and of all replacements by a later letter."""
    n, size = letters.shape
    sums = prefix_sums(letters)
    pw, inv = powers(size + 1)
    step = max(1, STEP // n)
    for lo in range(0, size, step):
        hi = min(lo + step, size)
        cut = sums[:, lo:hi] + (sums[:, -1:] - sums[:, lo + 1 : hi + 1]) * inv[1]
        yield np.repeat(np.arange(n), hi - lo), finish(cut.ravel(), size - 1), size - 1
    step = max(1, STEP // (n * len(LETTERS)))
    for lo in range(0, size, step):
        hi = min(lo + step, size)
        own = letters[:, lo:hi, None]
        change = (_CODES[LETTERS][None, None, :] - _CODES[own]) * pw[lo:hi][None, :, None]
        word, place, letter = np.nonzero(LETTERS[None, None, :] > own)
        yield word, finish(sums[word, -1] + change[word, place, letter], size), size


def near_pairs(words: DataFrame, bits_per_word: int, max_bits: int) -> DataFrame:
    """(word, n, other, other_n) for all words of ``words`` (word, n, h, shard)
    that are one edit apart, in both directions."""
    spark = words.sparkSession
    sizes = {r.shard: r.n for r in words.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = min(1.0, max_bits / max(1, total * bits_per_word))
    first, blocks = np.zeros(LONG + 2, np.int64), np.zeros(LONG + 2, np.int64)
    end = 0
    for shard, n in sorted(sizes.items()):
        first[shard], blocks[shard] = end, bloom.blocks_for(int(n * share), bits_per_word, max_bits)
        end += int(blocks[shard])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.empty_filter(end)
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            bloom.add_keys(bits, np.asarray(batch.column("h")).view(np.uint64), first[shard], blocks[shard], PROBES)
        yield from bloom.filled_pages(bits)

    filled = words.select("h", "shard").mapInArrow(fill, bloom.PAGES)
    known = spark.sparkContext.broadcast(bloom.merged_filter(filled, end))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("h"))
            for at, letters in same_length(batch.column("word").to_pylist()):
                for word, key, size in edits(letters):
                    shard = min(size, LONG)
                    if not blocks[shard]:
                        continue
                    hit = np.flatnonzero(bloom.has_keys(known.value, key, first[shard], blocks[shard], PROBES))
                    found = np.unique(np.stack([own[at][word[hit]], key[hit].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["h", "other_h"])

    positives = words.select("word", "h").mapInArrow(probe, "h long, other_h long").distinct()
    mine = words.select("h", "word", "n")
    other = words.select(F.col("h").alias("other_h"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # The hash proposes, the words decide: one edit, and the pair just once.
    pairs = positives.join(other, "other_h").join(mine, "h").where(F.levenshtein("word", "other", 1) == 1)
    once = staged(pairs.select("word", "n", "other", "other_n"), "near-pairs")
    back = once.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    return once.union(back)


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of ``forms`` (word, form) along the forms to
    the last.  Counts at least double on the way, so a path has fewer than 64
    steps, and pointers that jump twice as far each round need six rounds."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    rows = at.count()
    while rows:
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(beyond, "root", "left")
        at = staged(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        if at.where("went").isEmpty():
            break
        at = at.drop("went")
    return at.select("word", "root")


def spelling_variants(
    docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, every: int = 97,
    bits_per_word: int = 16, max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least
    ``min_chars`` letters found ``min_count`` times.

    Null and empty texts hold no words; a row without doc_id hashes with an
    empty one; repeated rows count each; a run of any length is one word.  Near
    words with equal counts tie by code points.  No words give no rows; other
    columns are ignored."""
    counted = count_words(docs, min_chars, every).where(F.col("n") >= min_count)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            shard = np.minimum([len(w) for w in words], LONG).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(word_hashes(words).view(np.int64)), pa.array(shard)],
                names=["word", "n", "h", "shard"],
            )

    words = staged(counted.mapInArrow(hashed, "word string, n long, h long, shard int"), "vocabulary")
    pairs = near_pairs(words, bits_per_word, max_bits)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    chosen = staged(
        pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")).select(
            "word", "n_near",
            F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form")).alias("form"),
            F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow_forms(chosen.where("form is not null"))
    return words.join(chosen, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )

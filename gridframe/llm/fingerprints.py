"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A text's shingles are its runs of five words (words as maximal runs of other
bytes than space and 0x09 to 0x0D, in lower case; a shorter text is one
shingle; a text without words has none).  Its sketch keeps every distinct
shingle hash below a fixed fraction of the hash range.  Because the fraction
is the same for all texts, sketches of parts merge into the sketch of the
whole, and likeness and containment can be estimated between texts of very
unequal length: both sides hold *all* their hashes below the threshold.

A text with fewer than ``floor_size`` hashes below the threshold keeps its
``floor_size`` smallest ones; its own threshold is then the largest it kept.
Two sketches are compared below the smaller of their two thresholds, which
keeps the estimate sound and gives short texts usable sketches.

The text after each in descending ``doc_id`` order is found without a
one-partition window and without moving whole texts twice: ids are ranked on
slim rows (range partitions, then one boundary row for each partition), and a
text then sends its neighbour only its sketch and as long a beginning as the
neighbour's edit needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.session import cut_lineage

#: One in so many shingle hashes is kept.
SCALE = 16
#: The least sketch size of texts that have so many shingles.
FLOOR_SIZE = 64
WORDS = 5

_LOWEST = -(1 << 63)


def sketch(text: Column, scale: int = SCALE, floor_size: int = FLOOR_SIZE, words: int = WORDS) -> Column:
    """Sorted distinct shingle hashes of ``text`` (null as empty)."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+")
    codes = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(
            F.sequence(F.lit(0), n - words),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]),
        )
        return F.when(n == 0, F.array().cast("array<bigint>")).when(
            n < words, F.array(F.xxhash64(h))
        ).otherwise(runs)

    def kept(h: Column) -> Column:
        below = F.array_distinct(F.filter(h, lambda x: x < F.lit(_LOWEST + (1 << 64) // scale)))
        least = F.slice(F.array_sort(F.array_distinct(h)), 1, floor_size)
        return F.when(F.size(below) >= floor_size, F.array_sort(below)).otherwise(least)

    # A one-element array carries each step's value, so it is computed once.
    first = F.transform(F.array(codes), shingles)
    return F.get(F.transform(first, kept), F.lit(0))


def fingerprint(sketch_col: Column) -> Column:
    """The sketch as text: hashes in hexadecimal, joined by a hyphen."""
    return F.array_join(F.transform(sketch_col, lambda x: F.lower(F.hex(x))), "-")


def threshold(sketch_col: Column, scale: int = SCALE, floor_size: int = FLOOR_SIZE) -> Column:
    """The largest hash up to which a sketch holds all hashes of its text."""
    fixed = F.lit(_LOWEST + (1 << 64) // scale - 1).cast("bigint")
    last = F.element_at(sketch_col, -1)
    # Fewer than floor_size hashes: the text has no others at all.
    return F.when(F.size(sketch_col) < floor_size, F.lit((1 << 63) - 1).cast("bigint")).otherwise(
        F.greatest(fixed, last)
    )


def likeness(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches and
    thresholds; two texts without words are alike (1.0)."""
    t = F.least(ta, tb)
    x, y = F.filter(a, lambda v: v <= t), F.filter(b, lambda v: v <= t)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(a == b, F.lit(1.0)).when(union == 0, F.lit(0.0)).otherwise(both / union)


def next_rows(ids: DataFrame) -> DataFrame:
    """For distinct rows (key, tag, absent, n_chars): also ``next_key`` and
    ``next_tag`` of the following row in descending (key, tag) order, rows with
    ``absent`` keys last; the first row follows the last."""
    order = [F.col("absent").asc(), F.col("key").desc(), F.col("tag").desc()]
    spread = ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    spread = cut_lineage(spread)  # range bounds come from sampling; fix them
    within = Window.partitionBy("part").orderBy(*order)
    row = F.struct("key", "tag")
    ranked = spread.withColumn("after", F.lead(row).over(within))
    # One row for each partition, so its own window is small at any input size.
    heads = spread.groupBy("part").agg(F.max_by(row, F.struct(~F.col("absent"), "key", "tag")).alias("head"))
    ahead = Window.orderBy("part")
    everything = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "part", F.coalesce(F.lead("head").over(ahead), F.first("head").over(everything)).alias("wrap")
    )
    after = F.coalesce("after", "wrap")
    return ranked.join(F.broadcast(heads), "part").select(
        "key", "tag", "n_chars", after["key"].alias("next_key"), after["tag"].alias("next_tag")
    )


def fingerprint_documents(docs: DataFrame, scale: int = SCALE, floor_size: int = FLOOR_SIZE) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in which the
    last half of the characters is replaced by the beginning of the next
    document in descending ``doc_id`` order.

    Null texts count as empty.  Rows that repeat both id and text count as one
    document in that order and get equal results; rows that share an id but
    not a text are ordered by a checksum of the text; null ids come last; a
    lone document is its own next; an empty table gives no rows; other columns
    are ignored."""
    absent = F.col("doc_id").isNull()
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"key": F.coalesce("doc_id", F.lit(0)), "tag": F.xxhash64("text", absent)})
    full = base.withColumn("sketch", sketch(F.col("text"), scale, floor_size))
    ids = base.select("key", "tag", absent.alias("absent"), F.char_length("text").alias("n_chars")).distinct()
    # What each row's text must send to the row it follows.
    wants = next_rows(ids).select(
        F.col("next_key").alias("key"), F.col("next_tag").alias("tag"),
        F.col("key").alias("to_key"), F.col("tag").alias("to_tag"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("want"),
    )
    sent = (
        full.join(wants, ["key", "tag"])
        .select(
            F.col("to_key").alias("key"), F.col("to_tag").alias("tag"),
            F.expr("left(text, want)").alias("opening"), F.col("sketch").alias("next_sketch"),
            # With it both uses of `full` read the same columns, so its exchange is made once.
            F.col("doc_id").alias("next_id"),
        )
        .groupBy("key", "tag")  # repeated rows send the same
        .agg(F.first("opening").alias("opening"), F.first("next_sketch").alias("next_sketch"), F.first("next_id").alias("next_id"))
    )
    joined = full.join(sent, ["key", "tag"])
    n = F.char_length("text")
    edited = F.concat(F.expr("left(text, char_length(text) - floor(char_length(text) / 2))"), F.col("opening"))
    done = joined.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", "next_id", edited.alias("edited"))
    done = done.withColumn("edited_sketch", sketch(F.col("edited"), scale, floor_size))
    limit = lambda c: threshold(F.col(c), scale, floor_size)
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), limit("sketch"), limit("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), limit("sketch"), limit("next_sketch")).alias("near_next"),
        "next_id",
    )

"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; a null id does not."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(fold == F.lit(remainder), F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: dict[int, int], max_bytes: int
) -> tuple[list[str], list[int], list[int]]:
    """Texts, labels and ids of at most ``per_class[y]`` labelled documents of
    each class: those whose ids hash lowest among the rows that ``train``
    (over ``doc_id``) allows, with texts of at most ``max_bytes`` bytes; equal
    texts count once.  Null labels, ids and texts take no part; of a repeated
    or contradictory label one row is taken.

    Only ids are ranked, so texts are read once and never shuffled; the list of
    ids that is broadcast has at most the sum of ``per_class`` rows."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
    picked = None
    for y, most in sorted(per_class.items()):
        ids = (
            usable.where(F.col(label) == y)
            .select(F.col("doc_id").alias("picked_id"))
            .distinct()
            .orderBy(F.xxhash64("picked_id"), "picked_id")
            .limit(most)
            .withColumn("picked_label", F.lit(y))
        )
        picked = ids if picked is None else picked.unionByName(ids)
    rows = (
        docs.select("doc_id", "text")
        .where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id"))
        .select("text", "picked_label", "doc_id")
        .toArrow()
    )
    first: dict[str, tuple[int, int]] = {}
    for i, y, text in sorted(
        zip(rows["doc_id"].to_pylist(), rows["picked_label"].to_pylist(), rows["text"].to_pylist(), strict=True)
    ):
        first.setdefault(text, (y, i))
    return list(first), [y for y, _ in first.values()], [i for _, i in first.values()]

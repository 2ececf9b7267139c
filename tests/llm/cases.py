"""Small awkward inputs that every operator and stage must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n_words: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("aeiouthnrsé") for _ in range(r.randint(2, 8))) for _ in range(n_words)]
    return " ".join(words)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    a, b = prose(1, 120), prose(2, 300)
    texts = [
        (0, a), (1, a), (2, a + " one more word"), (3, b), (3, b), (4, None), (5, ""), (6, " \n\t "),
        (7, "Word"), (8, "Two words"), (None, b), (None, None), (9, prose(3, 60_000)), (3, prose(4, 80)),
        (10, "É<|endoftext|>ß 中文 😀 'S'll <|startoftext|>"), (11, prose(5, 90) + " " + prose(6, 90)),
        (12, prose(6, 90) + "\n" + prose(7, 90)), (13, "\x00\x01\x1c x"), (14, "ab " * 700), (15, "ab " * 700 + "c"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src0", None if t is None else len(t))
            for k, (i, t) in enumerate(texts)]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def clashing(spark):
    """Extra columns with names that the operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["row", "row_key", "row_tag", "spans", "left", "key", "tag", "node", "seed", "label", "score", "size", "a.b"]
    return awkward(spark).withColumns({c: F.lit(c) for c in extra})


def plain_rows(df) -> list:
    return sorted(df.collect(), key=repr)

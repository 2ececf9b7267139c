"""Token counts: batches go through Arrow to the tokenizer and only lengths return.

Batches are balanced by bytes, and a long text is cut at safe boundaries: in
front of a single space that stands between two ASCII letters.  There the
byte-level pre-tokenizer always starts a new piece (a space joins the letters
after it, and a run of letters ends before a space), and no special token has
a space, so the parts' counts add up to the count of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text in a call of the tokenizer, and characters after which a text is cut.
BATCH_BYTES = 1 << 19
PART_CHARS = 1 << 16

_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """``text`` cut at the first safe boundary after each ``part_chars``
    characters; a text with no such boundary stays whole."""
    parts, lo = [], 0
    while len(text) - lo > part_chars:
        m = _SAFE.search(text, lo + part_chars)
        if m is None:
            break
        parts.append(text[lo : m.start()])
        lo = m.start()
    parts.append(text[lo:])
    return parts


def byte_batches(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with about ``limit`` bytes each."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and held + size > limit:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def lengths(texts: list[str], path: str) -> np.ndarray:
    """Token counts of ``texts`` by the tokenizer file at ``path``."""
    tok = _tokenizer(path)
    parts, owner = [], []
    for i, text in enumerate(texts):
        for part in safe_parts(text):
            parts.append(part)
            owner.append(i)
    got = np.zeros(len(texts), np.int64)
    for lo, hi in byte_batches([len(p) for p in parts]):
        encoded = tok.encode_batch_fast(parts[lo:hi], add_special_tokens=False)
        np.add.at(got, owner[lo:hi], [len(e) for e in encoded])
    return got


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Special strings inside a text count as the tokenizer's default has them.
    Null and empty texts have no bytes and no tokens; repeated rows and null
    ids are kept; an empty table gives no rows; other columns are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
            n_tokens = lengths(texts, path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(count, schema)

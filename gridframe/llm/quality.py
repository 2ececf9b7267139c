"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all its bytes.  Each byte has
a learned vector; learned filters of ``WIDTH`` bytes run over each chunk at
every byte and are max-pooled; a document's features are the maximum and
the mean of its chunks' pooled values; one hidden layer combines them into one
probability.  The network is fitted by Adam on a bounded sample of labelled
rows (``per_class`` documents of each label, texts of up to ``max_bytes``) and
has a few kilobytes; scoring covers every byte of every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import row_chunks, text_buffer
from gridframe.llm.labelled import in_fold, sample

CHUNK, STEP = 256, 224
VECTOR, WIDTH, FILTERS, HIDDEN = 8, 6, 24, 16
#: Chunks that go through the filters at once.
BLOCK = 512


def chunk_symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts of all rows and their row numbers; each row has one at least."""
    sizes = np.diff(bounds)
    per_row = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    row = np.repeat(np.arange(len(sizes)), per_row)
    first = np.cumsum(per_row) - per_row
    return bounds[row] + (np.arange(len(row)) - first[row]) * STEP, row


def symbols_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) of byte + 1, or 0 beyond the row's end."""
    at = starts[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros(at.shape, np.int16)
    got = data[np.minimum(at, len(data) - 1)].astype(np.int16) + 1
    return np.where(at < ends[:, None], got, np.int16(0))


class ByteConvNet:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "vectors": normal(257, VECTOR, scale=0.5),
            "filters": normal(WIDTH * VECTOR, FILTERS, scale=0.2),
            "shift": np.zeros(FILTERS, np.float32),
            "w1": normal(2 * FILTERS, HIDDEN, scale=0.2),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": normal(HIDDEN, scale=0.3),
            "b2": np.zeros(1, np.float32),
        }

    def pooled(self, symbols: np.ndarray, places: bool = False):
        """Max-pooled filter values of each chunk, and where each maximum is."""
        p, n = self.p, len(symbols)
        cells = p["vectors"][symbols].reshape(n, CHUNK * VECTOR)
        # Every window of WIDTH bytes is a run of WIDTH * VECTOR numbers: one product for all of them.
        windows = np.lib.stride_tricks.sliding_window_view(cells, WIDTH * VECTOR, axis=1)[:, ::VECTOR]
        conv = (windows.reshape(-1, WIDTH * VECTOR) @ p["filters"]).reshape(n, CHUNK - WIDTH + 1, FILTERS)
        top = conv.max(axis=1) + p["shift"]
        return (top, conv.argmax(axis=1)) if places else top

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        hidden = np.tanh(features @ p["w1"] + p["b1"])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -30, 30)))

    def features(self, z: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [np.maximum.reduceat(z, first), np.add.reduceat(z, first) / counts[:, None]], axis=1
        ).astype(np.float32)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, over all its bytes."""
        starts, row = chunk_symbols(data, bounds)
        z = np.empty((len(row), FILTERS), np.float32)
        for lo in range(0, len(row), BLOCK):
            some = slice(lo, lo + BLOCK)
            z[some] = self.pooled(symbols_at(data, starts[some], bounds[row[some] + 1]))
        counts = np.bincount(row, minlength=len(bounds) - 1)
        return self.head(self.features(z, np.cumsum(counts) - counts, counts))[1]

    def gradients(self, symbols: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of documents with ``counts`` chunks each."""
        p, n = self.p, len(y)
        z, place = self.pooled(symbols, places=True)
        first = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(n), counts)
        x = self.features(z, first, counts)
        hidden, prob = self.head(x)
        d = ((prob - y) / n).astype(np.float32)
        g = {"w2": hidden.T @ d, "b2": np.array([d.sum()])}
        dh = d[:, None] * p["w2"] * (1 - hidden**2)
        g |= {"w1": x.T @ dh, "b1": dh.sum(0)}
        dx = dh @ p["w1"].T
        top = z >= x[doc, :FILTERS]
        dz = top * dx[doc, :FILTERS] + dx[doc, FILTERS:] / counts[doc][:, None]
        g["shift"] = dz.sum(0)
        at = place[:, :, None] + np.arange(WIDTH)  # chunks, filters, WIDTH
        held = symbols[np.arange(len(symbols))[:, None, None], at]
        windows = p["vectors"][held].reshape(len(symbols), FILTERS, WIDTH * VECTOR)
        g["filters"] = np.einsum("cf,cfk->kf", dz, windows)
        back = (dz[:, :, None] * p["filters"].T).reshape(-1, VECTOR)
        cell = held.reshape(-1, 1).astype(np.int64) * VECTOR + np.arange(VECTOR)
        g["vectors"] = np.bincount(cell.ravel(), back.ravel(), 257 * VECTOR).reshape(257, VECTOR)
        return g

    def fit(self, texts: list[str], labels: list[int], epochs: int = 12, docs: int = 24, chunks: int = 8) -> None:
        """Adam over the given texts; of a long text each step takes a fresh
        choice of ``chunks`` chunks."""
        r = np.random.default_rng(11)
        data, bounds = text_buffer(pa.array(texts, pa.string()))
        starts, row = chunk_symbols(data, bounds)
        of = np.split(np.arange(len(row)), np.cumsum(np.bincount(row, minlength=len(texts)))[:-1])
        y = np.array(labels, np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps, total = 0, epochs * -(-len(texts) // docs)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), docs):
                picked = order[lo : lo + docs]
                own = [np.sort(r.choice(of[i], min(chunks, len(of[i])), replace=False)) for i in picked]
                c = np.concatenate(own)
                g = self.gradients(
                    symbols_at(data, starts[c], bounds[row[c] + 1]), np.array([len(o) for o in own]), y[picked]
                )
                steps += 1
                rate = 0.01 * min(1, steps / 20) * (1 - 0.9 * steps / total)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    step = m[k] / (1 - 0.9**steps) / (np.sqrt(v[k] / (1 - 0.99**steps)) + 1e-7)
                    self.p[k] = (self.p[k] - rate * step).astype(np.float32)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 3,
    remainder: int = 1,
    per_class: int = 1500,
    max_bytes: int = 1 << 15,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels are learned only from rows outside the held-out fold.  Null and
    empty texts are scored as one empty chunk; null ids are not held out;
    repeated rows get equal scores; where labels hold fewer than two classes
    every score is the one label's value (0.5 with none); an empty table gives
    no rows; other columns take no part."""
    train = ~in_fold(F.col("doc_id"), modulus, remainder)
    texts, y, _ = sample(docs, labels, "quality", train, {0: per_class, 1: per_class}, max_bytes)
    net, constant = ByteConvNet(), None
    if len(set(y)) < 2:
        constant = float(y[0]) if y else 0.5
    else:
        net.fit(texts, y)
        # The sample's classes are balanced; move the odds to those of all labels learned from.
        seen = labels.where(train).agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
        net.p["b2"] += np.float32(np.log(seen[0] / seen[1]) - np.log(sum(y) / (len(y) - sum(y))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            score = np.full(batch.num_rows, constant if constant is not None else 0.0)
            if constant is None:
                for lo, hi in row_chunks(bounds):
                    part = bounds[lo : hi + 1]
                    score[lo:hi] = net.score(data[part[0] : part[-1]], part - part[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score),
                 pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held = in_fold(F.col("doc_id"), modulus, remainder).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )

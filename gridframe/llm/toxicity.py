"""Toxicity from the nearest labelled examples.

Terms are the words of a text and their beginnings of 4, 5, 6 and 8 bytes
(letters only; A-Z and the Latin-1 capitals in lower case).  From a bounded
sample of labelled rows (documented parameters of ``fit_votes``) all terms whose
presence depends on the label clearly (G statistic of ``least_g`` or more) make
up the vocabulary; an example of label 1 that holds none of them adds its own
most telling terms, however rare, so that copies of any example find it.
Document frequencies of these terms are counted over *all*
documents.  Only words that open like a term of the vocabulary are hashed.  A
text's nearest examples by exact TF-IDF cosine come from a block-max inverted
index: examples lie in blocks, each term keeps the largest weight of each block,
and blocks are opened, in growing groups, only while their bounds can still
reach the best examples found so far.  Neighbours vote with weights that fall
with distance, and the neighbours found are returned as evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import (
    CHUNK_BYTES, byte_table, mix64, prefix_hash, row_chunks, span_hash, text_buffer,
)
from gridframe.llm.labelled import in_fold, sample

BEGINNINGS = (4, 5, 6, 8)
BLOCK = 64
#: Blocks of examples that are opened together at first; each further group is so many times larger.
GROUP, GROWTH = 32, 4

_CODES = byte_table(29, lower_ascii=True)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER_TABLE = _LETTER.tobytes()


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows; none crosses a row."""
    letter = np.frombuffer(data.tobytes().translate(_LETTER_TABLE), bool)
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    cut = np.unique(bounds[(bounds > 0) & (bounds < len(letter))])
    cut = cut[letter[cut - 1] & letter[cut]]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def openings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """16 bits of the first four bytes of each word, equal for small and capital
    letters: a word has the same as each of its terms."""
    out = np.zeros(len(starts), np.uint16)
    for j, shift in enumerate((0, 5, 10, 11)):
        at = starts + j
        byte = (data.take(at, mode="clip") & np.uint8(31)).astype(np.uint16)
        out ^= (byte * (at < ends)) << np.uint16(shift)
    return out


def _term_blocks(
    data: np.ndarray, bounds: np.ndarray, opens: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of terms, and row number, start and end of the word of each."""
    starts, ends = letter_runs(data, bounds)
    if opens is not None:
        some = np.flatnonzero(opens.take(openings(data, starts, ends)))
        starts, ends = starts[some], ends[some]
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, side="right")), lo + 1)
        first, last = starts[lo:hi], ends[lo:hi]
        e = np.cumsum(last - first)
        s = e - (last - first)
        piece = data[np.repeat(first - s, last - first) + np.arange(e[-1])]  # the words alone
        capital = np.zeros(len(piece), bool)  # U+00C0 to U+00DE but U+00D7, in UTF-8
        capital[1:] = (piece[:-1] == 0xC3) & (piece[1:] >= 0x80) & (piece[1:] <= 0x9E) & (piece[1:] != 0x97)
        prefix = prefix_hash(_CODES[np.where(capital, piece + np.uint8(32), piece)])
        row = np.searchsorted(bounds, first, side="right") - 1
        yield span_hash(prefix, s, e), row, first, last
        for k in BEGINNINGS:
            longer = np.flatnonzero(e - s > k)
            cut = s[longer]
            yield mix64(span_hash(prefix, cut, cut + k) + np.uint64(k)), row[longer], first[longer], last[longer]
        lo = hi


def term_hashes(
    data: np.ndarray, bounds: np.ndarray, opens: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the terms of all rows with their row numbers, in blocks; with
    ``opens``, a flag for each opening, of the words alone that open so."""
    for h, row, _, _ in _term_blocks(data, bounds, opens):
        yield h, row


class Vocabulary:
    """Sorted term hashes with a filter that most other terms fail, and one of
    openings that most words fail, from ``texts`` that hold all of the terms."""

    def __init__(self, terms: np.ndarray, texts: list[str] | None = None) -> None:
        self.terms = np.sort(terms)
        self._seen = np.zeros(1 << 16, bool)
        self._seen[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        self._opens = None
        if texts is None:
            return
        self._opens = np.zeros(1 << 16, bool)
        data, bounds = text_buffer(pa.array(texts, pa.string()))
        for lo, hi in row_chunks(bounds):
            part = bounds[lo : hi + 1]
            piece = data[part[0] : part[-1]]
            for h, _, s, e in _term_blocks(piece, part - part[0]):
                held = np.flatnonzero(self._find(h)[1])
                self._opens[openings(piece, s[held], e[held])] = True

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash would be among the terms, and whether it is there."""
        if not len(self.terms):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return at, self.terms[at] == h

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, occurrences) of the vocabulary's terms, by row."""
        cells = []
        n = len(self.terms)
        for h, row in term_hashes(data, bounds, self._opens) if n else ():
            some = np.flatnonzero(self._seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            h, row = h[some], row[some]
            at, hit = self._find(h)
            cells.append(row[hit] * n + at[hit])
        cell, count = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
        return cell // max(n, 1), cell % max(n, 1), count


def unlike_texts(texts: list[str], same: int = 10, of: int = 16) -> list[int]:
    """Indexes of texts without the near copies of earlier ones: those that
    share ``same`` of ``of`` word min-hashes with one kept.  Copies would make
    a chance word of their family look telling."""
    kept, sketches, n = [], np.empty((of, len(texts)), np.uint64), 0
    salts = mix64(np.arange(1, of + 1, dtype=np.uint64))
    for i, text in enumerate(texts):
        data, bounds = text_buffer(pa.array([text]))
        words, _ = next(term_hashes(data, bounds), (None, None))
        if words is None:
            kept.append(i)
            continue
        sketch = mix64(np.unique(words)[:, None] ^ salts).min(axis=0)
        if ((sketches[:, :n] == sketch[:, None]).sum(axis=0, dtype=np.int32) >= same).any():
            continue
        sketches[:, n] = sketch
        n += 1
        kept.append(i)
    return kept


def telling_terms(texts: list[str], y: np.ndarray, least_g: float, least_own: int = 8) -> np.ndarray:
    """All terms whose presence depends on the label with a G statistic of
    ``least_g`` or more, and the ``least_own`` most telling terms of each text
    of label 1 that holds none of those (ties: the smaller hash)."""
    data, bounds = text_buffer(pa.array(texts, pa.string()))
    found, seen = [], []
    for lo, hi in row_chunks(bounds):
        part = bounds[lo : hi + 1]
        pairs = [(h, r) for h, r in term_hashes(data[part[0] : part[-1]], part - part[0])]
        h, r = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.uint64),) * 2
        # Each pair of term and text once.
        some, at = np.unique(h, return_inverse=True)
        cell = np.sort(at * (hi - lo) + r.astype(np.int64))
        cell = cell[np.diff(cell, prepend=-1) > 0]
        found.append(some[cell // (hi - lo)])
        seen.append(lo + cell % (hi - lo))
    terms, at = np.unique(np.concatenate(found), return_inverse=True)
    text = np.concatenate(seen)
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    got = np.stack([np.bincount(at, y[text] == c, len(terms)) for c in (0, 1)])
    both, rest = got.sum(0), n[:, None] - got
    g = np.zeros(len(terms))
    for cell, expected in (
        *((got[c], both * n[c] / n.sum()) for c in (0, 1)),
        *((rest[c], (n.sum() - both) * n[c] / n.sum()) for c in (0, 1)),
    ):
        g += np.where(cell > 0, 2 * cell * np.log(np.maximum(cell, 1e-9) / np.maximum(expected, 1e-9)), 0)
    chosen = g >= least_g
    shown = np.zeros(len(texts), bool)
    shown[text[chosen[at]]] = True
    own = np.flatnonzero((~shown & (y == 1))[text])
    own = own[np.lexsort((at[own], -g[at[own]], text[own]))]
    turn = np.arange(len(own)) - np.searchsorted(text[own], text[own])
    chosen[at[own[turn < least_own]]] = True
    return terms[chosen]


class BlockMaxIndex:
    """Exact top-k cosine over example vectors, opened by groups of blocks."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, n_terms: int) -> None:
        self.n_rows, self.n_blocks = n_rows, -(-n_rows // BLOCK)
        self._top = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self._top, (terms, rows // BLOCK), weights)
        order = np.lexsort((rows, terms))
        self._row, self._weight = rows[order], weights[order]
        key = terms[order] * self.n_blocks + rows[order] // BLOCK
        self._edge = np.searchsorted(key, np.arange(n_terms * self.n_blocks + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, best
        first and ties by example number."""
        bound = weights @ self._top[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        best_row, best, lo, size = np.zeros(0, np.int64), np.zeros(0), 0, GROUP
        while lo < len(order):
            blocks = order[lo : lo + size]
            if len(best) == k:
                blocks = blocks[bound[blocks] >= best[-1] - 1e-12]
            if not len(blocks):
                break
            row, value = self._open(terms, weights, blocks)
            if len(value) > k:  # all that tie with the k-th stay
                near = value >= np.partition(value, len(value) - k)[len(value) - k]
                row, value = row[near], value[near]
            row, value = np.concatenate([best_row, row]), np.concatenate([best, value])
            first = np.lexsort((row, -value))[:k]
            best_row, best = row[first], value[first]
            lo, size = lo + size, size * GROWTH
        return best_row, best

    def _open(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of ``blocks`` with a cosine above 0, by number, and their cosines."""
        cell = (terms * self.n_blocks)[:, None] + blocks
        lo = self._edge[cell]
        n = self._edge[cell + 1] - lo
        upto = np.cumsum(n)
        at = np.repeat(lo.ravel() - upto + n.ravel(), n.ravel()) + np.arange(upto[-1])
        # Each example's products are added in the order of the terms.
        cosine = np.bincount(self._row[at], np.repeat(weights, n.sum(axis=1)) * self._weight[at], self.n_rows)
        row = np.flatnonzero(cosine > 0)
        value = np.round(cosine[row], 12)
        return row[value > 0], value[value > 0]


class NeighbourVote:
    """The fitted classifier: vocabulary, weights, index and vote."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, texts: list[str], y: np.ndarray,
                 ids: list[int], k: int, class_size: tuple[int, int]) -> None:
        self.vocabulary, self.idf, self.k = vocabulary, idf, k
        # Sampled classes stand for all labelled rows of theirs.
        share = np.array([max(class_size[c], 1) / max((y == c).sum(), 1) for c in (0, 1)])
        vectors = list(self.vectors(texts))
        order = sorted(range(len(texts)), key=lambda i: (int(y[i]), vectors[i][0].tolist()))
        self.y, self.ids = y[order], np.array(ids, np.int64)[order]
        self.share = share[self.y]
        empty = np.array([not len(vectors[i][0]) for i in order], bool)
        toxic, clean = ((self.share * (empty & (self.y == c))).sum() for c in (1, 0))
        #: The chance of label 1 with no term of the vocabulary, and that of any row.
        self.empty_rate = (toxic + 0.5) / (toxic + clean + 1) if len(y) else 0.5
        self.rate = (class_size[1] + 0.5) / (sum(class_size) + 1)
        rows = np.concatenate([np.full(len(vectors[i][0]), r, np.int64) for r, i in enumerate(order)] or [np.zeros(0, np.int64)])
        terms = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        weights = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        self.index = BlockMaxIndex(rows, terms, weights, max(len(texts), 1), max(len(vocabulary.terms), 1))

    def vectors(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        data, bounds = text_buffer(pa.array(texts, pa.string()))
        for lo, hi in row_chunks(bounds):
            part = bounds[lo : hi + 1]
            yield from self.chunk_vectors(data[part[0] : part[-1]], part - part[0])

    def chunk_vectors(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Unit TF-IDF vectors (terms, weights), one for each row."""
        row, term, count = self.vocabulary.counts(data, bounds)
        weight = (1 + np.log(count)) * self.idf[term] if len(term) else np.zeros(0)
        edge = np.searchsorted(row, np.arange(len(bounds)))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            w = weight[lo:hi]
            yield term[lo:hi], w / np.sqrt((w * w).sum()) if hi > lo else w

    def vote(self, terms: np.ndarray, weights: np.ndarray) -> tuple[float, list[int], list[float]]:
        """Score and evidence: (probability of label 1, examples' ids, cosines)."""
        if not len(terms):
            return float(self.empty_rate), [], []
        row, cosine = self.index.nearest(terms, weights, self.k)
        w = cosine / (1.05 - cosine) * self.share[row] / self.share.min()
        score = ((w * self.y[row]).sum() + self.rate) / (w.sum() + 1)
        return float(score), self.ids[row].tolist(), cosine.tolist()


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term, and how many there are.  Each
    task sends one row for each term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary.terms) + 1, np.int64)
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            held[-1] += batch.num_rows
            for lo, hi in row_chunks(bounds):
                part = bounds[lo : hi + 1]
                _, term, _ = vocabulary.counts(data[part[0] : part[-1]], part - part[0])
                held[:-1] += np.bincount(term, minlength=len(held) - 1)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary.terms) + 1, np.int64)
    for r in rows.collect():  # a row for each term of the vocabulary, and one
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def fit_votes(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0,
    per_class: dict[int, int] | None = None, max_bytes: int = 1 << 15,
    least_g: float = 20.0, k: int = 15,
) -> NeighbourVote:
    """Fit on at most ``per_class`` labelled documents of each class outside the
    held-out fold, with texts of at most ``max_bytes`` bytes."""
    train = ~in_fold(F.col("doc_id"), modulus, remainder)
    texts, y, ids = sample(docs, labels, "toxic", train, per_class or {0: 3000, 1: 2000}, max_bytes)
    kept = unlike_texts(texts)
    texts, ids = [texts[i] for i in kept], [ids[i] for i in kept]
    y = np.array([y[i] for i in kept], np.int64)
    size = labels.where(train).agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    vocabulary = Vocabulary(telling_terms(texts, y, least_g) if len(texts) else np.zeros(0, np.uint64), texts)
    df, n = document_frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 1
    return NeighbourVote(vocabulary, idf, texts, y, ids, k, (size[0], size[1]))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, model: NeighbourVote | None = None,
    modulus: int = 5, remainder: int = 0,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours, cosines) for every row.

    Null and empty texts hold no term and score the chance of label 1 among
    such examples; null ids are not held out; repeated rows get equal scores;
    with no labels every score is 0.5; an empty table gives no rows; labels,
    ids and other columns are no inputs of a score."""
    model = model or fit_votes(docs, labels, modulus, remainder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            votes = []
            for lo, hi in row_chunks(bounds):
                part = bounds[lo : hi + 1]
                votes += [model.vote(t, w) for t, w in model.chunk_vectors(data[part[0] : part[-1]], part - part[0])]
            score = np.array([v[0] for v in votes], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score),
                 pa.array((score >= 0.5).astype(np.int32)),
                 pa.array([v[1] for v in votes], pa.list_(pa.int64())),
                 pa.array([v[2] for v in votes], pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"],
            )

    held = in_fold(F.col("doc_id"), modulus, remainder).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(
        run,
        "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>",
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more (see ``score_toxicity``
    and, for the options, ``fit_votes``); all columns stay."""
    model = fit_votes(docs, labels, **options)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, bounds = text_buffer(text)
        votes = []
        for lo, hi in row_chunks(bounds):
            part = bounds[lo : hi + 1]
            votes += [model.vote(t, w)[0] for t, w in model.chunk_vectors(data[part[0] : part[-1]], part - part[0])]
        return pa.array(votes, pa.float64())

    return docs.where(score(F.col("text")) < 0.5)

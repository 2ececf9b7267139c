import random
import zlib

import numpy as np
import pyarrow as pa

from gridframe.llm import quality, toxicity
from gridframe.llm.common import text_buffer, word_spans

from .cases import DOCS, awkward, awkward_rows, clashing, nothing, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=700):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, r.randint(30, 120)).split()
        bad, junk = r.random() < 0.25, r.random() < 0.3
        if bad:
            for w in r.sample(["blorgface", "snidgeon", "blorghead", "snidgely"], 2):
                words.insert(r.randrange(len(words)), w)
        if junk:
            words = [w.upper() + "!!" for w in words] if r.random() < 0.5 else [w + " |" for w in words]
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, int(not junk), int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), labels


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    for score, column, m, r in ((quality.score_quality, 1, 3, 1), (toxicity.score_toxicity, 2, 5, 0)):
        got = {x.doc_id: x for x in score(docs, labels).collect()}
        assert all(got[t[0]].held_out == (zlib.crc32(str(t[0]).encode()) % m == r) for t in truth)
        held = [t for t in truth if got[t[0]].held_out]
        assert np.mean([got[t[0]].predicted == t[column] for t in held]) > 0.97
        assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())


def test_held_out_labels_are_never_read(spark):
    docs, labels, truth = corpus(spark, 300)
    flipped = spark.createDataFrame(
        [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t)
         for i, q, t in truth], LABELS)
    for score in (quality.score_quality, toxicity.score_toxicity):
        a, b = ({x.doc_id: x.score for x in score(docs, y).collect()} for y in (labels, flipped))
        assert a == b


def test_awkward_rows(spark):
    _, labels, _ = corpus(spark, 60)
    some = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None), (7, 0, 1)], LABELS)
    for score in (quality.score_quality, toxicity.score_toxicity):
        for frame in (awkward(spark), clashing(spark)):
            got = score(frame, some).collect()
            assert len(got) == len(awkward_rows()) and all(0 <= x.score <= 1 for x in got)
            assert not any(x.held_out for x in got if x.doc_id is None)
        assert score(nothing(spark), labels).collect() == []
        none = score(awkward(spark), spark.createDataFrame([], LABELS)).collect()
        assert {x.score for x in none} == {0.5}
    kept = toxicity.remove_toxic(clashing(spark), some.limit(0))
    assert kept.columns == clashing(spark).columns


def test_block_max_search_is_exact():
    r = np.random.default_rng(2)
    n, v = 700, 40
    dense = r.random((n, v)) * (r.random((n, v)) < 0.1)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    rows, terms = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(rows, terms, dense[rows, terms], n, v)
    for q in r.random((50, v)) * (r.random((50, v)) < 0.1):
        t = np.flatnonzero(q)
        if not len(t):
            continue
        w = q[t] / np.linalg.norm(q)
        cosine = np.round(dense[:, t] @ w, 12)
        want = np.lexsort((np.arange(n), -cosine))[:15]
        want = want[cosine[want] > 0]
        got, value = index.nearest(t, w, 15)
        assert np.allclose(value, cosine[want]) and (cosine[got] == cosine[want]).all()


def test_blocks_are_opened_by_groups(monkeypatch):
    r = np.random.default_rng(3)
    n, v = 20_000, 30  # 313 blocks
    dense = r.random((n, v)) * (r.random((n, v)) < 0.2)
    rows, terms = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(rows, terms, dense[rows, terms], n, v)
    opened, one = [], index._open
    monkeypatch.setattr(index, "_open", lambda t, w, blocks: opened.append(len(blocks)) or one(t, w, blocks))
    t, w = np.array([2, 7, 11]), np.array([0.2, 0.5, 0.3])
    got, value = index.nearest(t, w, 15)
    cosine = np.round(dense[:, t] @ w, 12)
    want = np.lexsort((np.arange(n), -cosine))[:15]
    assert np.allclose(value, cosine[want]) and (cosine[got] == cosine[want]).all()
    assert 0 < len(opened) <= 3


def test_words_are_hashed_only_when_they_open_like_a_term(monkeypatch):
    texts = ["Blorgface an É x", "ÉTÉS blorghead", "été an", "Àb ab", "abc", "x÷×y étés"]
    chosen = {"blorgface", "blor", "x", "été", "étés", "àb", "abc"}
    every = np.concatenate([h for h, _ in toxicity.term_hashes(*text_buffer(pa.array(list(chosen))))])
    filtered, plain = toxicity.Vocabulary(np.unique(every), texts + list(chosen)), toxicity.Vocabulary(np.unique(every))
    rows = [*texts, "", None, "BLORGFACE", "blorx", "\x00", "X", "éTÉ", "ab", "", prose(1, 200), "x" * 5000, "xab", "é"]
    rows += [t.swapcase() for t in rows if t]
    data, bounds = text_buffer(pa.array(rows))
    assert all(np.array_equal(a, b) for a, b in zip(filtered.counts(data, bounds), plain.counts(data, bounds), strict=True))
    assert len(plain.counts(data, bounds)[0]) > 30
    spans, one = [], toxicity.span_hash
    monkeypatch.setattr(toxicity, "span_hash", lambda p, s, e: spans.append(len(s)) or one(p, s, e))
    words = text_buffer(pa.array(["quorvex mibbler drantling zigging blorgface " * 1000]))
    assert filtered.counts(*words)[2].max() == 1000
    assert sum(spans) <= 5000  # the word that opens like a term, and its four beginnings


def test_fitted_filter_is_narrow_and_the_stage_keeps_what_scores_low(spark):
    docs, labels, _ = corpus(spark, 300)
    model = toxicity.fit_votes(docs, labels)
    assert len(model.vocabulary.terms) and 0 < model.vocabulary._opens.mean() < 0.05
    low = {x.doc_id for x in toxicity.score_toxicity(docs, labels, model).collect() if x.score < 0.5}
    assert {x.doc_id for x in toxicity.remove_toxic(docs, labels).collect()} == low


def test_letter_runs_end_with_their_rows():
    rows = ["ab", "cd e", "", "", "f", "1g", "h2", "", "éÉ", " ", "x"]
    data, bounds = text_buffer(pa.array(rows))
    for lo in range(len(rows) + 1):
        part = bounds[lo:]
        piece = data[part[0] :]
        want = word_spans(piece, part - part[0], toxicity._LETTER[piece])
        assert all(np.array_equal(a, b) for a, b in zip(toxicity.letter_runs(piece, part - part[0]), want, strict=True))


def test_unlike_texts_by_comparing_all_pairs():
    r = random.Random(9)
    texts = [prose(i, 60) for i in range(60)] + ["", "1 2", "", " "]
    for i in range(60):
        words = texts[i].split()
        for _ in range(r.randint(0, 25)):
            words[r.randrange(len(words))] = prose(r.randrange(10**6), 1)
        texts.append(" ".join(words))
    r.shuffle(texts)
    salts = toxicity.mix64(np.arange(1, 17, dtype=np.uint64))
    kept, sketches = [], []
    for i, text in enumerate(texts):
        words = [h for h, _ in toxicity.term_hashes(*text_buffer(pa.array([text], pa.string())))][:1]
        sketch = toxicity.mix64(words[0][:, None] ^ salts).min(axis=0).tolist() if words else None
        if sketch and any(sum(a == b for a, b in zip(sketch, s, strict=True)) >= 10 for s in sketches):
            continue
        kept.append(i)
        sketches += [sketch] if sketch else []
    assert 64 < len(kept) < len(texts) and toxicity.unlike_texts(texts) == kept


def test_gradients_and_chunks():
    net = quality.ByteConvNet()
    texts = [prose(1, 100), prose(2, 10), ""]
    data, bounds = text_buffer(pa.array(texts))
    starts, row = quality.chunk_symbols(data, bounds)
    for i, t in enumerate(texts):  # every byte is in a chunk
        covered = {p for s in starts[row == i] for p in range(s, s + quality.CHUNK)}
        assert set(range(bounds[i], bounds[i + 1])) <= covered
    symbols, counts, y = quality.symbols_at(data, starts, bounds[row + 1]), np.bincount(row, minlength=3), np.array([1, 0, 1], np.float32)

    def loss():
        first = np.cumsum(counts) - counts
        p = net.head(net.features(net.pooled(symbols), first, counts))[1].astype(float)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(symbols, counts, y)
    for name in ("w1", "w2", "b1", "shift", "filters"):
        flat = net.p[name].reshape(-1)
        for at in (0, len(flat) // 2):
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-2 - g[name].reshape(-1)[at]) < 5e-3


def test_vocabulary_has_no_cap_and_covers_every_toxic_example():
    r = random.Random(5)
    clean = [prose(i, 40) for i in range(300)]
    common = [f"{prose(1000 + i, 30)} {' '.join(f'snid{c}geon' for c in r.sample('abcdefgh', 3))}" for i in range(100)]
    rare = ["quorvex the mibbler"]  # no term of it is telling by itself
    texts, y = clean + common + rare, np.array([0] * 300 + [1] * 101)
    terms = toxicity.telling_terms(texts, y, 20.0)
    vocabulary = toxicity.Vocabulary(terms)
    for text in common + rare:
        assert len(vocabulary.counts(*text_buffer(pa.array([text])))[0])
    # Brute force: each telling term by its own two-by-two table.
    holds = [set() for _ in texts]
    for i, text in enumerate(texts):
        for h, _ in toxicity.term_hashes(*text_buffer(pa.array([text]))):
            holds[i] |= set(h.tolist())
    n = np.array([300, 101])

    def g(term):
        got = np.array([sum(term in holds[i] for i in range(300)), sum(term in holds[i] for i in range(300, 401))], float)
        table = np.stack([got, n - got])
        expected = table.sum(1, keepdims=True) * n / n.sum()
        return 2 * sum(a * np.log(a / e) for a, e in zip(table.ravel(), expected.ravel()) if a > 0)

    every = {t: g(t) for t in set().union(*holds)}
    telling = {t for t, x in every.items() if x >= 20}
    assert telling and not holds[-1] & telling
    own = sorted(holds[-1], key=lambda t: (-round(every[t], 6), t))
    assert set(terms.tolist()) >= telling
    extra = set(terms.tolist()) - telling
    assert extra <= holds[-1] and len(extra) == min(8, len(own))


def test_rare_copy_of_a_toxic_example_finds_it(spark):
    docs, labels, truth = corpus(spark, 300)
    odd = "quorvex mibbler drantling"
    free = [i for i in range(1000, 1050) if zlib.crc32(str(i).encode()) % 5]
    docs = docs.unionByName(spark.createDataFrame([(free[0], odd, None, None, None), (free[1], odd, None, None, None)], DOCS))
    labels = labels.unionByName(spark.createDataFrame([(free[0], 1, 1)], LABELS))
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, labels).where(f"doc_id >= {free[0]}").collect()}
    assert got[free[1]].neighbours == [free[0]] and got[free[1]].predicted == 1

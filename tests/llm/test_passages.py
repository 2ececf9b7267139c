import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridframe.llm import suffix_dedup as sd
from gridframe.llm.common import join_few, suspected
from gridframe.llm.decontaminate import contaminated_pairs, remove_contaminated, tiles
from gridframe.llm.minhash import keep_representatives

from .cases import DOCS, awkward, awkward_rows, clashing, nothing, plain_rows, prose


def brute_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def check_cuts(spark, rows, length=400):
    docs = spark.createDataFrame(rows, DOCS)
    want = Counter()
    for (i, t, *_), spans in zip(rows, brute_spans([r[1] for r in rows], length)):
        raw, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        want[i, len(raw), tuple(spans), hashlib.sha256(kept + raw[at:]).hexdigest()] += 1
    got = sd.cut_repeats(docs, length).collect()
    found = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert found == want


def passages(seed, n):
    r = random.Random(seed)
    shared = [prose(seed + 100 + i, r.randint(60, 200)) for i in range(4)]
    rows = []
    for i in range(n):
        t = prose(seed + 1000 + i, r.randint(5, 120))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, 60)
            t += " " + p[a : len(p) - r.randint(0, 60)] + r.choice(["", " ", "x"]) + prose(r.randint(0, 10**9), r.randint(1, 40))
        rows.append((i, t, None, None, len(t)))
    return rows


def test_cuts_equal_brute_force(spark):
    check_cuts(spark, passages(1, 60))
    check_cuts(spark, awkward_rows())


def test_query_gives_the_text_left(spark, tmp_path):
    """Passages cut at and within characters of two to four bytes."""
    from gridframe.llm.queries import op7_suffix_dedup

    shared = [prose(5, 70), "é" * 3 + prose(6, 150) + "😀" * 2, "".join(chr(0x4E00 + i * 7 % 997) for i in range(200))]
    r = random.Random(9)

    def edge():
        return chr(r.randrange(*r.choice([(0x20, 0x7F), (0xC0, 0x180), (0x4E00, 0x9FA5), (0x1F300, 0x1F600)])))

    rows = [
        (i, "".join(prose(500 + 9 * i + k, 20) + edge() + r.choice(shared) + edge() for k in range(3)) + prose(i, 9))
        for i in range(60)
    ] + [(60, None), (61, ""), (62, shared[0]), (63, prose(63, 200)), (None, shared[1]), (62, shared[0])]
    spark.createDataFrame([(*row, None, None, None) for row in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want, split = Counter(), 0
    for (i, t), spans in zip(rows, brute_spans([row[1] for row in rows], 400)):
        raw, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + raw[at:a], b
            split += any(p < len(raw) and raw[p] & 0xC0 == 0x80 for p in (a, b))
        text = sd._without(t or "", [{"start": a, "end": b} for a, b in spans])
        want[i, len(raw), len(raw) - len(kept + raw[at:]), len(spans), hashlib.sha256(kept + raw[at:]).hexdigest(), text] += 1
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    found = Counter(tuple(row) for row in op7_suffix_dedup(spark, str(tmp_path)).select(*columns).collect())
    assert split > 20
    assert found == want
    assert not [t for *_, t in found if shared[0] in t or shared[2] in t]


def test_hot_passages_go_to_several_shards(spark, monkeypatch):
    """With tiny shards every shared gram is dealt to several and merged."""
    monkeypatch.setattr(sd, "SHARD_SEGMENTS", 3)
    monkeypatch.setattr(sd, "MERGE_DIGESTS", 200)
    check_cuts(spark, passages(2, 50))


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1000)
    text = np.frombuffer(prose(3, 2000).encode(), np.uint8)
    whole = sd.anchored_segments(text, np.array([0, len(text)]), 400)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole["lo"], whole["hi"])])
    assert (starts == np.arange(len(text) - 399)).all()
    assert sd.anchored_segments(text[:399], np.array([0, 399]), 400)["lo"].size == 0


def test_words_take_one_python_worker_a_task(spark, monkeypatch):
    plans = []
    staged = sd.staged

    def noted(df, *args, **more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df, *args, **more)

    monkeypatch.setattr(sd, "staged", noted)
    docs = spark.createDataFrame(passages(4, 30), DOCS)
    assert sd.remove_repeated_words(docs).count() == 30
    assert sum("MapInArrow" in p for p in plans) >= 2
    python = r"(MapInArrow|FlatMapGroupsInPandas|ArrowEvalPython)"
    chained = rf"{python}[^\n]*\n([ :|+-]*(Project|Filter)[^\n]*\n)*[ :|+-]*{python}"
    assert not [p for p in plans if re.search(chained, p)]


def test_segments_hold_little_at_once():
    """4 MB of texts, and one text of 3 MB, whole and by words."""
    many = pa.array([prose(n, 300) for n in range(40)] * 50, pa.string())
    long = pa.array([" ".join(prose(n, 3000) for n in range(20)) * 8], pa.string())
    for texts in (many, long):
        for words in (False, True):
            tracemalloc.start()
            found = sum(len(s["row"]) for s in sd.batch_segments(texts, 408, words))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert found and peak < 64 << 20, (words, peak)


def test_segments_of_words_equal_those_of_their_codes():
    texts = [prose(n, n) for n in range(40, 140)] + ["", None, " ".join("ab" for _ in range(60)), prose(7, 40_000)]
    data, bounds = sd.text_buffer(pa.array(texts, pa.string()))
    codes, counts = sd.word_codes(data, bounds)
    raw = codes.tobytes().decode("ascii")
    coded = pa.array([raw[a * sd.CODE : b * sd.CODE] for a, b in zip(counts[:-1], counts[1:])], pa.string())

    def starts(parts):
        return {(int(r), i) for s in parts for r, a, b in zip(s["row"], s["lo"], s["hi"]) for i in range(a, b + 1)}

    got = starts(sd.batch_segments(pa.array(texts, pa.string()), 408, True))
    assert got == starts(sd.batch_segments(coded, 408, False))
    assert len(got) == sum(max(len(t) - 407, 0) for t in coded.to_pylist())


def test_suffix_order_and_prefixes():
    r = np.random.default_rng(1)
    for text in (r.integers(0, 3, 3000).astype(np.uint8), np.tile(r.integers(0, 9, 37), 40).astype(np.uint8)):
        order, place = sd.suffix_order(text, 400)
        raw = text.tobytes()
        keys = [raw[i : i + 400] for i in order]
        assert keys == sorted(keys) and (order[place] == np.arange(len(text))).all()
        prefix = sd.common_prefixes(text, order, place, 400)
        for p in range(1, len(order), 7):
            a, b = raw[order[p - 1] :], raw[order[p] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert min(prefix[order[p]], 400) == min(n, 400)


def test_remove_repeats_keeps_rows_and_whole_characters(spark):
    frame = clashing(spark)
    got = sd.remove_repeats(frame)
    assert got.columns == frame.columns and sd.remove_repeats(nothing(spark)).collect() == []
    rows = got.collect()
    assert len(rows) == len(awkward_rows())
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert {r.text for r in rows if r.doc_id == 1} == {""} and {r.text for r in rows if r.doc_id == 4} == {None}
    assert sd._without("aéb", [{"start": 0, "end": 2}]) == "éb"
    assert sd._without("aéb", [{"start": 2, "end": 4}]) == "aé"


def test_tiling_is_greedy_and_does_not_overlap():
    def seeds_of(a, b, k):
        return [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k]]

    r = random.Random(2)
    for _ in range(60):
        a = [r.randint(0, 4) for _ in range(40)]
        b = [r.randint(0, 4) for _ in range(20)]
        hits = seeds_of(a, b, 3)
        if not hits:
            continue
        d, i = np.array(hits).T
        got = tiles(d, i, 3)
        used_a, used_b, left = set(), set(), []
        for size, x, y in got:
            assert a[x : x + size] == b[y : y + size] and size >= 3
            assert used_a.isdisjoint(range(x, x + size)) and used_b.isdisjoint(range(y, y + size))
            used_a.update(range(x, x + size))
            used_b.update(range(y, y + size))
            left.append(size)
        assert left == sorted(left, reverse=True)
        # Nothing of min_match tokens is left unmarked on both sides.
        assert not [1 for x, y in hits if used_a.isdisjoint(range(x, x + 3)) and used_b.isdisjoint(range(y, y + 3))]


def test_contaminated_documents_are_found(spark):
    items = [prose(400 + i, 30) for i in range(6)]
    bench = spark.createDataFrame(
        [*enumerate(items), (6, "too few words"), (None, prose(499, 20)), (7, None), (0, items[0])], "item_id long, text string"
    )
    half = items[2].split()
    rows = [
        (0, prose(1, 50) + "\n" + items[0] + " " + prose(2, 50)),
        (1, items[1].upper().replace(" ", ",  ")),
        (2, prose(3, 20) + " " + " ".join(half[15:]) + " and " + " ".join(half[:15]) + " " + prose(4, 20)),  # reordered
        (3, prose(5, 400)),
        (4, "too few words"),
        (5, prose(6, 30) + " " + " ".join(items[3].split()[:10]) + " " + prose(7, 30)),  # a third only
        (6, None), (7, ""), (None, items[4]), (None, items[4]), (8, " ".join(f"{items[5]} {prose(800 + i, 9)}" for i in range(400))),
        (9, prose(499, 20)),
    ]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    got = {(r.doc_id, r.item_id) for r in contaminated_pairs(docs, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (None, 4), (8, 5), (9, None)}
    left = remove_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7]


def test_contamination_takes_awkward_rows(spark):
    bench = spark.createDataFrame([(0, prose(1, 120))], "item_id long, text string")
    for frame in (awkward(spark), clashing(spark)):
        assert sorted(r.doc_id for r in contaminated_pairs(frame, bench).collect()) == [0, 1, 2]
        kept = remove_contaminated(frame, bench)
        assert kept.columns == frame.columns and kept.count() == len(awkward_rows()) - 3
    assert contaminated_pairs(nothing(spark), bench).collect() == []
    assert plain_rows(remove_contaminated(awkward(spark), bench.limit(0))) == plain_rows(awkward(spark))


def test_scattered_parts_and_shuffled_copies_count(spark):
    words = prose(600, 60).split()
    fives = [words[a : a + 5] for a in range(0, 60, 5)]
    far = lambda n: prose(9000 + n, 400)
    thirds = [" ".join(words[a : a + 20]) for a in (40, 0, 20)]
    copies = []  # one third whole, the rest in shuffled fives
    for n in range(3):
        rest = [" ".join(f) for m, f in enumerate(fives) if not 4 * n <= m < 4 * n + 4]
        random.Random(n).shuffle(rest)
        copies.append(" ".join([" ".join(words[20 * n : 20 * n + 20]), *rest]))
    rows = [
        (0, " ".join(f"{far(n)} {t}" for n, t in enumerate(thirds))),
        (1, " ".join(f"{far(n + 3)} {t}" for n, t in enumerate(copies))),
        (2, " ".join(f"{far(n + 6)} {t}" for n, t in enumerate(thirds[:2]))),  # two thirds, far apart
        (3, far(9) + " " + copies[0] + " " + far(10)),
    ]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r for r in contaminated_pairs(docs, bench).collect()}
    assert set(got) == {0, 1, 3}
    assert all(r.coverage == 1.0 for r in got.values())
    assert got[0].doc_end - got[0].doc_start > 180
    assert got[1].doc_end - got[1].doc_start <= 180 and got[3].doc_end - got[3].doc_start <= 180


def shuffled_rows(df):
    """Rows that the exchanges of ``df``'s last run have written."""

    def walk(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        written, children = plan.metrics().get("shuffleRecordsWritten"), plan.children()
        own = written.get().value() if written.isDefined() else 0
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_texts_without_a_partner_are_not_dealt_out(spark):
    shared = prose(1, 60)
    rows = [(i, prose(100 + i, 60) + (" " + shared if i in (7, 150) else "")) for i in range(300)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as for tables beyond it
    try:
        for cut, size in ((sd.remove_repeated_words, 51), (sd.remove_repeats, 300), (sd.cut_repeats, 300)):
            out = cut(docs, size)
            assert shuffled_rows(out) < 60
            assert out.count() == 300
        contaminated = remove_contaminated(docs, spark.createDataFrame([(0, shared)], "item_id long, text string"))
        assert shuffled_rows(contaminated) < 60
        assert contaminated.count() == 298
        twins = docs.unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 1000))
        for repeated in (True, False):
            left = keep_representatives(twins, repeated_rows=repeated)
            assert shuffled_rows(left) < 60
            assert sorted(r.doc_id for r in left.collect()) == list(range(300))
    finally:
        spark.conf.set(name, before)


def test_join_of_few_is_the_join(spark):
    rows = spark.createDataFrame(
        [(i % 40 or None, i % 3, f"t{i}") for i in range(200)] + [(None, None, "n"), (1, 1, "t1")], "a long, b long, text string"
    )
    few = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (39, 0, "z"), (None, 1, "n"), (77, 0, "w")], "a long, b long, v string")
    plain = lambda df: sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert plain(join_few(rows, few, ["a", "b"], how)) == plain(rows.join(few, ["a", "b"], how))
        assert plain(join_few(rows, few.limit(0), ["a", "b"], how)) == plain(rows.join(few.limit(0), ["a", "b"], how))
    many = spark.range(20_000).select(F.col("id").alias("a"))
    marked = suspected(many, many.where("a % 20 = 0"), ["a"])
    assert marked.where("a % 20 = 0 and not suspected").isEmpty()
    assert marked.where("a % 20 <> 0 and suspected").count() < 1000

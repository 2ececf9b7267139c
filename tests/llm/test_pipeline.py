import pytest

import corpus_pipeline

from .cases import DOCS, awkward, awkward_rows, clashing, nothing, prose

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture()
def tables(spark, tmp_path):
    def write(docs, bench=(), labels=()):
        docs.drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(list(labels), LABELS).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_stages_take_planted_cases(spark, tables):
    clean = {i: prose(i, 80) for i in range(1, 200)}
    rows = dict(clean)
    insult = "grubblefink"
    bad = [i for i in range(300, 360)]
    rows |= {i: f"{prose(i, 40)} {insult} {prose(i + 1000, 40)} {insult}" for i in bad}
    rows |= {400: clean[1], 401: clean[2] + " one"}  # exact and near copies
    passage = prose(5000, 120)
    rows |= {410: prose(410, 60) + "\n" + passage + "\n" + prose(411, 60), 412: prose(412, 90) + "\n" + passage}
    item = prose(6000, 30)
    rows |= {420: prose(420, 40) + " " + item + " " + prose(421, 40)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], DOCS)
    labels = [(i, 1, 0) for i in range(1, 150)] + [(i, 1, 1) for i in bad[:50]]
    sf = tables(docs, [(0, item)], labels)
    got = [docs]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, got[-1], sf)
        got.append(df.cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == docs.columns, name
    toxic, near, cut, leaks, coded = got[1:]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(docs) - ids(toxic) == set(bad)
    assert ids(toxic) - ids(near) == {400, 401}
    assert ids(cut) == ids(near)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert passage not in left[410] and passage not in left[412] and prose(411, 60) in left[410]
    assert all(left[i] == clean[i] for i in clean)
    assert ids(cut) - ids(leaks) == {420}
    assert ids(coded) == ids(leaks) and set(clean) <= ids(coded)
    assert corpus_pipeline.run(spark, sf).count() == coded.count()


@pytest.mark.parametrize("make", [awkward, clashing, nothing])
def test_every_stage_takes_awkward_rows(spark, tables, make):
    docs = make(spark)
    sf = tables(docs, [(0, prose(700, 20)), (None, None)], [(0, 1, 0), (3, 0, 1), (7, None, 1)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        n = out.count()
        assert n <= len(awkward_rows())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_repeated_passages_are_judged_by_words(spark):
    short = [" ".join(w[:5] for w in prose(7000 + n, n).split()) for n in (51, 54, 58, 65)]
    assert all(len(p.encode()) < 400 for p in short)
    kept = prose(7100, 50)
    wide = "".join(chr(0x4E00 + (37 * i * i + i) % 5000) for i in range(60))
    rows, edge = {}, {}
    for n, p in enumerate([*short, wide]):
        rows[10 * n] = f"{prose(n, 30)}\n{p} {prose(n + 100, 30)}"
        spaced = p.replace(" ", "  \n")
        rows[10 * n + 1] = f"{prose(n + 200, 9)} {spaced}\n{prose(n + 300, 40)}"
        edge |= {10 * n: (prose(n, 30), prose(n + 100, 30)), 10 * n + 1: (prose(n + 200, 9), prose(n + 300, 40))}
    rows |= {90: prose(90, 20) + " " + kept + " " + prose(91, 20), 91: prose(92, 20) + " " + kept}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], DOCS)
    left = {r.doc_id: r for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert all(r.n_chars == len(r.text) for r in left.values())
    for i, ends in edge.items():
        assert left[i].text.split() == " ".join(ends).split()
    assert all(left[i].text == rows[i] for i in (90, 91))  # 50 words are not over 50


def test_one_row_of_each_group_goes_on_whole(spark):
    """Documents that came in twice, with one id or without any, keep one row and its text."""
    twice, none, near = prose(8000, 120), prose(8001, 130), prose(8002, 140)
    rows = [(1, twice), (1, twice), (1, twice), (None, none), (None, none), (None, near), (None, near + " one"),
            (None, near + " one"), (2, prose(8003, 90)), (2, prose(8004, 90)), (2, prose(8004, 90) + " one"),
            (3, prose(8005, 70)), (None, prose(8005, 70)), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCS)
    near_left = corpus_pipeline.drop_near_duplicates(spark, docs, "").cache()
    cut = corpus_pipeline.cut_repeated_passages(spark, near_left, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in cut) == sorted(
        [(False, 1), (True, 0), (True, 0), (False, 2), (False, 2), (False, 3), (False, 4), (False, 5)])
    texts = [r.text for r in cut]
    assert {twice, none, prose(8003, 90), prose(8005, 70)} <= set(texts)
    assert sum(t in (near, near + " one") for t in texts) == 1
    assert sum(t in (prose(8004, 90), prose(8004, 90) + " one") for t in texts) == 1
    awkward_left = corpus_pipeline.drop_near_duplicates(spark, awkward(spark), "")
    words = [t for t in (r.text for r in awkward_left.collect()) if t and t.split()]
    after = corpus_pipeline.cut_repeated_passages(spark, awkward_left, "").collect()
    assert len(words) == len(set(words)) and all(r.text.split() for r in after if r.text and r.n_chars > 9)
    assert prose(2, 300) in {r.text for r in after}

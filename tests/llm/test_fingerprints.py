import hashlib
import re

from pyspark.sql import functions as F

from gridframe.llm.fingerprints import fingerprint_documents, next_rows, sketch, threshold

from .cases import DOCS, awkward, awkward_rows, clashing, nothing, prose


def shingles(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_and_estimates_against_brute_force(spark):
    base = [prose(20 + i, 40 + 37 * i) for i in range(12)]
    rows = [(3 * i, t, None, None, None) for i, t in enumerate(base)] + [(100, base[-1], None, None, None)]
    d = {r[0]: r[1] for r in rows}
    ids = sorted(d, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    for r in fingerprint_documents(spark.createDataFrame(rows, DOCS).repartition(5)).collect():
        t, n = d[r.doc_id], len(d[r.doc_id]) // 2
        edited = t[: len(t) - n] + d[after[r.doc_id]][:n]
        assert r.next_id == after[r.doc_id] and r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(t), shingles(edited))) < 0.2
        assert abs(r.near_next - jaccard(shingles(t), shingles(d[after[r.doc_id]]))) < 0.05
        if r.doc_id == 100:
            assert r.near_next == 1.0


def test_sketches_merge(spark):
    """Below the fixed fraction the sketch of a union is the union of sketches."""
    a, b = prose(31, 4000), prose(32, 3000)
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string").select(
        *[sketch(F.col(c), 16, 0).alias(c) for c in "abc"], threshold(sketch(F.col("a"), 16, 1), 16, 1).alias("t")
    ).first()
    assert set(row.a) | set(row.b) <= set(row.c) and len(set(row.c) - set(row.a) - set(row.b)) <= 4
    assert abs(len(row.a) - 4000 / 16) < 60 and row.a == sorted(row.a)


def test_awkward_rows(spark):
    for frame in (awkward(spark), clashing(spark)):
        got = fingerprint_documents(frame).collect()
        assert len(got) == len(awkward_rows())
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    of = {}
    for r in got:
        of.setdefault((r.doc_id, r.n_chars), set()).add((r.fingerprint, r.edited_sha256))
    assert all(len(v) == 1 for v in of.values())
    assert fingerprint_documents(nothing(spark)).collect() == []
    assert next_rows(spark.createDataFrame([(1, 2, False, 3)], "key long, tag long, absent boolean, n_chars int")).first().next_key == 1

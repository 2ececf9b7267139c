import zlib
from collections import Counter, defaultdict

from gridframe.llm.sharding import assign_shards, longest_first

from .cases import awkward, awkward_rows, clashing, nothing


def test_longest_first_is_the_greedy_schedule():
    sizes = [(7, "a"), (5, "b"), (5, "c"), (4, "d"), (3, "e")]
    # Loads after each step: 7 0, 7 5, 7 10, 11 10, 11 13.
    assert longest_first(sizes, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def check(rows, texts, n):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return of_text


def test_awkward_rows_and_groups_stay_together(spark):
    texts = [(r[0], r[1]) for r in awkward_rows()]
    of_text = check(assign_shards(awkward(spark), 5).collect(), texts, 5)
    assert sum(len(s) > 1 for s in of_text.values()) <= 1  # null and empty texts look alike here
    check(assign_shards(clashing(spark), 3).collect(), texts, 3)
    assert assign_shards(nothing(spark)).collect() == []


def test_shards_are_near_equal_in_bytes(spark):
    rows = [(i, "x" * (i % 97 + 1) + str(i), None, None, None) for i in range(3000)]
    from .cases import DOCS

    got = assign_shards(spark.createDataFrame(rows, DOCS), 8, grain=50).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in got]
    assert len(loads) == 8 and max(loads) - min(loads) <= 0.03 * max(loads)

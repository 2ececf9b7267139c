"""Near-duplicate groups: fast similarity sketching, banding, exact verification.

Sketch.  Each distinct shingle hash is thrown into one of ``t`` bins in rounds;
a bin keeps the least value of the first round that reached it.  After ``t``
random rounds, round ``t + j`` throws every shingle into bin ``j``, so every
coordinate of every non-empty set is filled; most sets are done after a few
rounds, in which each shingle costs one hash.  Coordinates of two sets agree
with a probability equal to their Jaccard similarity, with Chernoff-like
concentration.

Links.  Sets that share one of ``bands`` keys of ``rows`` coordinates are
candidates: with the defaults a pair at similarity 0.8 is missed with a
probability of (1 - 0.8^5)^40, about 1e-7.  All links are confirmed on the
full sets.

Scale.  Equal sets are one vertex.  Members of a bucket meet in its pivot's
group: the pivot is the member that shares buckets with most others, so most
buckets of one family have the same one and a pair meets once and not in each
bucket it shares.

1. Every member is held against at most ``PIVOTS`` pivots of its buckets.
2. Groups whose members are still in several components are cut into blocks of
   about ``BLOCK`` members of like size, of one component each where it has
   that many; pairs of blocks are dealt to tasks, but for those of one component
   and those whose sizes differ too much.  In a pair of blocks, sketches that
   agree in fewer coordinates than a linked pair's would, by five standard
   deviations (a chance of about 3e-7), rule pairs out first.  Members with a
   possible partner bring their full sets, whose intersections are counted for
   all pairs at once; a pair of blocks returns a forest of the components that its
   links join.

So what is written and shuffled is members and never pairs of members: a group
of n members that nothing links is n / BLOCK times its size.  Comparing them
within tasks still takes the square of n, in operations on whole blocks.
Groups whose members are all connected are left alone, because only components
are asked for.  No group is ever gathered in one task, nothing is capped, and hot
keys are met by joins that Spark splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import (
    join_few, mix64, row_chunks, row_identity, shingle_hashes, staged, text_buffer, whole_rows, word_hashes,
)
from gridframe.llm.components import components

BANDS, ROWS = 40, 5
#: Pivots that a member is held against in the first pass.
PIVOTS = 6
#: Members in a block of the second pass, and bytes of their sets.
BLOCK = 512
BLOCK_BYTES = 1 << 22
#: Members that one shard of pairs of blocks has, and bytes of their sets.
SHARD_ROWS = 4096
SHARD_BYTES = 1 << 24
#: Hashes whose holders are counted at once.
_WIDTH = 1 << 12
#: Rows that go to Python at once: texts, or pairs of sets.
_BATCH = 1000
#: Bytes and rows of text that are sketched at once; a row's sketch has BANDS * ROWS values.
_CHUNK = 1 << 19
_CHUNK_ROWS = 512


def distinct_shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and their bounds by row."""
    words, counts = word_hashes(data, bounds)
    h, row = shingle_hashes(words, counts, k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(bounds)))


def sketches(h: np.ndarray, edge: np.ndarray, t: int) -> np.ndarray:
    """(rows, t) similarity sketches of the sets h[edge[i]:edge[i + 1]]; rows
    with an empty set have no meaning."""
    n = len(edge) - 1
    size = np.diff(edge)
    row = np.repeat(np.arange(n), size)
    full = np.uint64((1 << 64) - 1)
    out = np.full(n * t, full, np.uint64)
    for turn in range(2 * t):
        seed = np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
        g = mix64(h ^ seed)
        if turn < t:
            cell = row * t + ((g >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        else:
            cell = row * t + (turn - t)
        free = out[cell] == full
        thrown = np.full(n * t if turn == 0 else 0, full, np.uint64)
        value = mix64(g + seed)
        if turn == 0:
            np.minimum.at(thrown, cell, value)
            out = thrown
        elif free.any():
            # Bins that an earlier round filled stay as they are.
            np.minimum.at(out, cell[free], value[free])
        open_rows = (out.reshape(n, t) == full).any(axis=1) & (size > 0)
        if not open_rows.any():
            break
        some = open_rows[row]
        h, row = h[some], row[some]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) keys, each over its own coordinates and its number."""
    n, t = sketch.shape
    parts = sketch.reshape(n, bands, t // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for j in range(t // bands):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def packed_sketches(sketch: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate: (rows, 4 * words) integers, in four planes
    of one bit for each coordinate."""
    n, t = sketch.shape
    planes = np.zeros((n, 4, -(-t // 64) * 64), np.uint8)
    for b in range(4):
        planes[:, b, :t] = (sketch >> np.uint64(b)).astype(np.uint8) & 1
    return np.packbits(planes.reshape(n, -1), axis=1).view(np.int64)


def may_link(a: np.ndarray, b: np.ndarray, t: int, similarity: float) -> np.ndarray:
    """Whether packed sketches of ``t`` coordinates, of each row of ``a`` and each
    of ``b``, agree as often as those of a pair of the given similarity do, but
    for five standard deviations."""
    words = -(-t // 64)
    agree = np.full((len(a), len(b)), t - 64 * words, np.int64)
    for w in range(words):
        differ = np.zeros(agree.shape, np.uint64)
        for plane in range(4):
            at = plane * words + w
            differ |= a[:, at, None] ^ b[None, :, at]
        agree += np.bitwise_count(~differ)
    p = similarity + (1 - similarity) / 16
    return agree >= t * p - 5 * (t * p * (1 - p)) ** 0.5


def common_members(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """The number of hashes that each set of ``x`` shares with each one of ``y``."""
    hx, hy = (np.frombuffer(b"".join(s), np.uint64) for s in (x, y))
    rx, ry = (np.repeat(np.arange(len(s)), [len(v) // 8 for v in s]) for s in (x, y))
    shared = np.intersect1d(hx, hy)
    out = np.zeros((len(x), len(y)), np.int64)
    if not len(shared):
        return out
    kept = []
    for h, r in ((hx, rx), (hy, ry)):
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        held = shared[at] == h
        order = np.argsort(at[held], kind="stable")
        kept.append((at[held][order], r[held][order]))
    for lo in range(0, len(shared), _WIDTH):
        sides = []
        for (at, r), n in zip(kept, out.shape, strict=True):
            i, j = np.searchsorted(at, [lo, lo + _WIDTH])
            side = np.zeros((n, min(_WIDTH, len(shared) - lo)), np.float32)
            side[r[i:j], at[i:j] - lo] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same vertices as the links (a, b) do, at most one
    for each vertex."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(vertices))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(vertices))
    return vertices[moved], vertices[root[moved]]


def set_keys(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, from sums over its members."""
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h))])
    b = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(0x5851F42D4C957F2D)))])
    size = np.diff(edge).astype(np.uint64)
    return mix64(mix64(a[edge[1:]] - a[edge[:-1]] + size) ^ (b[edge[1:]] - b[edge[:-1]]))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(row_key, row_tag, doc_id, n_shingles, node, keys, marks) of every row;
    ``node`` identifies the set, null for an empty one; ``marks`` is its packed
    sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            for lo, hi in row_chunks(bounds, _CHUNK, _CHUNK_ROWS):
                part = bounds[lo : hi + 1]
                h, edge = distinct_shingles(data[part[0] : part[-1]], part - part[0], k)
                size = np.diff(edge)
                sketch = sketches(h, edge, bands * rows)
                keys = lists(band_keys(sketch, bands).view(np.int64))
                marks = lists(packed_sketches(sketch))
                empty = size == 0
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("row_key", "row_tag")),
                     batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(size),
                     pa.array(set_keys(h, edge).view(np.int64), mask=empty), keys, marks],
                    names=["row_key", "row_tag", "doc_id", "n_shingles", "node", "keys", "marks"],
                )

    def lists(values: np.ndarray) -> pa.Array:
        n, width = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.ravel()))

    slim = docs.select(*row_identity(), "doc_id", "text")
    return slim.mapInArrow(
        run, "row_key long, row_tag long, doc_id long, n_shingles long, node long, keys array<long>, marks array<long>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, members) for the table ``wanted`` (node, row_key, row_tag): each node's
    sorted shingle hashes as 64-bit integers, from its representative's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            for lo, hi in row_chunks(bounds, _CHUNK, _CHUNK_ROWS):
                part = bounds[lo : hi + 1]
                h, edge = distinct_shingles(data[part[0] : part[-1]], part - part[0], k)
                held = [h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo), pa.array(held, pa.binary())], names=["node", "members"]
                )

    # Rows that repeat id and text would send their set again; one is enough.
    return (
        join_few(docs.select(*row_identity(), "text"), wanted, ["row_key", "row_tag"])
        .select("node", "text")
        .mapInArrow(run, "node long, members binary")
        .dropDuplicates(["node"])
    )


def measured(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, distance, linked) for distinct ``pairs`` (a, b): the exact Jaccard
    distance of the full sets, and whether similarity is at least num / den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance, linked = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                union = len(x) + len(y) - both
                distance.append(1 - both / union)
                linked.append(den * both >= num * union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())],
                names=["a", "b", "distance", "linked"],
            )

    x = sets.withColumnsRenamed({"node": "a", "members": "x"})
    y = sets.withColumnsRenamed({"node": "b", "members": "y"})
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(
        run, "a long, b long, distance double, linked boolean"
    )


def dealt(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rows`` (pivot, n, node, label, size, ...) with (shard, i, j, side): once
    for each pair (i, j) of blocks of their pivot's group that they are in, on
    ``side`` 0 or 1.  Rows of a group that may be linked and have different labels
    meet in one pair at least; ``n`` is the number of rows of the group."""
    # Linked sizes are at most one tier apart; a small group needs none.
    width = math.log(den / num) * (1 + 1e-6) if num < den else 1e-9
    tier = F.when(F.col("n") > BLOCK, F.floor(F.log("size") / width)).otherwise(0).cast("long")
    rows = rows.withColumn("tier", tier)
    kinds = rows.groupBy("pivot", "tier", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("held"))
    # Components that fill blocks have their own, the others share some.
    kinds = staged(kinds.withColumn("own", F.when(F.col("rows") >= BLOCK, F.col("label"))), "kinds")
    parts = F.greatest(F.ceil(F.sum("rows") / BLOCK), F.ceil(F.sum("held") * 8 / BLOCK_BYTES)).cast("int")
    pools = staged(kinds.groupBy("pivot", "tier", "own").agg(parts.alias("parts")), "pools")
    number = F.xxhash64("tier", F.col("own").isNull(), "own", "part")
    blocks = pools.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "pivot", "tier", "own", number.alias("block"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(
        y,
        (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.block") <= F.col("y.block"))
        & (F.abs(F.col("x.tier") - F.col("y.tier")) <= 1)
        & F.coalesce(F.col("x.own") != F.col("y.own"), F.lit(True)),
    ).select(F.col("x.pivot").alias("pivot"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    side = [F.struct(F.col(c).alias("block"), F.lit(k).alias("side")) for k, c in enumerate("ij")]
    sides = pairs.select("pivot", "i", "j", F.explode(
        F.when(F.col("i") == F.col("j"), F.array(side[0])).otherwise(F.array(*side))).alias("s")
    ).select("pivot", "i", "j", "s.block", "s.side")
    own = kinds.select("pivot", "tier", "label", "own").join(
        pools.withColumnsRenamed({"pivot": "p", "tier": "t", "own": "o"}),
        (F.col("pivot") == F.col("p")) & (F.col("tier") == F.col("t")) & F.col("own").eqNullSafe(F.col("o")),
    ).select("pivot", "tier", "label", "own", "parts")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = rows.join(own, ["pivot", "tier", "label"]).withColumn("part", part).withColumn("block", number)
    out = staged(placed.join(sides, ["pivot", "block"]).drop("tier", "own", "parts", "part", "block", "n"), "dealt")
    total = out.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("held")).first()
    shards = 1 + max(total["rows"] // SHARD_ROWS, 8 * total["held"] // SHARD_BYTES)
    return out.withColumn("shard", F.pmod(F.xxhash64("pivot", "i", "j"), F.lit(shards)))


def block_pairs(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """The two sides of each pair of blocks of a shard; one frame twice for a
    block and itself."""
    for (_, i, j), both in pdf.groupby(["pivot", "i", "j"], sort=False):
        if i == j:
            yield both, both
        else:
            second = both["side"].to_numpy() == 1
            yield both[~second], both[second]


def block_links(rows: DataFrame, sets: DataFrame, t: int, num: int, den: int) -> DataFrame:
    """(a, b): labels that links between ``rows`` (pivot, n, node, label, size,
    marks) of one group join."""

    def apart(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        return x["label"].to_numpy()[:, None] != y["label"].to_numpy()[None, :]

    def possible(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows that may be linked with one of another label."""
        out = []
        for x, y in block_pairs(pdf):
            a, b = (np.stack(s["marks"].to_list()).astype(np.int64).view(np.uint64) for s in (x, y)) if len(x) and len(y) else (None, None)
            if a is None:
                continue
            m, n = x["size"].to_numpy()[:, None], y["size"].to_numpy()[None, :]
            some = apart(x, y) & (np.minimum(m, n) * den >= np.maximum(m, n) * num)
            if some.any():
                some &= may_link(a, b, t, num / den)
                out += [x[some.any(axis=1)]] if x is y else [x[some.any(axis=1)], y[some.any(axis=0)]]
        return pd.concat(out)[slim] if out else pdf[slim].iloc[:0]

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for x, y in block_pairs(pdf):
            both = common_members(x["members"].to_list(), y["members"].to_list())
            union = x["size"].to_numpy()[:, None] + y["size"].to_numpy()[None, :] - both
            i, j = np.nonzero(apart(x, y) & (den * both >= num * union))
            out.append(forest(x["label"].to_numpy()[i], y["label"].to_numpy()[j]))
        a, b = (np.concatenate(s) for s in zip(*out, strict=True))
        return pd.DataFrame({"a": a, "b": b})

    slim = ["shard", "pivot", "i", "j", "side", "node", "label", "size"]
    schema = "shard long, pivot long, i long, j long, side int, node long, label long, size long"
    some = staged(dealt(rows, num, den).groupBy("shard").applyInPandas(possible, schema), "possible")
    return join_few(sets, some, ["node"]).groupBy("shard").applyInPandas(linked, "a long, b long")


def _groups(docs: DataFrame, words: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """What ``near_duplicates`` returns, with the columns that identify a row and
    ``label``, which tells components apart; null for a row without words."""
    signed = staged(signatures(docs, words, bands, rows), "signatures", batch=_BATCH)
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "row_tag")
    classes = (
        signed.where("node is not null").groupBy("node")
        .agg(F.min(rep).alias("rep"), F.min("n_shingles").alias("size"), F.any_value(F.struct("keys", "marks")).alias("s"))
        .select("node", "rep.doc_id", "rep.row_key", "rep.row_tag", "size", "s.keys", "s.marks")
    )
    classes = staged(classes, "classes")
    buckets = classes.select(F.explode("keys").alias("key"), "node")
    about = classes.count() * bands // 4
    shared = staged(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared", about)
    seen = staged(join_few(buckets, shared, ["key"]).select("key", "node", "n"), "seen", about)
    # The member with the most company is near the middle of its group, so most
    # of the group is linked with it, if not with one another.
    company = seen.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = seen.join(staged(company, "company", about // bands), "node")
    pivots = staged(
        ranked.groupBy("key").agg(F.max(F.struct("company", "node")).alias("p")).select("key", "p.company", F.col("p.node").alias("pivot")),
        "pivots", about,
    )
    # A pair that shares a bucket shares its pivot.
    members = staged(seen.join(pivots, "key").select("node", "pivot", "company").distinct(), "members", about)
    wanted = members.select("node").distinct().join(classes.select("node", "row_key", "row_tag"), "node")
    sets = staged(full_sets(docs, staged(wanted, "wanted", about // bands), words), "sets", batch=_BATCH)

    # Pass 1: members and pivots; a member has one for each band at most.
    of_member = members.where("node <> pivot").groupBy("node").agg(
        F.array_sort(F.collect_set(F.struct(-F.col("company"), "pivot"))).alias("p"))
    first = of_member.select(F.col("node").alias("a"), F.explode(F.slice("p.pivot", 1, PIVOTS)).alias("b"))
    held = staged(measured(staged(first, "pairs", about), sets, num, den), "measured", about, batch=_BATCH)
    labels = components(held.where("linked"))

    # Vertices without a link are their own labels.
    found = classes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = members.select("pivot", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = staged(placed, "placed", about)
    mixed = placed.groupBy("pivot").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("n"))
    rest = staged(placed.join(mixed.where("l <> m").select("pivot", "n"), "pivot"), "apart", about)
    if not rest.isEmpty():
        # Pass 2: all members of a group that are still apart.
        rest = rest.join(classes.select("node", "size", "marks"), "node")
        again = components(block_links(rest, sets, bands * rows, num, den))
        new = again.select(F.col("node").alias("label"), F.col("label").alias("to"))
        found = found.join(new, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")

    ids = staged(found, "found")
    least = staged(ids.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    of_node = staged(ids.select("node", "label").join(least, "label").select("node", "component_id", "label"), "groups")
    return (
        signed.select("row_key", "row_tag", "doc_id", "n_shingles", "node").join(of_node, "node", "left")
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select(
            "row_key", "row_tag", "doc_id", "n_shingles", "component_id", "label",
            (F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"),
        )
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Two rows are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is at least num / den.  ``component_id`` is the smallest id that
    links reach; a row without words is linked with nothing.  Null texts have
    no words; rows with a null id take part, and a component without any id has
    a null ``component_id`` and keeps all its rows; repeated rows share their
    result; an empty table gives no rows; other columns are ignored."""
    return _groups(docs, words, num, den, bands, rows).drop("row_key", "row_tag", "label")


def keep_representatives(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS,
    repeated_rows: bool = True,
) -> DataFrame:
    """``docs`` with one id and text of each component of ``near_duplicates``:
    the smallest id's, or, where no row has an id, one text's; all columns stay.
    Rows without words all stay.  Rows that repeat both id and text of the row
    kept stay with it, unless ``repeated_rows`` is false: then any one of them
    stays, so that exactly one row of each component is left."""
    id_text = ["row_key", "row_tag"]
    groups = _groups(docs, words, num, den, bands, rows).where("label is not null")
    rep = F.struct(F.col("doc_id").isNull(), "doc_id", *id_text)
    # Equal rows are counted first, so a row that recurs often is one here.
    kinds = staged(groups.groupBy("label", "doc_id", *id_text).agg(F.count(F.lit(1)).alias("n")), "kinds")
    chosen = kinds.groupBy("label").agg(F.min(rep).alias("rep"))
    chosen = staged(chosen.select("rep.row_key", "rep.row_tag"), "representatives")
    gone = kinds.select(*id_text).join(chosen, id_text, "left_anti")
    if repeated_rows:
        return join_few(whole_rows(docs), staged(gone, "near-duplicates"), id_text, "left_anti").select("row.*")
    several = staged(kinds.where("n > 1").select(*id_text).join(chosen, id_text, "left_semi"), "several")
    gone = staged(gone.unionByName(several), "near-duplicates")
    single = join_few(whole_rows(docs), gone, id_text, "left_anti").select("row")
    one = join_few(whole_rows(docs), several, id_text).groupBy(*id_text).agg(F.any_value("row").alias("row")).select("row")
    return single.unionByName(one).select("row.*")

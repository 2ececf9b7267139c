"""Removal of repeated passages: per-shard suffix arrays over anchored windows.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else.  Sorting every suffix of the corpus is not needed for that:

1. *Anchors.*  The anchor of a window of ``length`` bytes is its leftmost
   ``GRAM``-byte gram of least hash.  Equal windows have equal anchors at the
   same place, so a window whose anchor gram occurs once is not repeated.
   Consecutive windows with one anchor form a *segment*: the bytes from the
   first window's start to the last one's end (one anchor for about 150 bytes).
2. *Equal segments.*  If a segment occurs twice, all its windows are repeated;
   if its gram occurs once, none is.  Only segments that occur once although
   their gram recurs, at the edges of repeats, are still open.
3. *Suffix arrays.*  Open segments and one copy of every other segment with
   the same gram go to shards by gram.  A shard sorts all its suffixes by
   Larsson-Sadakane refinement (groups of equal rank are refined by the rank
   ``h`` bytes on, doubling ``h``, and sorted groups are left alone), takes
   the common prefixes of neighbours in Kasai's order (an entry follows from the
   one before it unless the bytes in front differ, so only the others are
   compared) and finds the windows with a common prefix of ``length``.
4. *Merging.*  Segments of a gram with very many are dealt to several shards.
   Each shard gives the digests of its distinct windows as a sorted run, and
   runs are merged by binary search in ranges of digests.

Words.  The form over words puts ``CODE`` bytes of hash for each word, of seven
bits each, and takes windows of that many bytes a word.  Edges of what repeats
are rounded inwards to whole words, so a byte that agrees by chance adds none.
Words are coded and cut into segments by one Python function: two in a row would
take two workers in each task, and workers stay when their tasks end.

The stages before 3 cost a few shuffles of 24 bytes for each 150 bytes of text,
of texts only those that may have an open segment or a span are dealt out;
hot grams are combined before the shuffle or met by joins that Spark splits,
and a shard holds a bounded number of segments at any input size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import (
    byte_table, join_few, mix64, powers, prefix_hash, row_chunks, row_identity, span_hash, staged, suspected,
    text_buffer, whole_rows, word_spans,
)

GRAM = 100
#: Bytes that stand for a word in the form over words.
CODE = 8
#: Bytes of text handled at once: a step holds some ninety times as many.
CHUNK = 1 << 18
#: Window starts handled in one piece of a long text.
PIECE = 1 << 18
#: Segments of a gram in one shard, segments of all grams in a shard that several
#: share, on average, and digests in one merge.
SHARD_SEGMENTS = 2048
SHARED_SEGMENTS = 512
MERGE_DIGESTS = 1 << 16

_CODES = byte_table(41, lower_ascii=False)
_PLACE = np.uint64((1 << 24) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from block prefixes and suffixes."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64((1 << 64) - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored_segments(data: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Segments of all rows: row, first and last window start (from the row's
    start), gram hash and segment hash.  ``data`` has less than 2^24 bytes."""
    none = {k: np.zeros(0, np.uint64 if k in ("gram", "seg") else np.int64) for k in ("row", "lo", "hi", "gram", "seg")}
    if len(data) < length:
        return none
    prefix = prefix_hash(_CODES[data])
    _, inverse = powers(len(prefix))
    n = len(data) - GRAM + 1
    grams = mix64((prefix[GRAM:] - prefix[:-GRAM]) * inverse[:n])
    places = np.arange(n, dtype=np.uint64)
    least = sliding_least((grams & ~_PLACE) | places, length - GRAM + 1)
    anchor = (least & _PLACE).astype(np.int64)
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    if not len(row):
        return none
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + bounds[row]
    anchor = anchor[start]
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    lo, hi = start[first], start[last]
    at = bounds[row[first]]
    return {
        "row": row[first], "lo": lo - at, "hi": hi - at,
        "gram": grams[anchor[first]], "seg": span_hash(prefix, lo, hi + length),
    }


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` sorted by their first ``depth`` bytes at least
    (Larsson-Sadakane refinement), and each suffix's place in that order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    # A group's rank is the place of its last member, as refinement needs it.
    edges = np.append(np.flatnonzero(new)[1:], n) - 1
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(edges, np.diff(np.append(-1, edges)))
    h = 8
    while h < depth:
        size = np.diff(np.append(-1, edges))
        open_group = np.repeat(size > 1, size)
        places = np.flatnonzero(open_group)
        if not len(places):
            break
        suffix = order[places]
        further = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)], -1)
        group = rank[suffix]
        by = np.lexsort((further, group))
        suffix, further, group = suffix[by], further[by], group[by]
        order[places] = suffix
        split = np.zeros(n, bool)
        split[edges] = True
        split[places[:-1]] |= (group[1:] == group[:-1]) & (further[1:] != further[:-1])
        edges = np.flatnonzero(split)
        rank[order] = np.repeat(edges, np.diff(np.append(-1, edges)))
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(text: np.ndarray, order: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix (by start), its common prefix with the suffix before it
    in ``order``, exact up to ``depth``; 0 for the first."""
    n = len(text)
    before = np.where(place > 0, order[np.maximum(place - 1, 0)], -1)
    start = np.arange(n)
    # Kasai: if the bytes in front agree and the neighbours stay neighbours,
    # the entry is the previous one less 1; only the others are compared.
    follows = np.zeros(n, bool)
    inner = start[1:]
    b = before[1:]
    follows[1:] = (b > 0) & (before[:-1] == b - 1) & (text[inner - 1] == text[np.maximum(b - 1, 0)])
    known = np.zeros(n, np.int64)
    some = np.flatnonzero(~follows & (before >= 0))
    longest = np.zeros(len(some), np.int64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    active = np.arange(len(some))
    # Entries that follow others need as many bytes more as lie between them.
    run = np.append(np.flatnonzero(~follows), n)
    extra = np.zeros(n, np.int64)
    extra[run[:-1]] = np.diff(run)
    most = depth + extra[some]
    while len(active):
        i, j = some[active] + longest[active], before[some[active]] + longest[active]
        inside = np.maximum(i, j) < n
        active, i, j = active[inside], i[inside], j[inside]
        same = words[i] == words[j]
        step = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        longest[active] += step
        limit = n - np.maximum(some[active], before[some[active]])
        longest[active] = np.minimum(longest[active], limit)
        active = active[(step == 8) & (longest[active] < most[active])]
    known[some] = longest
    source = np.maximum.accumulate(np.where(follows, -1, start))
    return np.where(follows, np.maximum(known[source] - (start - source), 0), known)


def repeated_in_shard(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment number, window start in it, whether the window occurs again in
    the shard, a number equal for equal windows) of all windows."""
    sizes = np.array([len(s) for s in segments], np.int64)
    # 0xFF is in no UTF-8 text: a window that holds one equals no real window.
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    order, place = suffix_order(text, length)
    prefix = common_prefixes(text, order, place, length)
    by_place = prefix[order]
    twin_before = by_place >= length
    twin_after = np.append(twin_before[1:], False)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    count = sizes - length + 1
    number = np.repeat(np.arange(len(segments)), count)
    start = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
    at = place[first[number] + start]
    kind = np.cumsum(~twin_before)[at]
    return number, start, (twin_before | twin_after)[at], kind


def runs_of(number: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive starts in each segment: (segment, first, last)."""
    if not len(number):
        return number, start, start
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(number)) - 1
    return number[first], start[first], start[last]


def batch_segments(texts: pa.Array, length: int, words: bool) -> Iterator[dict[str, np.ndarray]]:
    """``anchored_segments`` of all rows of ``texts``, of their words' codes where
    ``words`` says so, in parts of about ``CHUNK`` bytes."""
    data, bounds = text_buffer(texts)
    for lo, hi in row_chunks(bounds, CHUNK):
        part = bounds[lo : hi + 1] - bounds[lo]
        text = data[bounds[lo] : bounds[hi]]
        if words:
            text, counts = word_codes(text, part)
            part = counts * CODE
        for at in range(0, max(len(text) if hi == lo + 1 else 1, 1), PIECE):
            if hi == lo + 1:  # a long row goes in pieces of PIECE window starts
                piece = text[at : at + PIECE + length - 1]
                s = anchored_segments(piece, np.array([0, len(piece)]), length)
            else:
                s = anchored_segments(text, part, length)
            yield s | {"row": s["row"] + lo, "lo": s["lo"] + at, "hi": s["hi"] + at}


def _segments(texts: DataFrame, length: int, words: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_key", "row_tag"))
            for s in batch_segments(batch.column("text"), length, words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[s["row"]]), pa.array(tag[s["row"]]), pa.array(s["lo"]), pa.array(s["hi"]),
                     pa.array(s["gram"].view(np.int64)), pa.array(s["seg"].view(np.int64))],
                    names=["row_key", "row_tag", "lo", "hi", "gram", "seg"],
                )

    return texts.mapInArrow(run, "row_key long, row_tag long, lo long, hi long, gram long, seg long")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(row_key, row_tag, spans) of every text that holds a repeated string of
    ``length`` bytes; ``spans`` are the maximal removed runs [start, end)."""
    texts = docs.select(*row_identity(), "text")
    return _repeated(texts, _segments(texts, length), length)


def _repeated(
    texts: DataFrame, found: DataFrame, length: int, form: Callable[[DataFrame], DataFrame] = lambda texts: texts
) -> DataFrame:
    """What ``repeated_spans`` returns, for ``texts`` (row_key, row_tag, text)
    and all segments ``found`` of their ``form``."""
    recurring = staged(
        found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams"
    )
    held = staged(join_few(found, recurring, ["gram"], "left_semi"), "segments")
    rep = F.min(F.struct("row_key", "row_tag", "lo", "hi")).alias("rep")
    kinds = staged(held.groupBy("gram", "seg").agg(F.count(F.lit(1)).alias("n"), rep), "kinds")
    several = kinds.groupBy("gram").agg(
        F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("open")
    ).where("kinds > 1 and open > 0")
    several = staged(several, "several")
    total = several.agg(F.sum("kinds")).first()[0] or 0
    shards = max(1, -(-total // SHARED_SEGMENTS))
    chosen = kinds.join(several, "gram").select(
        "gram", "seg", (F.col("n") == 1).alias("open"), "rep.*",
        F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"),
        F.ceil(F.col("kinds") / SHARD_SEGMENTS).cast("int").alias("parts"),
    )
    chosen = staged(chosen, "chosen")
    body = F.expr(f"substring(cast(text as binary), cast(lo + 1 as int), cast(hi - lo + {length} as int))")
    # Rows that repeat id and text give one segment again: one of them is taken.
    some = suspected(texts, chosen, ["row_key", "row_tag"]).where("suspected").drop("suspected")
    texts_of = form(some).join(chosen.hint("merge"), ["row_key", "row_tag"]).select(
        "gram", "seg", "open", "row_key", "row_tag", "lo", body.alias("body"),
        F.when(F.col("parts") > 1, F.pmod(F.xxhash64("seg", F.lit(1)), F.col("parts"))).otherwise(F.lit(0)).alias("part"),
        # Grams with several parts have their own shards.
        F.when(F.col("parts") > 1, F.xxhash64("gram")).otherwise(F.col("shard")).alias("shard"),
        (F.col("parts") > 1).alias("hot"), "parts",
    )

    per_shard, per_merge = SHARD_SEGMENTS, MERGE_DIGESTS

    def shard_windows(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of repeated windows; of hot grams also, for each range of
        digests, the sorted run of its distinct windows' digests, with the places
        of those that are open."""
        pdf = pdf.drop_duplicates(["gram", "seg"]).sort_values(["gram", "seg"], ignore_index=True)
        number, start, twice, kind = repeated_in_shard(pdf["body"].tolist(), length)
        opened = pdf["open"].to_numpy()
        some = twice & opened[number]
        n, a, b = runs_of(number[some], start[some])
        key, tag, lo = (pdf[c].to_numpy() for c in ("row_key", "row_tag", "lo"))
        out = [pd.DataFrame({
            "row_key": key[n], "row_tag": tag[n], "lo": lo[n] + a, "hi": lo[n] + b,
            "gram": 0, "range": -1, "digests": None, "places": None,
        })]
        if pdf["hot"].any():
            # One window of each kind speaks for it elsewhere; open ones without a twin here ask.
            left = (opened[number] & ~twice) | ~pd.Series(kind).duplicated().to_numpy()
            n, a = number[left], start[left]
            digest = np.empty(len(n), np.int64)
            for i in np.unique(n):
                prefix = prefix_hash(_CODES[np.frombuffer(pdf["body"][i], np.uint8)])
                mine = n == i
                digest[mine] = span_hash(prefix, a[mine], a[mine] + length).view(np.int64)
            gram, parts = pdf["gram"].to_numpy()[n], pdf["parts"].to_numpy()[n]
            ranges = -(-parts * per_shard * 300 // per_merge)
            of_range = (digest >> 20) % ranges
            order = np.lexsort((digest, of_range, gram))
            n, a, digest, gram, of_range = (x[order] for x in (n, a, digest, gram, of_range))
            # A window that is not open only tells that it exists.
            places = np.stack([key[n], tag[n], np.where(opened[n], lo[n] + a, -1)], axis=1)
            edges = np.flatnonzero((np.diff(gram, prepend=gram[:1] - 1) != 0) | (np.diff(of_range, prepend=-1) != 0))
            bounds = list(zip(edges, np.append(edges[1:], len(gram)), strict=True))
            out.append(pd.DataFrame({
                "row_key": 0, "row_tag": 0, "lo": 0, "hi": 0, "gram": gram[edges], "range": of_range[edges],
                "digests": [digest[x:y].tobytes() for x, y in bounds],
                "places": [places[x:y].tobytes() for x, y in bounds],
            }))
        return pd.concat(out, ignore_index=True)

    windows = staged(
        texts_of.groupBy("shard", "part").applyInPandas(
            shard_windows,
            "row_key long, row_tag long, lo long, hi long, gram long, range long, digests binary, places binary",
        ),
        "windows",
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Windows whose digest other shards have as well: each shard's sorted
        run is searched in the merged run of all."""
        runs = [np.frombuffer(d, np.int64) for d in pdf["digests"]]
        merged = np.sort(np.concatenate([np.unique(r) for r in runs]))
        own = np.concatenate(runs)
        place = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 3) for p in pdf["places"]])
        holders = np.searchsorted(merged, own, side="right") - np.searchsorted(merged, own, side="left")
        place = place[(holders > 1) & (place[:, 2] >= 0)]
        place = place[np.lexsort((place[:, 2], place[:, 1], place[:, 0]))]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:, :2] != place[:-1, :2]).any(axis=1) | (place[1:, 2] > place[:-1, 2] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1 if len(place) else first
        return pd.DataFrame({
            "row_key": place[first, 0], "row_tag": place[first, 1], "lo": place[first, 2], "hi": place[last, 2]
        })

    # Digests are dealt by gram and range, so a merge has a bounded share of a hot gram.
    merged = (
        windows.where("range >= 0").groupBy("gram", "range")
        .applyInPandas(merge, "row_key long, row_tag long, lo long, hi long")
    )
    same = held.join(kinds.where("n > 1").select("gram", "seg"), ["gram", "seg"], "left_semi")
    columns = ["row_key", "row_tag", "lo", "hi"]
    every = same.select(*columns).unionByName(windows.where("range < 0").select(*columns)).unionByName(merged)

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for runs in batch.column("runs").to_pylist():
                out: list[list[int]] = []
                for run in sorted((r["lo"], r["hi"] + length) for r in runs):
                    if out and run[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], run[1])
                    else:
                        out.append(list(run))
                spans.append([{"start": a, "end": b} for a, b in out])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("row_tag"), pa.array(spans, kind)],
                names=["row_key", "row_tag", "spans"],
            )

    # A text's runs are bounded by its own length; repeated rows add none.
    lists = every.groupBy("row_key", "row_tag").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    return lists.mapInArrow(
        join_runs, "row_key long, row_tag long, spans array<struct<start: bigint, end: bigint>>"
    )


def cut_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, text) of every row: ``spans`` are the
    maximal runs [start, end) of bytes (UTF-8) that repeated strings of ``length``
    bytes cover, ``kept`` the other bytes in order, ``text`` the characters that
    do not lie wholly in a span.

    Null texts count as empty.  Rows that repeat both id and text are copies
    of one another like any others.  Null ids are kept.  Texts shorter than
    ``length`` have no spans.  Other columns are ignored; an empty table gives
    no rows."""
    spans = staged(repeated_spans(docs, length), "spans")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    # The bytes between spans, in order.
    gaps = F.expr(
        "transform(sequence(0, size(spans)), i -> struct("
        "if(i = 0, 0L, spans[i - 1].end) as a, if(i = size(spans), n_bytes, get(spans, i).start) as b))"
    )
    cut = F.expr(
        "if(size(spans) = 0, raw, aggregate(gaps, cast('' as binary), (acc, g) -> "
        "concat(acc, substring(raw, cast(g.a + 1 as int), cast(g.b - g.a as int)))))"
    )
    # The same in whole characters: a gap that starts or ends within one is widened to its edge.
    inside = "substring(raw, cast({} + 1 as int), 1) between X'80' and X'BF'"
    steps = "if(not {}, 0, if(not {}, 1, if(not {}, 2, 3)))"
    back = steps.format(*(inside.format(f"g.a - {i}") for i in range(3)))
    ahead = steps.format(*(inside.format(f"g.b + {i}") for i in range(3)))
    whole = F.expr(
        f"if(size(spans) = 0, cast(raw as string), concat_ws('', transform(transform(gaps, (g, i) -> struct("
        f"if(i = 0, 0L, g.a - {back}) as a, if(i = size(spans), n_bytes, g.b + {ahead}) as b)), "
        "g -> cast(substring(raw, cast(g.a + 1 as int), cast(g.b - g.a as int)) as string))))"
    )
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return (
        join_few(docs.select("doc_id", *row_identity(), raw), spans, ["row_key", "row_tag"], "left")
        .withColumns({"spans": F.coalesce("spans", none), "n_bytes": F.octet_length("raw").cast("long")})
        .withColumn("gaps", gaps)
        .select("doc_id", "n_bytes", "spans", cut.alias("kept"), whole.alias("text"))
    )


def _without(text: str, spans: list[dict[str, int]]) -> str:
    """``text`` without the characters that lie wholly in a span of its bytes."""
    raw, kept, at = text.encode(), [], 0
    for span in spans:
        a, b = span["start"], span["end"]
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


def text_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows: runs between white space, and
    of U+3000 to U+9FFF, which is written without any, each character alone."""
    starts, ends = word_spans(data, bounds)
    lead = (data >= 0xE3) & (data <= 0xE9)
    if not lead.any():
        return starts, ends
    at = np.flatnonzero(lead)
    first = np.unique(np.concatenate([starts, at, at + 3]))
    first = first[np.isin(first, ends, invert=True) | np.isin(first, starts)]
    # A word ends where the next one starts, or where its run does.
    run = ends[np.searchsorted(ends, first, side="right")]
    return first, np.minimum(run, np.append(first[1:], len(data)))


def word_codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``CODE`` bytes of hash for each word of all rows, and the words before
    each row boundary."""
    starts, ends = text_words(data, bounds)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + CHUNK, side="right")), lo + 1)
        at = starts[lo]
        prefix = prefix_hash(_CODES[data[at : ends[hi - 1]]])
        out[lo:hi] = span_hash(prefix, starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    # Seven bits a byte: a text like any other, without the byte between segments.
    return (out & np.uint64(0x7F7F7F7F7F7F7F7F)).view(np.uint8), np.searchsorted(starts, bounds)


def _coded(texts: DataFrame) -> DataFrame:
    """``texts`` (row_key, row_tag, text) with the words' codes for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffer(batch.column("text"))
            for lo, hi in row_chunks(bounds, CHUNK):
                part = bounds[lo : hi + 1]
                codes, counts = word_codes(data[part[0] : part[-1]], part - part[0])
                raw = codes.tobytes()
                text = [raw[a * CODE : b * CODE].decode("ascii") for a, b in zip(counts[:-1], counts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("row_key", "row_tag")), pa.array(text, pa.string())],
                    names=["row_key", "row_tag", "text"],
                )

    return texts.mapInArrow(run, "row_key long, row_tag long, text string")


def _without_words(text: str, spans: list[dict[str, int]], words: int) -> str:
    """``text`` without the words that lie wholly in a span of their codes."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = text_words(data, np.array([0, len(data)]))
    whole = [(-(-s["start"] // CODE), s["end"] // CODE) for s in spans]
    return _without(text, [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in whole if b - a >= words])


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with the repeated strings of ``length`` bytes cut out of
    ``text``, in whole characters, and ``n_chars``, where there is such a
    column, set to what is left; all rows and other columns stay.  A text that
    repeats cover wholly becomes empty; null and empty texts stay as they are."""
    return _cut(docs, repeated_spans(docs, length), _without)


def remove_repeated_words(docs: DataFrame, words: int = 51) -> DataFrame:
    """``docs`` with every run of ``words`` words that also starts anywhere else
    cut out of ``text``, from its first word's start to its last one's end, as
    in ``remove_repeats``.  Words are compared by their bytes, whatever white
    space is between them; see ``text_words`` for what is one."""
    texts = docs.select(*row_identity(), "text")
    spans = _repeated(texts, _segments(texts, words * CODE, words=True), words * CODE, form=_coded)
    return _cut(docs, spans, lambda text, found: _without_words(text, found, words))


def _cut(docs: DataFrame, spans: DataFrame, without: Callable[[str, list[dict[str, int]]], str]) -> DataFrame:
    """``docs`` with ``without(text, spans)`` for the texts that have ``spans``."""

    @F.arrow_udf("string")
    def left(text: pa.Array, spans: pa.Array) -> pa.Array:
        both = zip(text.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([t if s is None else without(t, s) for t, s in both], pa.string())

    spans = staged(spans, "spans")
    rows = suspected(whole_rows(docs).drop("text"), spans, ["row_key", "row_tag"])
    whole = rows.where("not suspected").select("row.*")
    text = F.col("left")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length(text).cast("long"))
    cut = (
        rows.where("suspected").join(spans.hint("merge"), ["row_key", "row_tag"], "left")
        .withColumn("left", left("row.text", "spans"))
        .select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    )
    return whole.unionByName(cut)

"""Exact BPE encoding by backtracking, and decoding by an offset table.

A word is scanned once by an Aho-Corasick automaton over all vocabulary
tokens, which gives, for each position, the tokens that start there.  The
encoder then takes the longest token at each position; a token may follow the
one before it only if merging would not have joined symbols across their
border (the pair-compatibility test).  Where no token fits, it goes back one
token and tries the next shorter; a position found to be a dead end is never
tried again, so the work is linear in the word.  The result equals that of
applying all merges in rank order.

Symbols.  Tokens are written over byte characters; the end-of-word suffix is
one private character.  Symbols that no merge makes have indexes below
``n_base``; the result of merge r has index n_base + r, so a smaller index is
an earlier merge.  Both parts of a token are kept, which lets the test undo
merges from the latest on.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridframe.llm.token_counts import safe_parts

_END = "\ue000"

#: Distinct words in one generation of a task's word store, which keeps two.
WORD_STORE = 1 << 18
#: Answers of the pair table that are kept.
PAIR_STORE = 1 << 20
#: Bytes of results in one Arrow batch.
OUT_BYTES = 1 << 22
#: Tokens decoded in one step.
DECODE_TOKENS = 1 << 18


def byte_characters() -> str:
    """The printable character that stands for each byte in a byte-level
    vocabulary: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(free)) for b in range(256))


class _WordStore(dict):
    """word -> code, filled on demand.  When a generation is full it becomes
    the old one; words asked for again move to the new one."""

    def __init__(self, code) -> None:
        super().__init__()
        self._code = code
        self._old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_STORE:
            self._old = dict(self)
            self.clear()
        code = self._old.get(word)
        if code is None:
            code = self._code(word)
        self[word] = code
        return code


class BpeCodec:
    """Encoder and decoder of one word-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}

        def symbol(token: str) -> str:
            return token.removesuffix(suffix) + _END if token.endswith(suffix) else token

        made = [(symbol(a), symbol(b)) for a, b in model["merges"]]
        joined = [a + b for a, b in made]
        if len(set(joined)) < len(joined):
            raise ValueError("two merges make the same token")
        results = set(joined)
        base = [s for t in vocab if (s := symbol(t)) not in results and t not in self._special]
        index = {s: i for i, s in enumerate(base)} | {s: len(base) + r for r, s in enumerate(joined)}
        chars = byte_characters()
        if not all(c in index and c + _END in index for c in chars):
            raise ValueError("the vocabulary lacks a byte")
        self._chars, self._end, self._symbols = chars, _END, index
        self._n_base = len(base)
        self._left = [-1] * len(base) + [index[a] for a, _ in made]
        self._right = [-1] * len(base) + [index[b] for _, b in made]
        self._merge = {(index[a], index[b]): len(base) + r for r, (a, b) in enumerate(made)}
        self._id = [0] * len(index)
        for token, i in vocab.items():
            if token not in self._special:
                self._id[index[symbol(token)]] = i
        self._length = [0] * len(index)
        self._fits: dict[tuple[int, int], bool] = {}
        sound = [True] * len(index)  # tokens that merging can arrive at
        self._scan = ahocorasick.Automaton()
        for s, i in index.items():
            self._length[i] = len(s)
            if i >= self._n_base:
                a, b = self._left[i], self._right[i]
                sound[i] = sound[a] and sound[b] and self._compatible(a, b, i)
            if sound[i]:
                self._scan.add_word(s, i)
        self._scan.make_automaton()
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self._special.items()}
        pieces = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self._offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self._blob = np.frombuffer(b"".join(pieces), np.uint8)
        self._words = _WordStore(self.word_code)
        self._split = regex.compile("|".join(map(regex.escape, self._special))) if self._special else None
        # The vocabulary file's own pre-tokenizer pattern (fixed value), its \\s as
        # White_Space and letters tried first.
        self._word = regex.compile(
            r"\p{L}+|\p{N}|'s|'t|'re|'ve|'m|'ll|'d|[^\p{White_Space}\p{L}\p{N}]+"
        )

    def _compatible(self, left: int, right: int, limit: int) -> bool:
        """Whether merging leaves the border of ``left`` and ``right`` alone:
        merges are undone latest first, and no pair at the border may merge
        before the merge that has just been undone."""
        while True:
            joint = self._merge.get((left, right))
            if joint is not None and joint < limit:
                return False
            if left < self._n_base and right < self._n_base:
                return True
            if left > right:
                limit, left = left, self._right[left]
            else:  # at equal rank the pair further left merges first
                limit, right = right + 1, self._left[right]

    def _may_follow(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= PAIR_STORE:
                self._fits.clear()
            known = self._fits[left, right] = self._compatible(left, right, 1 << 60)
        return known

    def _tokens(self, symbols: str) -> list[int]:
        n, length, fits = len(symbols), self._length, self._fits
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, token in self._scan.iter(symbols):  # the shorter of a start come first
            starts[end + 1 - length[token]].append(token)
        out: list[int] = []
        tried: list[int] = []
        dead = set()
        at, choice = 0, len(starts[0]) - 1
        while at < n:
            options = starts[at]
            while choice >= 0:
                token = options[choice]
                to = at + length[token]
                if to not in dead:
                    if not out:
                        break
                    fit = fits.get((out[-1], token))
                    if fit or fit is None and self._may_follow(out[-1], token):
                        break
                choice -= 1
            if choice >= 0:
                out.append(token)
                tried.append(choice)
                at = to
                choice = len(starts[at]) - 1 if at < n else -1
            else:
                dead.add(at)
                at -= length[out.pop()]
                choice = tried.pop() - 1
        return out

    def word_code(self, word: str) -> bytes:
        """The ids of one normalised word as little-endian unsigned 32-bit integers."""
        symbols = word.encode().decode("latin-1").translate(self._chars) + _END
        ids = [self._id[t] for t in self._tokens(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        # Lower case one character at a time: no final-sigma rule.
        words = self._word.findall(text.replace("Σ", "σ").lower())
        return b"".join(map(self._words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """All ids of ``text`` as little-endian unsigned 32-bit integers."""
        out = []
        for part in safe_parts(text):
            if self._split is None or not (cuts := list(self._split.finditer(part))):
                out.append(self._plain(part))
                continue
            lo = 0
            for m in cuts:
                out.append(self._plain(part[lo : m.start()]))
                out.append(self._special[m.group()].to_bytes(4, "little"))
                lo = m.end()
            out.append(self._plain(part[lo:]))
        return b"".join(out)

    def decode(self, code: bytes) -> bytes:
        """The tokens' strings, joined by one space, in UTF-8."""
        ids = np.frombuffer(code, "<u4").astype(np.int64)
        out = []
        for lo in range(0, len(ids), DECODE_TOKENS):
            some = ids[lo : lo + DECODE_TOKENS]
            sizes = self._offsets[some + 1] - self._offsets[some]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self._offsets[some] - (ends - sizes), sizes)
            out.append(self._blob[at].tobytes())
        return b"".join(out)[:-1]


_LOADED: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    if path not in _LOADED:
        _LOADED[path] = BpeCodec(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``ids`` are little-endian unsigned
    32-bit integers, ``decoded`` is the decoder's text of them.

    Null and empty texts have no ids and an empty decoded text; special
    strings inside texts become their ids; repeated rows and null doc_ids are
    kept; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)

        def packed(keys: list, codes: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(c) // 4 for c in codes], pa.int64()),
                 pa.array(codes, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

        for batch in batches:
            keys, codes, texts, held = [], [], [], 0
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                code = bpe.encode(text or "")
                decoded = bpe.decode(code)
                keys.append(key)
                codes.append(code)
                texts.append(decoded)
                held += len(code) + len(decoded)
                if held > OUT_BYTES:
                    yield packed(keys, codes, texts)
                    keys, codes, texts, held = [], [], [], 0
            if keys:
                yield packed(keys, codes, texts)

    schema = "doc_id long, n_tokens long, ids binary, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)

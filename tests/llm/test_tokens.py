import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridframe.llm.bpe import BpeCodec, encode_documents
from gridframe.llm.queries import vocabulary
from gridframe.llm.token_counts import count_tokens, lengths, safe_parts

from .cases import awkward, awkward_rows, clashing, nothing, prose

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word():
    return BpeCodec(WORD), Tokenizer.from_file(WORD)


def odd_texts():
    r = random.Random(3)
    return [t or "" for _, t, *_ in awkward_rows()] + [
        "".join(r.choice("aeinrst'! \nÀéΣß中😀1́ǅﬁ\x85\xa0") for _ in range(r.randint(0, 50))) for _ in range(400)
    ]


def test_encoding_and_decoding_equal_the_library(word):
    mine, library = word
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        code = mine.encode(text)
        assert np.frombuffer(code, "<u4").tolist() == ids, text[:80]
        assert mine.decode(code).decode() == library.decode(ids, skip_special_tokens=False)


def test_backtracking_equals_merging_in_rank_order(word):
    mine, _ = word

    def merged(symbols):
        parts = [mine._symbols[s] for s in symbols]
        while True:
            ranked = [(mine._merge[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in mine._merge]
            if not ranked:
                return parts
            m, i = min(ranked)
            parts[i : i + 2] = [m]

    r = random.Random(5)
    for _ in range(500):
        word_text = "".join(r.choice("aeiothnrs") for _ in range(r.randint(1, 14)))
        symbols = [*word_text[:-1], word_text[-1] + mine._end]
        assert mine._tokens(word_text + mine._end) == merged(symbols)


def test_encode_documents_takes_awkward_rows(spark):
    got = encode_documents(awkward(spark), WORD).collect()
    library = Tokenizer.from_file(WORD)
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward_rows())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert encode_documents(clashing(spark), WORD).count() == len(awkward_rows())
    assert encode_documents(nothing(spark), WORD).collect() == []


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in awkward_rows())
    got = count_tokens(awkward(spark), BYTE).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert count_tokens(clashing(spark), BYTE).count() == len(got)
    assert count_tokens(nothing(spark), BYTE).collect() == []


def test_safe_parts_add_up():
    text = prose(8, 30_000) + "  \n x<|endoftext|> y " + prose(9, 30_000)
    parts = safe_parts(text, 5000)
    assert len(parts) > 10 and "".join(parts) == text
    assert lengths(parts, BYTE).sum() == len(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids)
    assert safe_parts("x" * 300_000) == ["x" * 300_000]

import random
import time

import pytest
from tokenizers import Tokenizer

from meridian.llm import counts
from meridian.llm.counts import count_tokens, op13_tokencounts, token_counter
from meridian.llm.tokens import vocabulary

from ..conftest import SF


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def _size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_odd_texts_equal_the_library(library):
    draw = random.Random(1)
    atoms = ["a", "don't", " ", "\n", "  ", "x1", "\t", "é", "!", "<|endoftext|>", "<|endof", "'s", " ", "　", "1", "ß", "\r", "\x1c", "中文", "👍🏽", "́"]
    for _ in range(4000):
        text = "".join(draw.choice(atoms) for _ in range(draw.randrange(0, 10)))
        assert token_counter().count(text) == _size(library, text), repr(text)


def test_long_unbroken_words_equal_the_library(library):
    draw = random.Random(2)
    for letters, n in (("ab", 30_000), ("0123456789abcdef", 20_000), ("é中a", 9_000), ("abcdefghijklmnopqrstuvwxyz", 300_000)):
        text = "".join(draw.choice(letters) for _ in range(n))
        began = time.process_time()
        assert token_counter().count(text) == _size(library, text)
        assert time.process_time() - began < 20  # merging by scans for the least would take hours
    assert not any(len(piece) > counts.KEPT_LETTERS for kept in (token_counter().piece, token_counter().first) for piece in kept)


def test_kept_counts_begin_anew_and_stay_right(library, monkeypatch):
    monkeypatch.setattr(counts, "MOST_LETTERS", 200)
    ours, draw = counts.TokenCounter(vocabulary("byte_bpe_50k.json")), random.Random(3)
    for _ in range(300):
        text = " ".join("".join(draw.choice("etaoin") for _ in range(draw.randrange(1, 9))) for _ in range(6))
        assert ours.count(text) == _size(library, text)
    assert ours.spaced.letters <= 200 + 8 + 64


def test_documents(spark, library):
    got = {r.doc_id: r for r in op13_tokencounts(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = _size(library, r.text)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 512)


def test_odd_rows(spark):
    rows = [(None, None, 1, "x"), (7, "", 2, "y"), (7, "a b", 3, "z"), (7, "a b", 3, "z"), (8, "word " * 400_000, 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _n string")
    got = count_tokens(docs)
    assert sorted(got.columns) == sorted(["doc_id", "text", "_n", "n_bytes", "n_tokens", "over_limit"])
    found = sorted((r.n_bytes, r.n_tokens, r.over_limit, r._n) for r in got.collect())
    assert found == [(0, 0, False, "x"), (0, 0, False, "y"), (3, 2, False, "z"), (3, 2, False, "z"), (2_000_000, 400_001, True, "w")]
    assert count_tokens(docs.limit(0)).count() == 0

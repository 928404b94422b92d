import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from meridian.llm.bpe import LONG, encode_documents, word_bpe
from meridian.llm.tokens import byte_bpe, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def check(library, texts):
    for text, (raw, decoded) in zip(texts, word_bpe().encode_batch(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, repr(text)
        assert decoded == library.decode(ids, skip_special_tokens=False), repr(text)


def test_random_words_equal_the_library(library):
    draw = random.Random(3)
    letters = "etaoinshrdlucmfwypvbgkqxz"
    check(library, [" ".join("".join(draw.choice(letters) for _ in range(draw.randrange(1, 14))) for _ in range(40)) for _ in range(300)])


def test_odd_texts_equal_the_library(library):
    draw = random.Random(4)
    atoms = ["a", "Don't", " ", "\n", "\t", "1", "23", "é", "é", "ΑΣ", "İ", "ß", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "\x1c", "\x85", "　", "中文", "👍🏽", "...", "_", "́", "'LL", "fi"]
    check(library, ["".join(draw.choice(atoms) for _ in range(draw.randrange(0, 12))) for _ in range(3000)])


def test_long_unbroken_words_equal_the_library(library):
    draw = random.Random(5)
    for letters in ("ab", "etaoinshrdlu", "0123456789abcdef", "é中a"):
        check(library, ["".join(draw.choice(letters) for _ in range(n)) for n in (LONG - 1, LONG, LONG + 1, 5_000)])
    word_bpe()
    blob = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.process_time()
    [(raw, _)] = word_bpe().encode_batch([blob])
    assert time.process_time() - began < 30  # quadratic merging would take hours
    assert np.frombuffer(raw, "<u4").tolist() == library.encode(blob, add_special_tokens=False).ids


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(None, None, 1), (7, "", 1), (7, "", 1), (8, "word " * 50000, 1)]
    odd = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert [r.n_tokens for r in odd] == [0, 0, 0, 50000]
    got = {r.doc_id: r for r in encode_documents(docs).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].ids == ids and got[r.doc_id].decoded == library.decode(ids, skip_special_tokens=False)
    assert encode_documents(docs.limit(0)).count() == 0


def test_byte_level_ids_equal_the_library():
    library, ours, draw = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), byte_bpe(), random.Random(1)
    atoms = ["a", "don't", " ", "\n", "  ", "x1", "\t", "é", "!", "<|endoftext|>", "'s", " ", "　", "1", "ß", "\r", "\x1c"]
    for _ in range(3000):
        text = "".join(draw.choice(atoms) for _ in range(draw.randrange(0, 9)))
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
